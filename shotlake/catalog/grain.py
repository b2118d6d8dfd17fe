"""Noise and visibility operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6, table
from shotlake.catalog import views as v
from shotlake.functions import display
from shotlake.operators import grain as op
from shotlake.operators import visibility as vis

CHANNEL_LIST = "(SELECT unnest(['y', 'cb', 'cr']) AS channel)"


@query("residual_by_bin", f"WITH {v.BINS} SELECT * FROM bins")
def residual_by_bin(spark, sf):
    return op.residual_by_bin(op.residual_sums(v.pixels(spark, sf)), v.MIN_N, v.MIN_N)


@query("residual_tiles", f"WITH {v.SUMS} SELECT * FROM sums")
def residual_tiles(spark, sf):
    # a tile holds the lines of at most 4096 orders
    small = [F.collect_list(F.col(c).cast("short")) for c in ("ry", "rb", "rr")]
    rows = v.pixel_values(spark, sf).groupBy("source_id", "shot_idx", "level", "tile").agg(
        *[s.alias(n) for s, n in zip(small, ("res_y", "res_cb", "res_cr"))])
    levels = F.transform("res_y", lambda _: F.col("level").cast("short"))
    return op.residual_sums_tiles(rows.drop("tile").withColumn("level_y", levels).withColumn("level_c", levels))


@query("bin_summary", f"""WITH {v.BINS},
med AS (SELECT source_id, bin_lo, channel, round(median(value), 2) AS median FROM bins GROUP BY ALL)
SELECT s.source_id, b.bin_lo, c.channel, m.median, coalesce(c.channel = 'y' AND m.median > 80, false) AS alarm
FROM (SELECT DISTINCT source_id FROM bins) s, {v.BIN_LIST} b, {CHANNEL_LIST} c
LEFT JOIN med m ON m.source_id = s.source_id AND m.bin_lo = b.bin_lo AND m.channel = c.channel""")
def bin_summary(spark, sf):
    return op.bin_summary(v.bins(spark, sf))


@query("cross_bin_grid", f"""WITH {v.BINS}
SELECT s.source_id, s.shot_idx, b.bin_lo, c.channel, x.value FROM (SELECT DISTINCT source_id, shot_idx FROM bins) s, {v.BIN_LIST} b, {CHANNEL_LIST} c
LEFT JOIN bins x ON x.source_id = s.source_id AND x.shot_idx = s.shot_idx AND x.bin_lo = b.bin_lo AND x.channel = c.channel""")
def cross_bin_grid(spark, sf):
    return op.cross_bin_grid(v.bins(spark, sf)).select("source_id", "shot_idx", "bin_lo", "channel", "value")


CURVE = """pairs AS (SELECT l_returnflag AS source_id, l_linenumber AS pair_id, CAST(l_quantity * 5 AS INT) AS level, (l_discount - l_tax) * 100 AS d FROM lineitem),
per AS (SELECT source_id, pair_id, """ + v.BIN_OF + """ AS bin_lo, count(d) AS n, var_pop(d) * count(d) AS s FROM pairs GROUP BY ALL)"""


@query("fresh_curve", f"""WITH {CURVE}
SELECT source_id, bin_lo, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) >= 200 THEN round(sqrt(sum(s) / sum(n)), 3) END AS std FROM per GROUP BY source_id, bin_lo""")
def fresh_curve(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source_id"), F.col("l_linenumber").alias("pair_id"), (F.col("l_quantity") * 5).cast("int").alias("level"),
        ((F.col("l_discount") - F.col("l_tax")) * 100).alias("d"))
    return op.fresh_curve(rows, 200)


# only every other cell measured, so that the others have a neighbour to take from
FILL = v.BINS + f""",
grid AS (SELECT s.source_id, s.shot_idx, c.channel, b.bin_lo, row_number() OVER (PARTITION BY s.source_id, s.shot_idx, c.channel ORDER BY b.bin_lo) AS i, x.value
  FROM (SELECT DISTINCT source_id, shot_idx FROM bins) s, {v.BIN_LIST} b, {CHANNEL_LIST} c
  LEFT JOIN bins x ON x.source_id = s.source_id AND x.shot_idx = s.shot_idx AND x.bin_lo = b.bin_lo AND x.channel = c.channel),
near AS (SELECT g.source_id, g.shot_idx, g.channel, g.bin_lo, arg_min(m.value, abs(m.i - g.i) * 100 + m.i) AS filled, max(m.i) AS top, any_value(g.i) AS i, any_value(g.value) AS own
  FROM grid g LEFT JOIN grid m ON m.source_id = g.source_id AND m.shot_idx = g.shot_idx AND m.channel = g.channel AND m.value IS NOT NULL GROUP BY ALL)"""


@query("fill_nearest", f"WITH {FILL} SELECT source_id, shot_idx, channel, bin_lo, filled FROM near")
def fill_nearest(spark, sf):
    dense = op.cross_bin_grid(v.bins(spark, sf))
    return op.fill_nearest(dense, ["source_id", "shot_idx", "channel"]).select("source_id", "shot_idx", "channel", "bin_lo", "filled")


@query("fill_below_brightest", f"WITH {FILL} SELECT source_id, shot_idx, channel, bin_lo, CASE WHEN i <= top THEN filled ELSE 0.0 END AS filled FROM near")
def fill_below_brightest(spark, sf):
    dense = op.cross_bin_grid(v.bins(spark, sf))
    return op.fill_nearest(dense, ["source_id", "shot_idx", "channel"], below_brightest=True).select("source_id", "shot_idx", "channel", "bin_lo", "filled")


# the applied grain: the same bins, scaled by shot
APPLIED = v.BINS + """,
applied AS (SELECT source_id, shot_idx, bin_lo, channel, value * (1 + shot_idx % 4 * 0.5) AS value FROM bins WHERE bin_lo <> 64),
t AS (SELECT source_id, bin_lo, channel, median(value) AS t FROM bins GROUP BY ALL),
a AS (SELECT source_id, bin_lo, channel, median(value) AS a FROM applied GROUP BY ALL),
corr AS (SELECT source_id, bin_lo, channel, CASE WHEN t IS NOT NULL AND a > 0.05 THEN greatest(0.25, least(4.0, t / a)) ELSE 1.0 END AS corr
  FROM t FULL JOIN a USING (source_id, bin_lo, channel))"""


def _applied(spark, sf):
    return v.bins(spark, sf).filter("bin_lo <> 64").withColumn("value", F.col("value") * (1 + F.col("shot_idx") % 4 * 0.5))


@query("target_vs_applied", f"WITH {APPLIED} SELECT source_id, bin_lo, channel, round(corr, 6) AS corr FROM corr")
def target_vs_applied(spark, sf):
    return op.target_vs_applied(v.bins(spark, sf), _applied(spark, sf)).withColumn("corr", r6("corr"))


@query("calibration", f"WITH {v.BINS} SELECT source_id, channel, round(median(value) / 64, 6) AS k FROM bins WHERE bin_lo IN (32, 48, 64, 80, 96) GROUP BY ALL")
def calibration(spark, sf):
    return op.calibration(v.bins(spark, sf)).withColumn("k", r6("k"))


@query("scaling_curves", f"""WITH {APPLIED},
k AS (SELECT source_id, channel, median(value) / 64 AS k FROM bins WHERE bin_lo IN (32, 48, 64, 80, 96) GROUP BY ALL),
grid AS (SELECT s.source_id, s.shot_idx, c.channel, b.bin_lo, row_number() OVER (PARTITION BY s.source_id, s.shot_idx, c.channel ORDER BY b.bin_lo) AS i, x.value
  FROM (SELECT DISTINCT source_id, shot_idx FROM bins) s, {v.BIN_LIST} b, {CHANNEL_LIST} c
  LEFT JOIN bins x ON x.source_id = s.source_id AND x.shot_idx = s.shot_idx AND x.bin_lo = b.bin_lo AND x.channel = c.channel),
near AS (SELECT g.source_id, g.shot_idx, g.channel, g.bin_lo, any_value(g.i) AS i, CASE WHEN any_value(g.i) <= max(m.i) THEN arg_min(m.value, abs(m.i - g.i) * 100 + m.i) ELSE 0 END AS filled
  FROM grid g LEFT JOIN grid m ON m.source_id = g.source_id AND m.shot_idx = g.shot_idx AND m.channel = g.channel AND m.value IS NOT NULL GROUP BY g.source_id, g.shot_idx, g.channel, g.bin_lo),
pts AS (SELECT n.source_id, shot_idx, n.channel, CASE i WHEN 1 THEN 8 WHEN 2 THEN 24 WHEN 3 THEN 40 WHEN 4 THEN 56 WHEN 5 THEN 72 WHEN 6 THEN 88 WHEN 7 THEN 112
    WHEN 8 THEN 144 WHEN 9 THEN 176 WHEN 10 THEN 208 ELSE 240 END AS x,
  CASE WHEN filled < CASE WHEN n.channel = 'y' THEN 1.0 ELSE 0.3 END THEN 0 ELSE CAST(least(255, round_even(least(255, round_even(
    CASE WHEN n.channel = 'y' THEN 1.0 ELSE 0.9 END * coalesce(corr, 1) * filled / k, 0)) * 0.7, 0)) AS INT) END AS y
  FROM near n JOIN k ON k.source_id = n.source_id AND k.channel = n.channel
  LEFT JOIN corr c ON c.source_id = n.source_id AND c.channel = n.channel AND c.bin_lo = n.bin_lo)
SELECT source_id, shot_idx, channel, x, y FROM pts WHERE channel = 'y' OR (x BETWEEN 40 AND 176)
UNION ALL SELECT source_id, shot_idx, channel, unnest([0, 16]), y FROM pts WHERE x = 8
UNION ALL SELECT source_id, shot_idx, channel, 255, y FROM pts WHERE x = 240""")
def scaling_curves(spark, sf):
    bins = v.bins(spark, sf)
    corr = op.target_vs_applied(bins, _applied(spark, sf))
    return op.scaling_curves(bins, op.calibration(bins), corr, 0.9, 0.7, k_key=["source_id"])


SHOT_SPANS = """spans AS (SELECT DISTINCT l_returnflag AS source_id, l_suppkey AS shot_idx, l_suppkey * 50 AS s0, l_suppkey * 50 + 10 + l_suppkey % 60 AS s1 FROM lineitem)"""


@query("hardest_shots", f"""WITH {v.BINS}, {SHOT_SPANS},
scored AS (SELECT b.source_id, b.shot_idx, sum(n / greatest(1, (s1 + 2) // 3 - (s0 + 2) // 3) * value * value / 1000) AS score FROM bins b JOIN spans USING (source_id, shot_idx)
  WHERE channel = 'y' AND bin_lo IN (48, 64, 80, 96, 128, 160) AND s1 - s0 >= 24 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, shot_idx) AS rank FROM scored WHERE score > 0)
SELECT source_id, shot_idx, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10""")
def hardest_shots(spark, sf):
    k = F.col("shot_idx")
    spans = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source_id"), F.col("l_suppkey").alias("shot_idx")).distinct().select(
        "source_id", "shot_idx", (k * 50).alias("s0"), (k * 50 + 10 + k % 60).alias("s1"))
    return op.hardest_shots(v.bins(spark, sf), spans).withColumn("score", F.round("score", 4))


SERIES = v.FRAMES + """,
series AS (SELECT source_id, frame_no // 20 AS shot_idx, frame_no, b AS band, u AS variant, mafd * CASE WHEN b = 'fine' THEN 1.0371 ELSE 0.4173 END
  + CASE WHEN u = 'auto' THEN frame_no % 3 ELSE 0 END AS energy FROM frames, (SELECT unnest(['fine', 'mid']) AS b), (SELECT unnest(['source', 'auto']) AS u)),
steps AS (SELECT *, abs(energy - lag(energy) OVER (PARTITION BY source_id, shot_idx, band, variant ORDER BY frame_no)) AS d FROM series),
swings AS (SELECT source_id, shot_idx, band, variant, count(*) AS measured, round(avg(d) / avg(energy), 4) AS swing, round(avg(energy), 3) AS level FROM steps GROUP BY ALL HAVING count(*) > 5)"""


def _swings(spark, sf):
    cells = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(u).alias("variant")) for b in ("fine", "mid") for u in ("source", "auto")])
    rows = v.frames(spark, sf).select("source_id", F.floor(F.col("frame_no") / 20).alias("shot_idx"), "frame_no", "mafd", F.inline(cells))
    energy = F.col("mafd") * F.when(F.col("band") == "fine", 1.0371).otherwise(0.4173) + F.when(F.col("variant") == "auto", F.col("frame_no") % 3).otherwise(0)
    return op.band_swing(rows.withColumn("energy", energy))


@query("band_swing", f"WITH {SERIES} SELECT * FROM swings")
def band_swing(spark, sf):
    return _swings(spark, sf)


@query("pooled_swing", f"""WITH {SERIES} SELECT source_id, band, variant, round(sum(swing * 1.000371 * measured) / sum(measured), 4) AS swing,
round(sum(level * 1.000371 * measured) / sum(measured), 4) AS level FROM swings GROUP BY ALL""")
def pooled_swing(spark, sf):
    # the factor keeps means of rounded values off the rounding ties
    rows = _swings(spark, sf).withColumn("swing", F.col("swing") * 1.000371).withColumn("level", F.col("level") * 1.000371)
    return op.pooled_swing(rows)


@query("swing_ratio", f"""WITH {SERIES} SELECT source_id, shot_idx, round(nullif(max(swing) FILTER (WHERE variant = 'auto'), 0) / nullif(max(swing) FILTER (WHERE variant = 'source'), 0), 3) AS fine_ratio
FROM swings WHERE band = 'fine' GROUP BY source_id, shot_idx""")
def swing_ratio(spark, sf):
    return op.swing_ratio(_swings(spark, sf))


@query("otsu_threshold", f"""WITH hist AS (SELECT l_suppkey AS key, CAST(l_quantity * 5 AS BIGINT) AS level, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY ALL),
cum AS (SELECT key, level, sum(c) OVER w AS wc, sum(c * level) OVER w AS m, sum(c) OVER (PARTITION BY key) AS t, sum(c * level) OVER (PARTITION BY key) AS mt FROM hist WINDOW w AS (PARTITION BY key ORDER BY level)),
sig AS (SELECT key, level, CASE WHEN wc * (t - wc) > 0 THEN (mt * wc - m * t) * (mt * wc - m * t) / (wc * (t - wc)) ELSE 0 END AS s FROM cum)
SELECT key, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, level) AS r FROM sig) WHERE r = 1""")
def otsu_threshold(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_quantity") * 5).cast("long").alias("level"))
    return op.otsu_threshold(rows.groupBy("key", "level").agg(F.count(F.lit(1)).alias("cnt")), ["key"])


@query("active_box", """WITH px AS (SELECT l_returnflag AS clip_id, l_suppkey % 97 AS y, l_partkey % 89 AS x, max(l_quantity) AS m FROM lineitem GROUP BY ALL),
r AS (SELECT clip_id, y, avg(CASE WHEN m > 20 THEN 1.0 ELSE 0 END) AS s FROM px GROUP BY ALL), c AS (SELECT clip_id, x, avg(CASE WHEN m > 20 THEN 1.0 ELSE 0 END) AS s FROM px GROUP BY ALL),
rr AS (SELECT clip_id, count(*) FILTER (WHERE s > 0.02) AS n, min(y) FILTER (WHERE s > 0.02) AS a, max(y) FILTER (WHERE s > 0.02) AS b, max(y) + 1 AS h FROM r GROUP BY clip_id),
cc AS (SELECT clip_id, count(*) FILTER (WHERE s > 0.02) AS n, min(x) FILTER (WHERE s > 0.02) AS a, max(x) FILTER (WHERE s > 0.02) AS b, max(x) + 1 AS w FROM c GROUP BY clip_id)
SELECT clip_id, CASE WHEN rr.n < 64 OR cc.n < 64 THEN 0 ELSE rr.a // 2 * 2 END AS r0, CASE WHEN rr.n < 64 OR cc.n < 64 THEN h ELSE (rr.b + 1) // 2 * 2 END AS r1,
  CASE WHEN rr.n < 64 OR cc.n < 64 THEN 0 ELSE cc.a // 2 * 2 END AS c0, CASE WHEN rr.n < 64 OR cc.n < 64 THEN w ELSE (cc.b + 1) // 2 * 2 END AS c1 FROM rr JOIN cc USING (clip_id)""")
def active_box(spark, sf):
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("clip_id"), (F.col("l_suppkey") % 97).alias("y"),
                                             (F.col("l_partkey") % 89).alias("x"), F.col("l_quantity").alias("v"))
    return op.active_box(px, 20)


# histograms from the embeddings: value against its successor
HIST = """vals AS (SELECT vec_id, label, i, abs(embedding[i]) AS n, abs(embedding[i + 1]) AS m FROM embeddings, (SELECT unnest(range(1, 64)) AS i)),
rows_ AS (SELECT vec_id % 20 AS clip_id, CASE WHEN vec_id % 2 = 0 THEN 'dt' ELSE 'frz' END AS variant, i % 6 AS band, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, label + 1.0 AS la FROM vals),
binned AS (SELECT clip_id, variant, band, greatest(0, least(23, ceil((log10(greatest(n, 1e-8)) + 4.0) / 0.2))) AS n_bin,
  greatest(0, least(14, ceil((log10(greatest(m, 1e-8)) + 3.6) / 0.3))) AS m_bin, greatest(0, least(20, ceil((log10(greatest(CAST(la AS DOUBLE), 1e-8)) + 3.0) * 3))) AS l_bin FROM rows_),
hist AS (SELECT clip_id, variant, band, CAST(n_bin AS INT) AS n_bin, CAST(m_bin AS INT) AS m_bin, CAST(l_bin AS INT) AS l_bin, count(*) AS cnt FROM binned GROUP BY ALL)"""


def _rows(spark, sf):
    e = table(spark, sf, "embeddings")
    k = F.col("vec_id")
    pos = e.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("i"))
    return pos.select((k % 20).alias("clip_id"), F.when(k % 2 == 0, "dt").otherwise("frz").alias("variant"), (F.col("i") % 6).alias("band"),
                      F.abs(F.element_at("embedding", F.col("i"))).cast("double").alias("n"),
                      F.abs(F.element_at("embedding", F.col("i") + 1)).cast("double").alias("m"), (F.col("label") + 1.0).alias("la"))


@v.written
def _hist(spark, sf):
    return vis.contrast_histogram(_rows(spark, sf))


@query("contrast_histogram", f"WITH {HIST} SELECT * FROM hist")
def contrast_histogram(spark, sf):
    return vis.contrast_histogram(_rows(spark, sf))


@query("chroma_histogram", f"""WITH {HIST}, c AS (SELECT clip_id, variant, band, greatest(0, least(21, ceil((log10(greatest(n, 1e-8)) + 1.5) / 0.15))) AS c_bin,
greatest(0, least(20, ceil((log10(greatest(CAST(la AS DOUBLE), 1e-8)) + 3.0) * 3))) AS l_bin FROM rows_)
SELECT clip_id, variant, band, CAST(c_bin AS INT) AS c_bin, CAST(l_bin AS INT) AS l_bin, count(*) AS cnt FROM c GROUP BY ALL""")
def chroma_histogram(spark, sf):
    return vis.chroma_histogram(_rows(spark, sf).withColumnRenamed("n", "c"))


@query("merge_histograms", f"WITH {HIST} SELECT clip_id, band, n_bin, m_bin, l_bin, CAST(sum(cnt) AS BIGINT) AS cnt FROM hist GROUP BY ALL")
def merge_histograms(spark, sf):
    return vis.merge_histograms(_hist(spark, sf), ["clip_id", "band"])


# a sensitivity table that is bilinear in its own index, so that interpolating it has a closed form
LUT_ROWS, LUT_COLUMNS = [-2.0, -1.0, 0.0, 1.0, 2.0], [0.0, 0.5, 1.0, 1.5]
LUT = vis.Lut(LUT_ROWS, LUT_COLUMNS, [[1.0 + 0.2 * i - 0.3 * j + 0.05 * i * j for j in range(4)] for i in range(5)])


def _lut_sql(row: str, column: str) -> str:
    i, j = f"(greatest(-2.0, least(2.0, {row})) + 2.0)", f"(greatest(0.0, least(1.5, {column})) * 2.0)"
    return f"(1.0 + 0.2 * {i} - 0.3 * {j} + 0.05 * {i} * {j})"


@query("lut_bilinear", f"""SELECT l_orderkey, l_linenumber, l_partkey, round({_lut_sql('ln(l_quantity) - 2', 'l_discount * 20')}, 6) AS s FROM lineitem""")
def lut_bilinear(spark, sf):
    s = vis.lut_bilinear(LUT, F.log("l_quantity") - 2, F.col("l_discount") * 20)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(s).alias("s"))


# a table of prices by part and quantity, fifty cells a part, read between its lines and past its edges
@query("lut_lookup", """WITH n AS (SELECT min(p_partkey) AS low, max(p_partkey) AS top FROM part),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(low, least(top, l_partkey + 0.3713)) AS r, greatest(1.0, least(50.0, l_quantity * 1.2371 - 2)) AS c, top FROM lineitem, n),
i AS (SELECT *, least(floor(r), top - 1) AS lo FROM x)
SELECT l_orderkey, l_linenumber, i.l_partkey, round((a.p_retailprice + (r - lo) * (b.p_retailprice - a.p_retailprice)) * (1 + c / 100), 4) AS price
FROM i JOIN part a ON a.p_partkey = lo JOIN part b ON b.p_partkey = lo + 1""")
def lut_lookup(spark, sf):
    cells = table(spark, sf, "part").select(F.col("p_partkey").alias("row"), "p_retailprice", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("column"))
    cells = cells.select("row", "column", (F.col("p_retailprice") * (1 + F.col("column") / 100)).alias("value"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    told = vis.lut_lookup(rows, cells, F.col("l_partkey") + 0.3713, F.col("l_quantity") * 1.2371 - 2, "price")
    return told.select("l_orderkey", "l_linenumber", "l_partkey", F.round("price", 4).alias("price"))


def _visible(name: str, logk: float, q: float, beta: float) -> str:
    m = vis.MODEL
    return f"""
{name}_x AS (
  SELECT clip_id, band, cnt, motion, beta_x, beta_x / 2 * (2 * (-4.0 + (n_bin - 0.5) * 0.2 + att + {m['alpha']} * (ls - 2))
    - log10(1 + pow(10, {logk} + {q} * (-3.6 + (m_bin - 0.5) * 0.3 + att + 2))) - 2 * log10(1 + pow(10, {m['gn']} * ({m['lg0']} - log10(la))))) AS x
  FROM (SELECT *, {beta} AS beta_x, log10((la - 0.01) / la) AS att, {_lut_sql('log10(la)', 'log10(rho)')} AS ls FROM (
    SELECT h.*, c.motion, pow(10, -3.0 + (l_bin - 0.5) / 3) + 0.01 AS la,
           CASE WHEN band = 0 THEN 1.0 ELSE 0.3228 * pow(2.0, 1 - band) END * 40.0 / least(3840 / width, 2160 / height) / 2 AS rho
    FROM hist h JOIN clips c USING (clip_id) WHERE variant = '{name}'))),
{name}_m AS (SELECT *, max(x) OVER w AS top, cnt / sum(cnt) OVER w AS wt FROM {name}_x WINDOW w AS (PARTITION BY clip_id, band)),
{name}_p AS (SELECT clip_id, band, any_value(motion) AS motion, (log10(sum(wt * pow(10, x - top))) + any_value(top)) / any_value(beta_x) AS p FROM {name}_m GROUP BY ALL),
{name}_v AS (SELECT clip_id, log10(sum(pow(10, 2 * p))) / 2 - {m['gm']} * log10(1 + any_value(motion) / 10.0) AS v FROM {name}_p GROUP BY clip_id)"""


CLIPS = HIST + """,
clips AS (SELECT DISTINCT clip_id, 1920.0 AS width, 1080.0 AS height, CAST(clip_id % 5 AS DOUBLE) AS motion FROM hist),""" + _visible(
    "dt", vis.MODEL["logk"], vis.MODEL["q"], vis.MODEL["beta"]) + "," + _visible("frz", vis.MODEL["logk_b"], vis.MODEL["q_b"], vis.MODEL["beta_b"]) + """,
vis AS (SELECT clip_id, 'dt' AS variant, v FROM dt_v UNION ALL SELECT clip_id, 'frz', v FROM frz_v)"""


@v.written
def _visibility(spark, sf):
    hist = _hist(spark, sf)
    clips = hist.select("clip_id").distinct().withColumns({
        "trc": F.lit("bt709"), "width": F.lit(1920.0), "height": F.lit(1080.0), "motion": (F.col("clip_id") % 5).cast("double")})
    a = vis.pooled_visibility(hist.filter("variant = 'dt'"), clips, lut=LUT)
    b = vis.pooled_visibility(hist.filter("variant = 'frz'"), clips, vis.part_b(vis.MODEL), lut=LUT)
    return a.unionByName(b)


@query("pooled_visibility", f"WITH {CLIPS} SELECT clip_id, variant, round(v, 6) AS v FROM vis")
def pooled_visibility(spark, sf):
    return _visibility(spark, sf).withColumn("v", r6("v"))


# the two variants of neighbouring clips
BOTH = CLIPS + """,
pair AS (SELECT a.clip_id, a.v AS a, b.v - 3.0 AS b FROM dt_v a JOIN frz_v b ON b.clip_id = a.clip_id + 1),
comb AS (SELECT clip_id, greatest(a, b) + log10(pow(10, a - greatest(a, b)) + pow(10, b - greatest(a, b))) AS v FROM pair)"""


def _combined(spark, sf):
    rows = _visibility(spark, sf)
    b = rows.filter("variant = 'frz'").withColumn("clip_id", F.col("clip_id") - 1)
    return vis.combine_visibility(rows.filter("variant = 'dt'"), b)


@query("combine_visibility", f"WITH {BOTH} SELECT clip_id, round(v, 6) AS v FROM comb")
def combine_visibility(spark, sf):
    return _combined(spark, sf).withColumn("v", r6("v"))


LINK = vis.MODEL["link"]


@query("noise_level", f"""WITH {BOTH}, lv AS (SELECT clip_id, {vis.SCALE[0]} + {vis.SCALE[1]} * (pow(10, {LINK} * v) - 1) / {LINK} AS level FROM comb)
SELECT clip_id, round(level, 4) AS level, round(greatest(1.0, least(50.0, level)), 4) AS level_on_scale FROM lv""")
def noise_level(spark, sf):
    rows = vis.noise_level(_combined(spark, sf))
    return rows.select("clip_id", F.round("level", 4).alias("level"), F.round("level_on_scale", 4).alias("level_on_scale"))


@query("window_spread", """SELECT l_suppkey AS clip_id, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_suppkey""")
def window_spread(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip_id"), F.col("l_extendedprice").alias("level"))
    return vis.window_spread(rows).select("clip_id", *[r6(c).alias(c) for c in ("p10", "p50", "p90")])


FEATURES = """samples AS (SELECT l_returnflag AS source_id, l_suppkey AS pair_id, l_discount AS x0, l_tax + l_discount / 2 AS x1, l_extendedprice / 1000 AS d, l_quantity AS ry, l_quantity > 5 AS mask FROM lineitem),
per AS (SELECT source_id, pair_id, corr(x0, x1) FILTER (WHERE mask) AS fresh_corr, kurtosis_pop(d) FILTER (WHERE mask) AS kurtosis, stddev_samp(ry) FILTER (WHERE mask) AS y_std,
  avg(CASE WHEN mask THEN 1.0 ELSE 0 END) AS share FROM samples GROUP BY ALL HAVING count(*) FILTER (WHERE mask) >= 20),
feats AS (SELECT source_id, count(*) AS pairs_used, round(median(fresh_corr), 4) AS fresh_corr, round(median(kurtosis), 4) AS kurtosis, round(median(y_std), 4) AS y_std, round(median(share), 4) AS share FROM per GROUP BY source_id)"""


def _features(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source_id"), F.col("l_suppkey").alias("pair_id"), F.col("l_discount").alias("x0"),
        (F.col("l_tax") + F.col("l_discount") / 2).alias("x1"), (F.col("l_extendedprice") / 1000).alias("d"),
        F.col("l_quantity").alias("ry"), (F.col("l_quantity") > 5).alias("mask"))
    return vis.texture_features(rows, min_px=20)


@query("texture_features", f"WITH {FEATURES} SELECT * FROM feats")
def texture_features(spark, sf):
    return _features(spark, sf)


@query("decide_noise", f"""WITH {FEATURES}, lv AS (SELECT l_returnflag AS source_id, round(avg(l_quantity), 4) AS level FROM lineitem GROUP BY 1)
SELECT source_id, level, CASE WHEN level < 12 OR coalesce(pairs_used, 0) = 0 THEN 'clean' WHEN coalesce(kurtosis, 0) > 3 OR coalesce(fresh_corr, 0) > 0.35 THEN 'texture' ELSE 'grain' END AS class
FROM lv LEFT JOIN feats USING (source_id)""")
def decide_noise(spark, sf):
    levels = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source_id")).agg(F.round(F.avg("l_quantity"), 4).alias("level"))
    return vis.decide_noise(levels, _features(spark, sf)).select("source_id", "level", "class")


@query("eotf", """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS e, CASE l_linenumber % 3 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' ELSE 'bt709' END AS trc FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE trc WHEN 'smpte2084' THEN least(1000.0, 10000 * pow(greatest(pow(e, 1 / 78.84375) - 0.8359375, 0) / (18.8515625 - 18.6875 * pow(e, 1 / 78.84375)), 1 / 0.1593017578125))
  WHEN 'arib-std-b67' THEN 1000 * pow(CASE WHEN e <= 0.5 THEN e * e / 3 ELSE (exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 1.2) ELSE 200 * pow(e, 2.4) END, 5) AS cd FROM e""")
def eotf(spark, sf):
    k = F.col("l_linenumber") % 3
    trc = F.when(k == 0, "smpte2084").when(k == 1, "arib-std-b67").otherwise("bt709")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                               F.round(display.eotf(F.col("l_quantity") / 50, trc), 5).alias("cd"))


@query("display_math", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS l, l_linenumber AS band FROM lineitem),
p AS (SELECT *, pow((0.8359375 + 18.8515625 * pow(l / 10000, 0.1593017578125)) / (1 + 18.6875 * pow(l / 10000, 0.1593017578125)), 78.84375) AS pq,
  596.3148142 * (pow((0.353487901 + 0.3734658629 * pow(l, 0.9062562627)) / (1 + 8.277049286e-05 * pow(l, 0.9062562627)), 0.09150303166) - 0.9099517204) AS pu FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, round(pq, 6) AS pq, round(pu, 5) AS pu, round(0.3 * log10(l / 100), 6) AS pow_unit, round(0.3228 * pow(2.0, 1 - band) * 30, 6) AS freq FROM p""")
def display_math(spark, sf):
    lum, band = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(display.pq_encode(lum)).alias("pq"), F.round(display.pu21_encode(lum), 5).alias("pu"),
        r6(display.unit_log(lum, "pow", 0.3)).alias("pow_unit"), r6(display.band_freq(band, F.lit(60.0))).alias("freq"))


@query("luminance", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, (64 + l_quantity * 17 - 64) / 876 AS y, (400 + l_linenumber * 30 - 512.0) / 896 AS cb, (600 - l_linenumber * 20 - 512.0) / 896 AS cr FROM lineitem),
rgb AS (SELECT *, greatest(0, least(1, y + 1.5748 * cr)) AS r, greatest(0, least(1, y - 0.1873 * cb - 0.4681 * cr)) AS g, greatest(0, least(1, y + 1.8556 * cb)) AS b FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(200 * (0.2126 * pow(r, 2.4) + 0.7152 * pow(g, 2.4) + 0.0722 * pow(b, 2.4)), 5) AS cd FROM rgb""")
def luminance(spark, sf):
    n = F.col("l_linenumber")
    cd = display.luminance(64 + F.col("l_quantity") * 17, 400 + n * 30, 600 - n * 20, F.lit("bt709"), F.lit(False))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(cd, 5).alias("cd"))
