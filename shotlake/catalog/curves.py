"""Curve operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6
from shotlake.catalog import views as v
from shotlake.operators import curves as op

TARGET = 60.0
# neighbouring points of each curve, its ends, and the enclosing pair of the target
ENDS = v.PROBES + f""",
segs AS (
  SELECT *, lead(x) OVER w AS x2, lead(score) OVER w AS s2 FROM probes WINDOW w AS (PARTITION BY job_id, shot_idx ORDER BY x)),
ends AS (
  SELECT job_id, shot_idx, count(*) AS n, min(x) AS x_lo, max(x) AS x_hi, arg_min(score, x) AS s_lo, arg_max(score, x) AS s_hi,
         arg_min(x, abs(score - {TARGET}) * 1000 + x / 1000.0) AS near FROM probes GROUP BY job_id, shot_idx),
around AS (
  SELECT job_id, shot_idx, min(x) AS x, arg_min(x2, x) AS x2, arg_min(score, x) AS s, arg_min(s2, x) AS s2
  FROM segs WHERE score >= {TARGET} AND {TARGET} >= s2 GROUP BY job_id, shot_idx),
inverted AS (
  SELECT e.job_id, e.shot_idx, CASE WHEN n = 1 THEN x_lo WHEN s_lo <= {TARGET} THEN x_lo WHEN s_hi >= {TARGET} THEN x_hi
    WHEN a.x IS NULL THEN near WHEN a.s = a.s2 THEN a.x ELSE a.x + (a.s - {TARGET}) / (a.s - a.s2) * (a.x2 - a.x) END AS x,
    s_lo > {TARGET} AND s_hi < {TARGET} AND a.x IS NOT NULL AS crossed, a.x AS lo, a.x2 AS hi
  FROM ends e LEFT JOIN around a USING (job_id, shot_idx))"""


@query("invert_curve", f"WITH {ENDS} SELECT job_id, shot_idx, round(greatest(15.0, least(45.0, x + 1.5)), 6) AS x FROM inverted")
def invert_curve(spark, sf):
    return op.invert_curve(v.probes(spark, sf), TARGET, 1.5, 15.0, 45.0).withColumn("x", r6("x"))


@query("bracket", f"""WITH {ENDS} SELECT job_id, shot_idx, CAST(CASE WHEN crossed THEN lo END AS DOUBLE) AS lo,
CAST(CASE WHEN crossed THEN hi END AS DOUBLE) AS hi FROM inverted""")
def bracket(spark, sf):
    return op.bracket(v.probes(spark, sf), TARGET)


@query("crossing", f"WITH {ENDS} SELECT job_id, shot_idx, round(CASE WHEN crossed THEN x END, 6) AS x_star FROM inverted")
def crossing(spark, sf):
    return op.crossing(v.probes(spark, sf), TARGET).withColumn("x_star", r6("x_star"))


# the same probes under two metrics, one with scores turned down by a fifth
METRICS = {"vmaf": TARGET, "xpsnr": TARGET * 0.9, "other": None}
BY_METRIC = v.PROBES.replace("probes AS (", "raw AS (", 1) + f""",
named AS MATERIALIZED (SELECT job_id || '|' || m AS job_id, shot_idx, x, CASE m WHEN 'vmaf' THEN score ELSE score * 0.8 + shot_idx % 7 END AS score, m
  FROM raw, (SELECT unnest({list(METRICS)}) AS m)),
probes AS (SELECT job_id, shot_idx, x, score - CASE m WHEN 'xpsnr' THEN {METRICS["xpsnr"] - TARGET} ELSE 0 END AS score FROM named WHERE m <> 'other')""" + ENDS.removeprefix(v.PROBES)


def _by_metric(spark, sf):
    low = F.col("score") * 0.8 + F.col("shot_idx") % 7
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col("score") if m == "vmaf" else low).alias("score")) for m in METRICS])
    return v.probes(spark, sf).select("job_id", "shot_idx", "x", F.inline(rows))


@query("invert_by_metric", f"""WITH {BY_METRIC} SELECT split_part(job_id, '|', 1) AS job_id, shot_idx, split_part(job_id, '|', 2) AS metric, round(x, 6) AS x FROM inverted
UNION ALL SELECT DISTINCT split_part(job_id, '|', 1), shot_idx, 'other', NULL FROM named WHERE m = 'other'""")
def invert_by_metric(spark, sf):
    return op.invert_curve(_by_metric(spark, sf), {m: t for m, t in METRICS.items() if t is not None}).withColumn("x", r6("x"))


@query("crossing_by_metric", f"""WITH {BY_METRIC} SELECT split_part(job_id, '|', 1) AS job_id, shot_idx, split_part(job_id, '|', 2) AS metric, round(CASE WHEN crossed THEN x END, 6) AS x_star FROM inverted
UNION ALL SELECT DISTINCT split_part(job_id, '|', 1), shot_idx, 'other', NULL FROM named WHERE m = 'other'""")
def crossing_by_metric(spark, sf):
    return op.crossing(_by_metric(spark, sf), {m: t for m, t in METRICS.items() if t is not None}).withColumn("x_star", r6("x_star"))


# a score asked for on every curve, at a setting that depends on the curve
WANTED = ENDS + """,
wanted AS (SELECT DISTINCT job_id, shot_idx, 2.0 + shot_idx * 1.1 AS ask FROM probes),
predicted AS (
  SELECT w.job_id, w.shot_idx, w.ask AS x, CASE WHEN ask <= x_lo THEN s_lo WHEN ask >= x_hi THEN s_hi ELSE
    (SELECT g.score + (w.ask - g.x) / (g.x2 - g.x) * (g.s2 - g.score) FROM segs g
     WHERE g.job_id = w.job_id AND g.shot_idx = w.shot_idx AND g.x <= w.ask AND w.ask <= g.x2 ORDER BY g.x LIMIT 1) END AS predicted
  FROM wanted w JOIN ends USING (job_id, shot_idx))"""


def _wanted(spark, sf):
    return v.probes(spark, sf).select("job_id", "shot_idx").distinct().withColumn("x", 2.0 + F.col("shot_idx") * 1.1)


@query("interpolate_curve", f"WITH {WANTED} SELECT job_id, shot_idx, CAST(round(x, 6) AS DOUBLE) AS x, round(predicted, 6) AS predicted FROM predicted")
def interpolate_curve(spark, sf):
    return op.interpolate_curve(v.probes(spark, sf), _wanted(spark, sf)).withColumn("x", r6("x")).withColumn("predicted", r6("predicted"))


# what was measured at those settings: off by up to two either way
DELIVERED = WANTED + """,
delivered AS (SELECT *, predicted + (shot_idx % 5) - 2 + length(job_id) % 3 * 0.4 AS delivered FROM predicted)"""


def _delivered(spark, sf):
    p = op.interpolate_curve(v.probes(spark, sf), _wanted(spark, sf))
    return p.select("job_id", "shot_idx", "x", (F.col("predicted") + F.col("shot_idx") % 5 - 2 + F.length("job_id") % 3 * 0.4).alias("delivered"))


@query("predicted_vs_delivered", f"""WITH {DELIVERED} SELECT job_id, shot_idx, round(delivered, 6) AS delivered,
round(predicted, 6) AS predicted, round(delivered - predicted, 6) AS delta FROM delivered""")
def predicted_vs_delivered(spark, sf):
    rows = op.predicted_vs_delivered(_delivered(spark, sf), v.probes(spark, sf))
    return rows.select("job_id", "shot_idx", r6("delivered").alias("delivered"), r6("predicted").alias("predicted"), r6("delta").alias("delta"))


@query("verification_report", f"""WITH {DELIVERED},
told AS (SELECT job_id, count(*) AS n, min(delivered) AS lowest, max(delivered) AS highest, median(delivered) AS median,
  count(*) FILTER (WHERE delivered < {TARGET}) AS below_target, avg(delivered - predicted) AS bias FROM delivered GROUP BY job_id)
SELECT job_id, n, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(median, 6) AS median, below_target, round(bias, 6) AS bias,
  CASE WHEN bias < -5 THEN 'misalignment' WHEN abs(bias) >= 0.5 THEN CASE WHEN bias > 0 THEN 'under-reports' ELSE 'over-reports' END ELSE 'agrees' END AS verdict
FROM told""")
def verification_report(spark, sf):
    rows = v.settle(op.predicted_vs_delivered(_delivered(spark, sf), v.probes(spark, sf)))
    told = op.verification_report(rows, TARGET)
    return told.select("job_id", "n", *[r6(c).alias(c) for c in ("lowest", "highest", "median")], "below_target", r6("bias").alias("bias"), "verdict")


@query("unreachable_report", f"""WITH {v.PROBES},
best AS (SELECT job_id, shot_idx, max(score) AS b FROM probes GROUP BY job_id, shot_idx)
SELECT job_id, count(*) AS curves, count(*) FILTER (WHERE b < 92) AS unreachable, round(min(b) FILTER (WHERE b < 92), 6) AS lowest_best,
       round(max(b) FILTER (WHERE b < 92), 6) AS highest_best FROM best GROUP BY job_id""")
def unreachable_report(spark, sf):
    told = op.unreachable_report(v.probes(spark, sf), 92.0)
    return told.withColumn("lowest_best", r6("lowest_best")).withColumn("highest_best", r6("highest_best"))


@query("probe_spend", f"""WITH {ENDS},
per AS (SELECT p.job_id, p.shot_idx, count(*) AS n, CASE WHEN p.shot_idx % 3 > 0 THEN 20.0 + p.shot_idx % 17 END AS seed,
  any_value(CASE WHEN crossed THEN i.x END) AS star FROM probes p JOIN inverted i USING (job_id, shot_idx) GROUP BY ALL)
SELECT job_id, CAST(sum(n) AS BIGINT) AS probes, count(*) AS shots, round(avg(n), 6) AS per_shot, round(count(seed) / count(*), 6) AS seeded_share,
       round(count(*) FILTER (WHERE abs(star - seed) > 5) / nullif(count(seed), 0), 6) AS walked_share FROM per GROUP BY job_id""")
def probe_spend(spark, sf):
    probes = v.probes(spark, sf)
    seeds = probes.select("job_id", "shot_idx").distinct().withColumn(
        "seed", F.when(F.col("shot_idx") % 3 > 0, 20.0 + F.col("shot_idx") % 17)).withColumn("step", F.lit(5))
    told = op.probe_spend(probes, target=TARGET, seeds=seeds)
    return told.select("job_id", "probes", "shots", *[r6(c).alias(c) for c in ("per_shot", "seeded_share", "walked_share")])


@query("smooth_lower_envelope", f"""WITH {v.CHOSEN}
SELECT a.job_id, a.shot_idx, least(a.x, min(b.x + 4.0 * abs(a.shot_idx - b.shot_idx)) FILTER (WHERE NOT b.pinned)) AS smoothed
FROM chosen a JOIN chosen b USING (job_id) GROUP BY a.job_id, a.shot_idx, a.x""")
def smooth_lower_envelope(spark, sf):
    return op.smooth_lower_envelope(v.chosen(spark, sf), 4.0).select("job_id", "shot_idx", "smoothed")


@query("setting_range", f"""WITH {v.CHOSEN}
SELECT job_id, min(x) AS lo, max(x) AS hi, count(*) AS shots, 'crf=' || CASE WHEN min(x) = max(x) THEN CAST(CAST(min(x) AS BIGINT) AS VARCHAR)
  ELSE CAST(CAST(min(x) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(max(x) AS BIGINT) AS VARCHAR) END || ' (per shot, ' || count(*) || ' shots)' AS text
FROM chosen GROUP BY job_id""")
def setting_range(spark, sf):
    return op.setting_range(v.chosen(spark, sf))


@query("union_with_precedence", f"""WITH {v.CHOSEN}
SELECT job_id, shot_idx, CASE WHEN pinned OR shot_idx % 4 = 0 THEN x + 0.5 ELSE x END AS x FROM chosen""")
def union_with_precedence(spark, sf):
    rows = v.chosen(spark, sf)
    mapped = rows.filter(F.col("pinned") | (F.col("shot_idx") % 4 == 0)).select("job_id", "shot_idx", (F.col("x") + 0.5).alias("x"))
    return op.union_with_precedence(rows.select("job_id", "shot_idx", "x"), mapped)


@query("agreement", f"""WITH {v.PROBES}
SELECT 'backend' || shot_idx % 3 AS backend, count(*) AS compared, round(max(abs(score - (score + (shot_idx % 3) * 0.0007 * (x % 2)))), 6) AS worst,
       max(abs(score - (score + (shot_idx % 3) * 0.0007 * (x % 2)))) <= 0.001 AS trusted FROM probes GROUP BY shot_idx % 3""")
def agreement(spark, sf):
    a = v.probes(spark, sf)
    k = F.col("shot_idx") % 3
    b = a.withColumn("backend", F.concat(F.lit("backend"), k.cast("string"))).withColumn(
        "score", F.col("score") + k * 0.0007 * (F.col("x") % 2))
    return op.agreement(a, b).withColumn("worst", r6("worst"))


# one step of the search, with the probes of settings up to a bound that depends on the curve
STEP = v.PROBES + f""",
given AS (SELECT * FROM probes WHERE x IN (5, 30, 50) AND NOT (shot_idx % 7 = 0 AND x = 30) OR x % 10 = 0 AND shot_idx % 5 = 0),
segs AS (SELECT *, lead(x) OVER w AS x2, lead(score) OVER w AS s2 FROM given WINDOW w AS (PARTITION BY job_id, shot_idx ORDER BY x)),
told AS (
  SELECT job_id, shot_idx, count(*) AS n, list(x) AS xs, arg_min(score, x) AS s_lo, arg_max(score, x) AS s_hi,
         min(x) FILTER (WHERE score >= {TARGET} AND {TARGET} >= s2) AS lo, arg_min(x2, x) FILTER (WHERE score >= {TARGET} AND {TARGET} >= s2) AS hi
  FROM segs GROUP BY job_id, shot_idx),
span AS (SELECT *, n >= 2 AND s_lo > {TARGET} AND s_hi < {TARGET} AND lo IS NOT NULL AS enclosed FROM told)"""


def _given(spark, sf):
    x, k = F.col("x"), F.col("shot_idx")
    return v.probes(spark, sf).filter((x.isin(5, 30, 50) & ~((k % 7 == 0) & (x == 30))) | ((x % 10 == 0) & (k % 5 == 0)))


@query("next_probe", f"""WITH {STEP},
judged AS (
  SELECT job_id, shot_idx, n, xs, enclosed, lo, hi, (lo + hi) // 2 AS mid,
         CASE WHEN NOT list_contains(xs, 5) THEN 5 WHEN NOT list_contains(xs, 30) THEN 30 WHEN NOT list_contains(xs, 50) THEN 50 END AS seed FROM span),
reason AS (SELECT *, CASE WHEN seed IS NOT NULL THEN NULL WHEN n >= 10 THEN 'budget' WHEN NOT enclosed THEN 'out of reach'
  WHEN hi - lo <= 6 THEN 'narrow' WHEN list_contains(xs, mid) THEN 'probed' END AS done FROM judged)
SELECT job_id, shot_idx, n AS probes, CASE WHEN seed IS NOT NULL THEN seed WHEN done IS NULL THEN mid END AS next_x, done FROM reason""")
def next_probe(spark, sf):
    # the middle one of ten settings, counted from both ends, is the fifth or sixth: half-even picks the fifth
    grid = [5, 10, 15, 20, 30, 35, 40, 44, 47, 50]
    return op.next_probe(_given(spark, sf), grid, TARGET, 6)


@query("next_probe_seeded", f"""WITH {STEP},
seeded AS (SELECT *, (shot_idx * 1.3) AS seed FROM span),
placed AS (SELECT *, greatest(5, least(50, CAST(round_even(seed, 0) AS BIGINT) - 5)) AS a, greatest(5, least(50, CAST(round_even(seed, 0) AS BIGINT) + 5)) AS b,
  CASE WHEN seed <= 5 THEN 5 WHEN seed >= 50 THEN 50 END AS bound FROM seeded),
way AS (SELECT *, CASE WHEN bound = 5 THEN (SELECT score FROM given g WHERE g.job_id = p.job_id AND g.shot_idx = p.shot_idx AND g.x = 5) <= {TARGET}
    WHEN bound = 50 THEN (SELECT score FROM given g WHERE g.job_id = p.job_id AND g.shot_idx = p.shot_idx AND g.x = 50) >= {TARGET} END AS settled,
  CASE WHEN s_hi >= {TARGET} THEN 50 WHEN s_lo <= {TARGET} THEN 5 END AS side FROM placed p),
reason AS (SELECT *, CASE WHEN bound IS NOT NULL AND NOT list_contains(xs, bound) THEN NULL WHEN settled THEN 'bound'
  WHEN NOT list_contains(xs, a) OR NOT list_contains(xs, b) THEN NULL WHEN n >= 10 THEN 'budget' WHEN enclosed THEN 'enclosed'
  WHEN side IS NULL OR list_contains(xs, side) THEN 'out of reach' END AS done FROM way)
SELECT job_id, shot_idx, n AS probes, CASE WHEN bound IS NOT NULL AND NOT list_contains(xs, bound) THEN bound WHEN done IS NOT NULL THEN NULL
  WHEN NOT list_contains(xs, a) THEN a WHEN NOT list_contains(xs, b) THEN b ELSE side END AS next_x, done FROM reason""")
def next_probe_seeded(spark, sf):
    given = _given(spark, sf)
    seeds = given.select("job_id", "shot_idx").distinct().withColumn("seed", F.col("shot_idx") * 1.3).withColumn("step", F.lit(5))
    return op.next_probe_seeded(given, seeds, v.GRID, TARGET)
