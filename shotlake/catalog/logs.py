"""Log readers and record formats on the given tables: the tables are first
turned into the text a tool would have written."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake import schemas
from shotlake.catalog import query, r6, table
from shotlake.catalog import views as v
from shotlake.operators import grain as grain_op
from shotlake.sources import grain_tables, logs


@query("parse_frame_log", f"""WITH {v.FRAMES} SELECT source_id AS file, frame_no, frame_no / 25.0::DOUBLE AS pts, round(scd_score, 2) AS scd_score, mafd FROM frames""")
def parse_frame_log(spark, sf):
    frames = v.frames(spark, sf)
    n = F.col("frame_no")
    score = F.format_string("lavfi.scd.score=%.2f", "scd_score")
    text = F.array(F.format_string("frame:%d    pts:%d    pts_time:%s", n, n, (n / 25.0).cast("string")),
                   F.format_string("lavfi.scd.mafd=%.2f", "mafd"), score)
    lines = frames.select(F.col("source_id").alias("file"), n.alias("_n"), F.posexplode(text).alias("_i", "text")).select(
        "file", (F.col("_n") * 3 + F.col("_i")).alias("line"), "text")
    return logs.parse_frame_log(lines, order=["line"], width=1 << 16)


@query("metric_score", """WITH b AS (SELECT event_id, value FROM events)
SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN value END AS score, CASE event_id % 7 WHEN 3 THEN 'no such metric; found a, b' WHEN 4 THEN 'unreadable' WHEN 5 THEN 'not a score log' WHEN 6 THEN 'not a finite number' END AS error FROM b""")
def metric_score(spark, sf):
    k, s = F.col("event_id") % 7, F.col("value").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"pooled_metrics":{"vmaf":{"mean":'), s, F.lit('},"x":{"mean":1}}}'))).when(
        k == 1, F.concat(F.lit('{"aggregateVMAF":'), s, F.lit("}"))).when(k == 2, F.concat(F.lit('{"pooled_metrics":{"other":{"mean":'), s, F.lit("}}}"))).when(
        k == 3, '{"pooled_metrics":{"a":{"mean":1},"b":{"mean":2}}}').when(k == 4, '{"pooled').when(k == 5, "[]").otherwise(
        '{"pooled_metrics":{"vmaf":{"mean":"NaN"}}}')
    m = logs.metric_score(body, "vmaf")
    return table(spark, sf, "events").select("event_id", m["score"].alias("score"), m["error"].alias("error"))


@query("parse_progress", """SELECT event_id, CAST(least(100, floor(value)) AS DOUBLE) AS pct, CAST(floor(value) AS BIGINT) AS done, CAST(1200 AS BIGINT) AS total, CAST(97.15 AS DOUBLE) AS fps FROM events WHERE event_id % 4 > 0""")
def parse_progress(spark, sf):
    n = F.floor("value")
    bar = F.format_string("old 1%% 1/1200 (1.0 fps, x)\r\u001b[32m00:07 [1/5 Chunks]  %d%% %d/1200 (97.15 fps, eta 5s)\u001b[0m", F.least(F.lit(100), n), n)
    text = F.when(F.col("event_id") % 4 == 0, "Queue 5 Workers").otherwise(bar)
    return logs.parse_progress(table(spark, sf, "events").select("event_id", text.alias("text")))


@query("score_every_nth", f"""WITH {v.FRAMES} SELECT source_id AS job_id, count(*) AS frames, round(avg(mafd), 6) AS score FROM frames WHERE frame_no % 4 = 0 GROUP BY source_id""")
def score_every_nth(spark, sf):
    rows = v.frames(spark, sf).select(F.col("source_id").alias("job_id"), "frame_no", F.col("mafd").alias("score"))
    return logs.score_every_nth(rows, rows, 4)


@v.written
def _records(spark, sf):
    """Shot records of the probe dataset, one per curve."""
    probes = v.probes(spark, sf)
    both = probes.withColumn("encoder", F.lit("svt")).unionByName(probes.filter("x >= 20").withColumn("encoder", F.lit("qsv")))
    k = F.col("shot_idx")
    shots = probes.select("job_id", "shot_idx").distinct().withColumns(
        {"s0": (k * 100).cast("long"), "s1": (k * 100 + 60).cast("long"), "w0": (k * 100 + 10).cast("long"), "w1": (k * 100 + 50).cast("long")})
    total = shots.groupBy("job_id").agg(F.max("s1").alias("n_frames"))
    return logs.shot_records(shots, both, 60.0, total)


@query("shot_records", f"""WITH {v.PROBES}, t AS (SELECT job_id, max(shot_idx) * 100 + 60 AS n FROM probes GROUP BY job_id)
SELECT job_id AS job, shot_idx AS idx, CAST(60 AS BIGINT) AS frames, round(shot_idx * 100 / n, 5) AS pos, CAST(count(*) AS BIGINT) AS points, round(max(score) FILTER (WHERE x = 20), 6) AS at20 FROM probes JOIN t USING (job_id) GROUP BY job_id, shot_idx, n""")
def shot_records(spark, sf):
    return _records(spark, sf).select("job", "idx", "frames", "pos", F.size("svt").cast("long").alias("points"), r6(F.col("qsv")["20"]).alias("at20"))


@query("dataset_probes", f"""WITH {v.PROBES} SELECT job_id, shot_idx, 'svt' AS encoder, x, round(score, 6) AS score FROM probes UNION ALL SELECT job_id, shot_idx, 'qsv', x, round(score, 6) FROM probes WHERE x >= 20""")
def dataset_probes(spark, sf):
    lines = _records(spark, sf).select(F.to_json(F.struct("*")).alias("line"))
    log = lines.select(F.from_json("line", schemas.PROBE_LOG).alias("r")).select("r.*")
    return logs.dataset_probes(log).select("job_id", "shot_idx", "encoder", F.col("x").cast("long").alias("x"), r6("score").alias("score"))


def _read_back(records):
    """Records as the lines of the file they are written to, parsed."""
    return records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("line")).select(F.from_json("line", schemas.PROBE_LOG).alias("r")).select("r.*")


@v.written
def _costed(spark, sf):
    """Shot records with costs on every second setting and seeds on every third shot."""
    probes, k = v.probes(spark, sf), F.col("shot_idx")
    both = probes.withColumns({"encoder": F.lit("svt"), "bytes_per_frame": F.lit(None).cast("double")}).unionByName(
        probes.filter("x >= 20").withColumns({"encoder": F.lit("qsv"), "bytes_per_frame": F.when(F.col("x") % 10 == 0, F.col("x") * 2.5 + k)}))
    shots = probes.select("job_id", "shot_idx").distinct().withColumns(
        {"s0": (k * 100).cast("long"), "s1": (k * 100 + 60).cast("long"), "w0": (k * 100 + 10).cast("long"), "w1": (k * 100 + 50).cast("long")})
    seeds = shots.filter(k % 3 == 0).select("job_id", "shot_idx", (k / 2 + 20).alias("seed"))
    return logs.shot_records(shots, both, 60.0, shots.groupBy("job_id").agg(F.max("s1").alias("n_frames")), seeds)


@query("dataset_costs", f"""WITH {v.PROBES} SELECT job_id, shot_idx, x, round(score, 6) AS score, CAST(CASE WHEN x % 10 = 0 THEN x * 2.5 + shot_idx END AS DOUBLE) AS bytes_per_frame FROM probes WHERE x >= 20""")
def dataset_costs(spark, sf):
    rows = logs.dataset_probes(_read_back(_costed(spark, sf))).filter("encoder = 'qsv'")
    return rows.select("job_id", "shot_idx", F.col("x").cast("long").alias("x"), r6("score").alias("score"), "bytes_per_frame")


@query("dataset_seeds", f"""WITH {v.PROBES} SELECT DISTINCT job_id AS job, shot_idx AS idx, CASE WHEN shot_idx % 3 = 0 THEN shot_idx / 2 + 20 END AS seed FROM probes""")
def dataset_seeds(spark, sf):
    return _read_back(_costed(spark, sf)).select("job", "idx", "seed")


@query("job_records", f"""WITH {v.PROBES}, s AS (SELECT job_id, count(DISTINCT shot_idx) AS shots FROM probes GROUP BY job_id)
SELECT 'job' AS type, job_id AS job, job_id || '.mkv' AS source, CAST(24 + shots % 2 AS DOUBLE) AS fps, 'vmaf' AS metric, CAST(93.5 AS DOUBLE) AS target, '[20,30,40]' AS grid, shots, CAST(shots * 60 AS BIGINT) AS frames FROM s""")
def job_records(spark, sf):
    shots = _costed(spark, sf).select(F.col("job").alias("job_id"), "idx", "s0", "s1")
    jobs = shots.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).select(
        "job_id", F.concat("job_id", F.lit(".mkv")).alias("source"), (F.lit(24.0) + F.col("n") % 2).alias("fps"), F.lit("vmaf").alias("metric"),
        F.lit(93.5).alias("target"), F.array(F.lit(20), F.lit(30), F.lit(40)).alias("probe_grid"))
    log = _read_back(logs.job_records(jobs, shots))
    return log.select("type", "job", "source", "fps", "metric", "target", F.to_json("probe_grid").alias("grid"), "shots", "frames")


@query("dataset_settings", f"""WITH {v.CHOSEN} SELECT job_id, shot_idx, x FROM chosen""")
def dataset_settings(spark, sf):
    log = _read_back(logs.crfs_records(v.chosen(spark, sf)))
    return logs.dataset_settings(log).select(F.col("job_id").cast("long").alias("job_id"), "shot_idx", "x")


@query("parse_jobs", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS tag, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders""")
def parse_jobs(spark, sf):
    k = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp").cast("double")
    meta = F.when(k % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('"}')))
    rows = table(spark, sf, "orders").select(k.alias("id"), meta.alias("meta"), F.lit("{}").alias("params"), created.alias("created_at"),
                                             *[F.lit(None).cast("double").alias(c) for c in ("started_at", "finished_at", "finalized_at")])
    out = logs.parse_jobs(rows)
    return out.select("id", F.try_element_at("meta_map", F.lit("status")).alias("tag"), F.unix_seconds("created_ts").alias("created"))


# grain tables: a supplier is a file, an order line a segment of two vectors
LINES = """seg AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS seg_id, CAST(l_quantity AS INT) AS q, CAST(l_partkey AS INT) AS pk FROM lineitem)"""


@v.written
def _segments(spark, sf):
    rows = v._numbered(table(spark, sf, "lineitem"), "l_suppkey", v.PAIR_ORDER, float(1 << 16), "seg_id")
    n, q, pk = F.col("seg_id"), F.col("l_quantity").cast("int"), F.col("l_partkey")
    text = F.array(F.format_string("E %d %d 1 7 1", n * 10, n * 10 + 10), F.format_string("\tcY %d %d 3", q, pk), F.format_string("\tsY 1 0 %d", q))
    lines = rows.select(F.col("l_suppkey").alias("file"), n, F.posexplode(text).alias("_i", "text")).select(
        "file", (n * 3 + F.col("_i")).alias("line"), "text")
    return grain_tables.parse_grain_table(lines, order=["line"], width=1 << 16)


@query("parse_grain_table", f"""WITH {LINES} SELECT file, seg_id, seg_id * 10 AS t0, seg_id * 10 + 10 AS t1, 'cY' AS key, q || ' ' || pk || ' 3' AS vals FROM seg
UNION ALL SELECT file, seg_id, seg_id * 10, seg_id * 10 + 10, 'sY', '1 0 ' || q FROM seg""")
def parse_grain_table(spark, sf):
    return _segments(spark, sf).withColumn("vals", F.array_join(F.transform("vals", lambda x: x.cast("string")), " "))


@query("donor_shape", f"""WITH {LINES} SELECT file, 'cY' AS key, CAST(round_even(median(q), 0) AS INT) || ' ' || CAST(round_even(median(pk), 0) AS INT) || ' 3' AS vals FROM seg GROUP BY file
UNION ALL SELECT file, 'sY', '1 0 ' || CAST(round_even(median(q), 0) AS INT) FROM seg GROUP BY file""")
def donor_shape(spark, sf):
    out = grain_op.donor_shape(_segments(spark, sf))
    return out.withColumn("vals", F.array_join(F.transform("vals", lambda x: x.cast("string")), " "))


@query("grain_segments")
def grain_segments(spark, sf):
    bins = v.bins(spark, sf)
    points = grain_op.scaling_curves(bins, grain_op.calibration(bins), k_key=["source_id"])
    bounds = bins.select("source_id", "shot_idx").distinct().select(
        "source_id", "shot_idx", (F.col("shot_idx") * 100).alias("f0"), (F.col("shot_idx") * 100 + 100).alias("f1"))
    zeros = F.array(*[F.lit(0)] * 24)
    shape = F.struct(zeros.alias("p"), zeros.alias("cY"), zeros.alias("cCb"), zeros.alias("cCr"))
    return grain_tables.grain_segments(points, bounds, shape, 24000 / 1001)
