"""Streams over the given tables, run to their end; each ends where its batch twin does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.catalog import ORACLES, devices, fits, jobs, query, r6  # noqa: F401
from shotlake.catalog import views as v
from shotlake.plans.lineage import shared_folder
from shotlake.session import ROCKSDB
from shotlake.streaming import processors as op
from shotlake.streaming.refit import OnlineRefit, latest_fits, stream_refit as refits


def _stream(table: DataFrame) -> DataFrame:
    """A written view as a stream of its files."""
    spark = table.sparkSession
    return spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])


def _run(out: DataFrame) -> DataFrame:
    """Run a stream over what is there; every batch is written as its own part."""
    spark = out.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    (out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).foreachBatch(keep).start().awaitTermination())
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{folder}/out")


@v.written
def _job_events(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in devices.JOB_EVENTS.items() for x in kv])
    event = F.when(F.col("value") < 3, "cancel").when(F.col("value") > 200, "restart").otherwise(F.try_element_at(names, F.col("event_type")))
    # the sequence as a clock, so that ties in time keep their order
    return v.obs(spark, sf).select("job_id", event.alias("event"), F.timestamp_seconds("seq").alias("ts")).withColumn(
        "job_id", F.col("job_id").cast("string"))


@query("stream_job_state")
def stream_job_state(spark, sf):
    rows = _run(op.stream_job_state(_stream(_job_events(spark, sf))))
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("n_events", "status", "stage", "retries"), "n_events").alias("s"))
    return last.select(F.col("job_id").cast("long").alias("job_id"), "s.*")


ORACLES["stream_job_state"] = ORACLES["job_state"]


@v.written
def _readings(spark, sf):
    return v.obs(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), "seq", "predicted", "observed",
                                   F.col("observed").alias("measured"), F.col("predicted").alias("booked"))


@query("stream_correction")
def stream_correction(spark, sf):
    rows = _run(op.stream_correction(_stream(_readings(spark, sf))))
    last = rows.groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.max_by(F.struct("samples", "factor"), "samples").alias("s"))
    return last.select("job_id", "s.samples", r6("s.factor").alias("factor"))


ORACLES["stream_correction"] = ORACLES["correction_factor"]


@query("stream_peak_ratio")
def stream_peak_ratio(spark, sf):
    rows = _run(op.stream_peak_ratio(_stream(_readings(spark, sf))))
    last = rows.groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.max_by(F.struct("samples", "worst", "ratio"), "samples").alias("s"))
    return last.select("job_id", "s.samples", r6("s.worst").alias("worst"), r6("s.ratio").alias("ratio"))


ORACLES["stream_peak_ratio"] = ORACLES["decayed_peak_ratio"]


@v.written
def _progress_lines(spark, sf):
    return devices._lines(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), F.timestamp_seconds("pos").alias("ts"), "text")


@query("stream_progress", ORACLES["progress_track"].rsplit("SELECT job_id, pos", 1)[0]
    + "SELECT job_id, pos, stage, CAST(pct AS DOUBLE) AS pct, CAST(done AS BIGINT) AS done FROM g WHERE pct > coalesce(top, -1)")
def stream_progress(spark, sf):
    rows = _run(op.stream_progress(_stream(_progress_lines(spark, sf)), live=False)).filter("pct IS NOT NULL")
    return rows.select(F.col("job_id").cast("long").alias("job_id"), F.col("at").cast("long").alias("pos"), "stage", "pct", "done")


@v.written
def _device_events(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in devices.KINDS.items() for x in kv])
    t = F.col("ts").cast("timestamp").cast("double")
    return v.obs(spark, sf).select(F.col("job_id").cast("string").alias("device"), t.alias("ts"),
                                   F.try_element_at(kinds, F.col("event_type")).alias("kind"), (t - F.col("value")).alias("started"))


@query("stream_device_health", ORACLES["device_health"].replace("now AS (SELECT max(t) + 30 AS now FROM ev),", "now AS (SELECT device, max(t) AS now FROM ev GROUP BY device),")
       .replace("FROM told, now)", "FROM told JOIN now USING (device))").rsplit("SELECT device, state, state = 'ok'", 1)[0] + "SELECT device, state FROM judged")
def stream_device_health(spark, sf):
    rows = _run(op.stream_device_health(_stream(_device_events(spark, sf)), live=False))
    return rows.groupBy(F.col("device").cast("long").alias("device")).agg(F.max_by("state", "at").alias("state"))


@v.written
def _observations(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return v.obs(spark, sf).select(
        F.col("job_id").cast("string").alias("path"), F.floor(F.col("value") / 40).cast("long").alias("size"), ts.alias("scan_ts"),
        F.timestamp_seconds(F.floor((ts.cast("double") - F.col("value") * 60) / 86400) * 86400).alias("mtime"))


@query("stream_new_files", ORACLES["settled_files"])
def stream_new_files(spark, sf):
    rows = _run(op.stream_new_files(_stream(_observations(spark, sf)), 3600.0, 1))
    return rows.select(F.col("path").cast("long").alias("path"), F.round(F.col("accepted_at") * 1000).cast("long").alias("accepted_ms"), "size")


@v.written
def _outcomes(spark, sf):
    outcome = F.when(F.col("event_type") == "view", "test_ok").when(F.col("value") < 40, "fail").otherwise("ok")
    return v.obs(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), F.lit("gpu0").alias("device"),
                                   F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"))


@query("stream_circuit_breaker")
def stream_circuit_breaker(spark, sf):
    rows = _run(op.stream_circuit_breaker(_stream(_outcomes(spark, sf)), 3, live=False))
    return rows.groupBy("job_id", "device").agg(F.count(F.lit(1)).alias("changes"), F.max_by("status", "at").alias("status"))


@v.written
def _pairs(spark, sf):
    return v.pairs(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), "seq", "q", "log_bpf", "x_star")


@query("online_refit", ORACLES["ols_trimmed"])
def online_refit(spark, sf):
    # with everything in one batch the latest fit is the batch fit
    folder = f"{shared_folder(spark)}/refit-{uuid.uuid4().hex}"
    refit = OnlineRefit(f"{folder}/pairs", f"{folder}/fits", 10.0)
    (_stream(_pairs(spark, sf)).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
     .foreachBatch(refit).start().awaitTermination())
    fit = latest_fits(spark, f"{folder}/fits")
    return fit.select(F.col("job_id").cast("long").alias("job_id"), "n", *[F.round(c, 5).alias(c) for c in ("b0", "bq", "bl", "sd")])


@query("stream_refit", f"""WITH {v.PAIRS}, c AS (SELECT CAST(job_id AS VARCHAR) AS job_id, count(*) AS n FROM pairs GROUP BY job_id),
p AS (SELECT job_id, unnest(range(12, n + 1, 10)) AS pairs FROM c) SELECT CAST(job_id AS BIGINT) AS job_id, pairs FROM p""")
def stream_refit(spark, sf):
    """No fit of these pairs is worth following, so a job is refitted at its twelfth pair and after every ten."""
    return _run(refits(_stream(_pairs(spark, sf)), 0.001)).select(F.col("job_id").cast("long").alias("job_id"), "pairs")
