"""Frame, metric, progress and probe logs; the job table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake import schemas
from shotlake.functions.text import last_redraw, progress_stats
from shotlake.plans import ordered_scan
from shotlake.sources.lines import LINE_ORDER, read_lines, read_whole

# fixed values: the detector's metadata lines
FRAME_LINE = r"^frame:(\d+)(?:\s+pts:\S+\s+pts_time:(-?[\d.]+))?"
SCORE_LINE = r"^lavfi\.scd\.score=([\d.]+)"
MAFD_LINE = r"^lavfi\.scd\.mafd=([\d.]+)"


def parse_frame_log(lines: DataFrame, key: Sequence[str] = ("file",), order: Sequence[str] = LINE_ORDER,
                    width: float = 1.0) -> DataFrame:
    """Frame rows from metadata lines: a header names the frame, value lines below it belong to it."""
    def part(pattern: str, group: int) -> Column:
        # most lines have none of it, and a cast of '' fails by an exception, which takes longer than all else here
        return F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))

    number, pts = part(FRAME_LINE, 1).try_cast("long"), part(FRAME_LINE, 2).try_cast("double")
    read = lines.select(
        *key, *order, F.when(number.isNotNull(), F.struct(number.alias("frame_no"), pts.alias("pts"))).alias("_head"),
        part(SCORE_LINE, 1).try_cast("double").alias("_score"), part(MAFD_LINE, 1).try_cast("double").alias("_mafd"))
    held = ordered_scan(read, key, order, width=width, running={"_frame": ("last", "_head")})
    return held.filter(F.col("_frame").isNotNull()).groupBy(*key, F.col("_frame.frame_no").alias("frame_no")).agg(
        F.max("_frame.pts").alias("pts"), F.max("_score").alias("scd_score"), F.max("_mafd").alias("mafd"))


def read_frame_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_frame_log(read_lines(spark, path)).withColumnRenamed("file", "source_id")


def metric_score(body: Column, metric: str) -> Column:
    """struct(score, error) of one metric in a score log: the metric itself, else the
    only one pooled, else the aggregate; anything unreadable or not finite is an error."""
    log = F.from_json(body, schemas.METRIC_JSON, {"mode": "PERMISSIVE"})
    pooled = log["pooled_metrics"]
    n = F.coalesce(F.size(pooled), F.lit(0))
    named = F.try_element_at(pooled, F.lit(metric))["mean"]
    only = F.when(n == 1, F.try_element_at(F.map_values(pooled), F.lit(1))["mean"])
    text = F.coalesce(named, only, log["aggregateVMAF"])
    is_object = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    score = text.try_cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    error = (F.when(body.isNull() | F.try_parse_json(body).isNull(), "unreadable")
             .when(~F.coalesce(is_object, F.lit(False)), "not a score log")
             .when(text.isNull() & (n > 0), F.concat(F.lit("no such metric; found "), F.array_join(F.sort_array(F.map_keys(pooled)), ", ")))
             .when(text.isNull(), "no score").when(~finite, "not a finite number"))
    return F.struct(F.when(error.isNull(), score).alias("score"), error.alias("error"))


def read_metric_logs(spark: SparkSession, path: str, metric: str) -> DataFrame:
    return read_whole(spark, path).withColumn("_m", metric_score(F.col("body"), metric)).select("path", "_m.score", "_m.error")


def parse_progress(lines: DataFrame, text: str = "text") -> DataFrame:
    """Progress bars of log lines: the last redraw of each line, escapes removed."""
    return lines.withColumn("_p", progress_stats(last_redraw(F.col(text)))).filter("_p IS NOT NULL").select(
        *[c for c in lines.columns if c != text], "_p.*")


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    # redraws end in a carriage return, not a newline: only \n separates lines here
    return parse_progress(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("text")))


def score_every_nth(ref: DataFrame, dist: DataFrame, step: int, key: Sequence[str] = ("job_id",)) -> DataFrame:
    """Mean score over every step-th frame of what both sides have."""
    both = ref.select(*key, "frame_no").join(dist.select(*key, "frame_no", "score"), [*key, "frame_no"])
    return both.filter(F.pmod("frame_no", F.lit(max(1, step))) == 0).groupBy(*key).agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.avg("score"), 6).alias("score"))


def read_score_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("job_id string, frame_no long, score double").json(path)


# --- probe dataset ---------------------------------------------------------------

def write_probe_dataset(rows: DataFrame, path: str) -> None:
    """Append records (any of the three types) as JSON lines; empty fields are left out."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_probe_dataset(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(schemas.PROBE_LOG).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def dataset_probes(log: DataFrame) -> DataFrame:
    """Long probe rows from the shot records: both encoders' curves, exploded."""
    shots = log.filter(F.col("type") == "shot")

    def side(curve: str, encoder: str, cost: str | None) -> DataFrame:
        rows = shots.select(F.col("job").alias("job_id"), F.col("idx").alias("shot_idx"), F.lit(encoder).alias("encoder"),
                            *([F.col(cost).alias("_cost")] if cost else []), F.explode(curve).alias("_x", "score"))
        bytes_per_frame = F.try_element_at("_cost", F.col("_x")) if cost else F.lit(None).cast("double")
        return rows.select("job_id", "shot_idx", "encoder", F.col("_x").try_cast("int").alias("x"), "score",
                           bytes_per_frame.alias("bytes_per_frame"))

    return side("svt", "svt", None).unionByName(side("qsv", "qsv", "qsv_bpf"))


def shot_records(shots: DataFrame, probes: DataFrame, target: float, total: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Shot records of the probe dataset: geometry, both curves and where they cross the target.

    shots (job_id, shot_idx, s0, s1, w0, w1), probes (with encoder), total (job_id, n_frames). Probes with
    bytes_per_frame also give the second curve's costs (`qsv_bpf`), `seeds` (job_id, shot_idx, seed) the predicted
    setting the probing started from; shots without either leave the field out.
    """
    from shotlake.operators.curves import crossing

    key = ["job_id", "shot_idx"]

    def curve(encoder: str, name: str, star: str) -> DataFrame:
        rows = probes.filter((F.col("encoder") == encoder) & F.col("score").isNotNull())
        once = rows.groupBy(*key, "x").agg(F.max("score").alias("score"))
        # settings of one curve: as many as the grid has
        packed = once.groupBy(*key).agg(F.map_from_entries(F.transform(
            F.sort_array(F.collect_list(F.struct("x", "score"))),
            lambda p: F.struct(p["x"].cast("string"), p["score"]))).alias(name))
        return packed.join(crossing(rows, target, key).withColumnRenamed("x_star", star), key)

    rows = shots.join(total, "job_id").join(curve("svt", "svt", "crf_star"), key, "left").join(
        curve("qsv", "qsv", "q_star"), key, "left")
    more = []
    if "bytes_per_frame" in probes.columns:
        costs = probes.filter((F.col("encoder") == "qsv") & F.col("bytes_per_frame").isNotNull()).groupBy(*key, "x").agg(F.max("bytes_per_frame").alias("c"))
        costs = costs.groupBy(*key).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("x", "c"))), lambda p: F.struct(
            p["x"].cast("string"), p["c"].cast("double")))).alias("qsv_bpf"))
        rows, more = rows.join(costs, key, "left"), [*more, "qsv_bpf"]
    if seeds is not None:
        rows, more = rows.join(seeds.select(*key, F.col("seed").cast("double").alias("seed")), key, "left"), [*more, "seed"]
    return rows.select(
        F.lit("shot").alias("type"), F.col("job_id").alias("job"), F.col("shot_idx").alias("idx"), "s0", "s1",
        (F.col("s1") - F.col("s0")).alias("frames"), F.bround(F.col("s0") / F.greatest("n_frames", F.lit(1)), 5).alias("pos"),
        "w0", "w1", (F.col("w1") - F.col("w0")).alias("window"),
        ((F.col("w1") - F.col("w0")) >= (F.col("s1") - F.col("s0"))).alias("whole_shot"), "svt", "crf_star", "qsv", "q_star", *more)


JOB_FIELDS = ("source string, width int, height int, fps double, duration double, src_bitrate long, codec string, metric string, target double, preset int, "
              "probe_preset int, probing_rate int, probe_max_frames int, probe_grid array<int>, probe_encoder string, probe_scale string, pix_fmt string")


def job_records(jobs: DataFrame, shots: DataFrame) -> DataFrame:
    """The record that heads a title's part of the probe dataset: what was probed and how (columns of JOB_FIELDS, absent
    ones are left out), and the number of shots and their frames."""
    kinds = dict(f.split(" ", 1) for f in JOB_FIELDS.split(", "))
    known = [F.col(c).cast(t).alias(c) for c, t in kinds.items() if c in jobs.columns]
    sizes = shots.groupBy("job_id").agg(F.count(F.lit(1)).alias("shots"), F.sum(F.col("s1") - F.col("s0")).cast("long").alias("frames"))
    rows = jobs.select("job_id", *known).join(sizes, "job_id", "left")
    return rows.select(F.lit("job").alias("type"), F.col("job_id").alias("job"), *[F.col(c) for c in kinds if c in jobs.columns],
                       F.coalesce("shots", F.lit(0).cast("long")).alias("shots"), F.coalesce("frames", F.lit(0).cast("long")).alias("frames"))


def crfs_records(chosen: DataFrame) -> DataFrame:
    """The record that closes a title: the setting each shot was encoded at. One line a title, as the format has it."""
    settings = F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("shot_idx", F.col("x").cast("double").alias("x")))),
                                              lambda p: F.struct(p["shot_idx"].cast("string"), p["x"])))
    return chosen.filter("x IS NOT NULL").groupBy(F.col("job_id").alias("job")).agg(settings.alias("final")).select(F.lit("crfs").alias("type"), "job", "final")


def dataset_settings(log: DataFrame) -> DataFrame:
    """(job_id, shot_idx, x) of the closing records; a title written twice gives its rows twice."""
    rows = log.filter(F.col("type") == "crfs").select(F.col("job").alias("job_id"), F.explode(F.coalesce("final", "crfs")).alias("_i", "x"))
    return rows.select("job_id", F.col("_i").try_cast("long").alias("shot_idx"), "x")


# --- job table -------------------------------------------------------------------

def parse_jobs(jobs: DataFrame) -> DataFrame:
    """The job table with its JSON columns read leniently (text that does not parse
    stays readable beside it) and its epoch seconds also as timestamps."""
    def parsed(c: str) -> Column:
        return F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})

    out = jobs.withColumn("meta_map", parsed("meta")).withColumn("params_map", parsed("params"))
    for c in ("created", "started", "finished", "finalized"):
        out = out.withColumn(f"{c}_ts", F.timestamp_seconds(f"{c}_at"))
    return out


def read_job_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_jobs(spark.read.schema(schemas.JOBS).parquet(path))


def write_job_events(events: DataFrame, path: str) -> None:
    """Append events, one directory per day so that readers prune."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def tail_log(spark: SparkSession, directory: str) -> DataFrame:
    """Lines appended to a rotated log directory, as a stream; the checkpoint keeps the position."""
    return (spark.readStream.format("text").option("latestFirst", "false").load(directory)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_modification_time").alias("file_time")))
