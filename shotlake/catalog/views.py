"""The given tables read as the library's inputs: a DataFrame for the operators
and the same view as a SQL common table expression for the comparison."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.catalog import table
from shotlake.plans import ordered_scan, settle  # noqa: F401

DAY = 86400.0
ORDERS_YEAR = 365 * DAY


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def written(fn):
    """The view as a table, written once per session and data folder."""
    @functools.wraps(fn)
    def view(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _WRITTEN:
            _WRITTEN[key] = settle(fn(spark, sf))
        return _WRITTEN[key]

    return view


def _numbered(df: DataFrame, key: str, order: list[str], width: float, name: str, **extra) -> DataFrame:
    rows = ordered_scan(df.withColumn("_one", F.lit(1).cast("long")), [key], order, width=width,
                        running={name: ("sum", "_one")}, **extra)
    return rows.withColumn(name, F.col(name) - 1).drop("_one")


# frames: a user's events in time order
FRAMES = """frames AS (
  SELECT user_id AS source_id, row_number() OVER w - 1 AS frame_no, value AS mafd, event_type,
         greatest(0.0, least(value, value - lag(value, 1, value) OVER w)) AS scd_score
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@written
def frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(table(spark, sf, "events"), "user_id", ["ts", "event_id"], DAY, "frame_no", lag={"_prev": "value"})
    change = F.coalesce(F.col("value") - F.col("_prev"), F.lit(0.0))
    return rows.select(F.col("user_id").alias("source_id"), "frame_no", F.col("value").alias("mafd"), "event_type",
                       F.greatest(F.lit(0.0), F.least(F.col("value"), change)).alias("scd_score"))


# stamped frames: 25 per second, a slot left out before each frame of a very high value
STAMPED = FRAMES + """,
stamped AS (
  SELECT source_id, frame_no, (frame_no + count(*) FILTER (WHERE mafd >= 250) OVER (
    PARTITION BY source_id ORDER BY frame_no)) / 25.0 AS pts FROM frames)"""


@written
def stamped(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf).withColumn("_hole", (F.col("mafd") >= 250).cast("long"))
    rows = ordered_scan(rows, ["source_id"], ["frame_no"], width=1 << 16, running={"_holes": ("sum", "_hole")})
    return rows.select("source_id", "frame_no", ((F.col("frame_no") + F.col("_holes")) / 25.0).alias("pts"))


# shots: a customer's orders in date order, each 1 to 97 frames long
SHOTS = """lengths AS (
  SELECT o_custkey AS source_id, o_orderkey, 1 + o_orderkey % 97 AS frames,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS shot_idx FROM orders),
shots AS (
  SELECT source_id, o_orderkey, shot_idx, frames,
         CAST(sum(frames) OVER (PARTITION BY source_id ORDER BY shot_idx) - frames AS BIGINT) AS s0,
         CAST(sum(frames) OVER (PARTITION BY source_id ORDER BY shot_idx) AS BIGINT) AS s1 FROM lengths)"""


@written
def shot_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ORDERS_YEAR, "shot_idx")
    return rows.select(F.col("o_custkey").alias("source_id"), "o_orderkey", "shot_idx",
                       (1 + F.col("o_orderkey") % 97).alias("frames"))


@written
def shots(spark: SparkSession, sf: str) -> DataFrame:
    summed = ordered_scan(shot_lengths(spark, sf), ["source_id"], ["shot_idx"], width=1 << 14, running={"s1": ("sum", "frames")})
    return summed.select("source_id", "o_orderkey", "shot_idx", "frames", (F.col("s1") - F.col("frames")).alias("s0"), "s1")


# probes: per brand and size, the share of quantities at or over each setting
GRID = list(range(5, 55, 5))
PROBES = """probes AS (
  SELECT p_brand AS job_id, p_size AS shot_idx, x, 100.0 * count(*) FILTER (WHERE l_quantity >= x) / count(*) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT unnest(range(5, 55, 5)) AS x) GROUP BY p_brand, p_size, x)"""


@written
def probes(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_partkey", "l_quantity").join(
        table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    counted = items.groupBy(F.col("p_brand").alias("job_id"), F.col("p_size").alias("shot_idx")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("l_quantity") >= x).alias(f"n{x}") for x in GRID])
    points = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), (100.0 * F.col(f"n{x}") / F.col("n")).alias("score"))
                       for x in GRID])
    return counted.select("job_id", "shot_idx", F.inline(points))


# chosen settings: a customer's orders in date order
CHOSEN = """chosen AS (
  SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS shot_idx,
         CAST(20 + o_orderkey % 31 AS DOUBLE) AS x, o_orderkey % 31 = 0 AS pinned FROM orders)"""


@written
def chosen(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ORDERS_YEAR, "shot_idx")
    return rows.select(F.col("o_custkey").alias("job_id"), "shot_idx", (20 + F.col("o_orderkey") % 31).cast("double").alias("x"),
                       (F.col("o_orderkey") % 31 == 0).alias("pinned"))


# pairs: a supplier's lines in order
PAIR_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
PAIRS = """pairs AS (
  SELECT l_suppkey AS job_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
         l_quantity, l_extendedprice) - 1 AS seq, l_quantity AS q, ln(l_extendedprice) AS log_bpf,
         l_extendedprice / 1000 AS x_star FROM lineitem)"""


@written
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(table(spark, sf, "lineitem"), "l_suppkey", PAIR_ORDER, float(1 << 16), "seq")
    return rows.select(F.col("l_suppkey").alias("job_id"), "seq", F.col("l_quantity").alias("q"),
                       F.log("l_extendedprice").alias("log_bpf"), (F.col("l_extendedprice") / 1000).alias("x_star"))


# jobs: the order table
JOBS = """jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'src/' || o_custkey AS source,
         CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
         o_orderpriority AS preset, CASE WHEN o_orderkey % 3 = 0 THEN 'h264' ELSE 'hevc' END AS codec,
         epoch(o_orderdate) AS created_at, epoch(o_orderdate) + 60 AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) + 60 + o_orderkey % 5000 END AS finished_at,
         CAST(floor(o_totalprice) AS BIGINT) AS size_before,
         CAST(floor(o_totalprice * (30 + o_orderkey % 50) / 100) AS BIGINT) AS size_after,
         o_orderkey % 900 AS progress_done, 1000 AS progress_total, CAST(o_orderkey % 7 AS DOUBLE) AS progress_fps,
         CASE WHEN o_orderkey % 4 = 0 THEN 'probing' ELSE 'encoding' END AS stage FROM orders)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp").cast("double")
    return table(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("src/"), F.col("o_custkey").cast("string")).alias("source"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"),
        F.col("o_orderpriority").alias("preset"), F.when(k % 3 == 0, "h264").otherwise("hevc").alias("codec"),
        created.alias("created_at"), (created + 60).alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", created + 60 + k % 5000).alias("finished_at"),
        F.floor("o_totalprice").cast("long").alias("size_before"),
        F.floor(F.col("o_totalprice") * (30 + k % 50) / 100).cast("long").alias("size_after"),
        (k % 900).alias("progress_done"), F.lit(1000).cast("long").alias("progress_total"),
        (k % 7).cast("double").alias("progress_fps"), F.when(k % 4 == 0, "probing").otherwise("encoding").alias("stage"))


# bins: pixel residuals from lineitem, per return flag (title) and supplier (shot)
PIXELS = """pixels AS (
  SELECT l_returnflag AS source_id, l_suppkey AS shot_idx, CAST(l_quantity * 5 AS INT) AS level,
         CAST(floor(l_extendedprice / l_quantity - p_retailprice) AS BIGINT) % 1000 AS ry,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS rb, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS rr
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BIN_OF = """CASE WHEN level >= 224 THEN 224 WHEN level >= 192 THEN 192 WHEN level >= 160 THEN 160 WHEN level >= 128 THEN 128
  WHEN level >= 96 THEN 96 WHEN level >= 80 THEN 80 WHEN level >= 64 THEN 64 WHEN level >= 48 THEN 48
  WHEN level >= 32 THEN 32 WHEN level >= 16 THEN 16 ELSE 0 END"""
BIN_LIST = "(SELECT unnest([0, 16, 32, 48, 64, 80, 96, 128, 160, 192, 224]) AS bin_lo)"
SUMS = PIXELS + f""",
sums AS (
  SELECT source_id, shot_idx, {BIN_OF} AS bin_lo, CAST(sum(ry * ry) AS BIGINT) AS ssq_y, count(*) AS n_y,
         CAST(sum(rb * rb) AS BIGINT) AS ssq_cb, CAST(sum(rr * rr) AS BIGINT) AS ssq_cr, count(*) AS n_c
  FROM pixels GROUP BY ALL)"""
MIN_N = 5
BINS = SUMS + f""",
bins AS (
  SELECT source_id, shot_idx, bin_lo, 'y' AS channel, ssq_y AS sum_sq, n_y AS n, round(sqrt(ssq_y / n_y), 3) AS value FROM sums WHERE n_y >= {MIN_N}
  UNION ALL SELECT source_id, shot_idx, bin_lo, 'cb', ssq_cb, n_c, round(sqrt(ssq_cb / n_c), 3) FROM sums WHERE n_y >= {MIN_N}
  UNION ALL SELECT source_id, shot_idx, bin_lo, 'cr', ssq_cr, n_c, round(sqrt(ssq_cr / n_c), 3) FROM sums WHERE n_y >= {MIN_N})"""


def pixel_values(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_retailprice"),
                                              F.col("l_partkey") == F.col("p_partkey"))
    ry = F.floor(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")).cast("long") % 1000
    return items.select(
        F.col("l_returnflag").alias("source_id"), F.col("l_suppkey").alias("shot_idx"), (F.col("l_quantity") * 5).cast("int").alias("level"),
        F.floor(F.col("l_orderkey") / 4096).alias("tile"), ry.alias("ry"), F.floor(F.col("l_discount") * 100 + 0.5).alias("rb"), F.floor(F.col("l_tax") * 100 + 0.5).alias("rr"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    planes = F.array(*[F.struct(F.lit(p).alias("plane"), F.col(c).alias("residual")) for p, c in
                       (("y", "ry"), ("cb", "rb"), ("cr", "rr"))])
    return pixel_values(spark, sf).select("source_id", "shot_idx", "level", F.inline(planes))


@written
def bins(spark: SparkSession, sf: str) -> DataFrame:
    from shotlake.operators.grain import residual_by_bin, residual_sums

    return residual_by_bin(residual_sums(pixels(spark, sf)), MIN_N, MIN_N)


# cues: conversation turns laid end to end at 15 characters a second
CUES = """cues AS (
  SELECT conv_id AS track_id, turn AS cue_idx, role, text,
         (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)) / 15.0 AS start,
         sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) / 15.0 AS "end",
         CASE WHEN role = 'user' THEN 'primary' ELSE 'retry' END AS rung FROM conversations)"""


@written
def cues(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("_len", F.length("text").cast("long"))
    rows = ordered_scan(rows, ["conv_id"], ["turn"], width=1 << 14, running={"_sum": ("sum", "_len")})
    return rows.select(
        F.col("conv_id").alias("track_id"), F.col("turn").alias("cue_idx"), "role", "text",
        ((F.col("_sum") - F.col("_len")) / 15.0).alias("start"), (F.col("_sum") / 15.0).alias("end"),
        F.when(F.col("role") == "user", "primary").otherwise("retry").alias("rung"))


LEXICON = r"""lexicon AS (
  SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark))"""


@written
def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return table(spark, sf, "benchmark").select(words.alias("w")).select(
        F.lower("w").alias("word")).distinct()


# observations: a user's events as memory readings
OBS = """obs AS (
  SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type, ts,
         value, 40.0 AS predicted, value AS observed FROM events)"""


@written
def obs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered(table(spark, sf, "events"), "user_id", ["ts", "event_id"], DAY, "seq")
    return rows.select(F.col("user_id").alias("job_id"), "seq", "event_type", "ts", "value",
                       F.lit(40.0).alias("predicted"), F.col("value").alias("observed"))
