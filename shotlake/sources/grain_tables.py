"""Film-grain tables: text in, text out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.plans import ordered_scan
from shotlake.plans.ordered import ROWS
from shotlake.sources.lines import LINE_ORDER, read_lines
from shotlake.sources.title_files import write_titles

TICKS_PER_SECOND = 1e7
HEADER = "filmgrn1"
CHANNEL_KEY = {"y": "sY", "cb": "sCb", "cr": "sCr"}


def parse_grain_table(lines: DataFrame, key: Sequence[str] = ("file",), order: Sequence[str] = LINE_ORDER,
                      width: float = 1.0) -> DataFrame:
    """Segments: an E line opens one, the key lines below it belong to it."""
    toks = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    rows = lines.select(*key, *order, toks.alias("_t")).filter(F.size("_t") > 0)
    opens = F.element_at("_t", 1) == "E"
    # numbers are shuffled, not texts; lines compress well, so tasks are filled by rows
    rows = rows.select(
        *key, *order, opens.cast("long").alias("_e"),
        F.when(opens, F.struct(F.try_element_at("_t", F.lit(2)).try_cast("long").alias("t0"),
                               F.try_element_at("_t", F.lit(3)).try_cast("long").alias("t1"))).alias("_times"),
        F.when(~opens, F.element_at("_t", 1)).alias("key"),
        F.when(~opens, F.transform(F.slice("_t", 2, F.size("_t")), lambda v: v.try_cast("int"))).alias("vals"))
    held = ordered_scan(rows, key, order, width=width, running={"_n": ("sum", "_e"), "_in": ("last", "_times")}, each=ROWS)
    return held.filter((F.col("_n") > 0) & (F.col("_e") == 0)).select(
        *key, (F.col("_n") - 1).alias("seg_id"), F.col("_in.t0").alias("t0"), F.col("_in.t1").alias("t1"), "key", "vals")


def read_grain_tables(spark: SparkSession, path: str) -> DataFrame:
    return parse_grain_table(read_lines(spark, path))


def grain_segments(points: DataFrame, bounds: DataFrame, shape: Column, fps: float,
                   key: Sequence[str] = ("source_id", "shot_idx")) -> DataFrame:
    """One text record per shot: times from frame bounds [f0, f1), scaling points per
    channel, then the donor's coefficient lines. `shape` is struct(p, cY, cCb, cCr) of arrays."""
    # a curve has 14 points at most
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y"))),
                                    lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), " ")
    curves = points.groupBy(*key, "channel").agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), text).alias("_line"))
    shots = curves.groupBy(*key).agg(*[
        F.max(F.when(F.col("channel") == c, F.col("_line"))).alias(k) for c, k in CHANNEL_KEY.items()])
    rows = shots.join(bounds, [*key]).withColumn("_s", shape)
    ticks = F.lit(TICKS_PER_SECOND / fps)

    def vector(name: str) -> Column:
        return F.array_join(F.transform(F.col("_s")[name], lambda v: v.cast("string")), " ")

    seed = F.pmod(F.xxhash64(*key), F.lit(65534)) + 1
    record = F.concat(
        F.format_string("E %d %d 1 %d 1\n", F.bround(F.col("f0") * ticks).cast("long"), F.bround(F.col("f1") * ticks).cast("long"), seed),
        F.lit("\tp "), vector("p"), *[x for k in CHANNEL_KEY.values() for x in (F.lit(f"\n\t{k} "), F.col(k))],
        *[x for k in ("cY", "cCb", "cCr") for x in (F.lit(f"\n\t{k} "), vector(k))])
    return rows.select(*key, "f0", record.alias("record"))


def write_grain_table(segments: DataFrame, path: str, title: str = "source_id") -> None:
    """Write records, one directory per title: files and lines in frame order, the
    header as the title's first line."""
    head = segments.select(title, F.lit(-1).cast("long").alias("f0"), F.lit(HEADER).alias("record")).distinct()
    rows = segments.select(title, F.col("f0").cast("long").alias("f0"), "record").unionByName(head)
    (rows.repartitionByRange(title, "f0").sortWithinPartitions(title, "f0")
     .select(title, F.col("record").alias("value")).write.mode("overwrite").partitionBy(title).text(path))


def write_grain_files(segments: DataFrame, path: str, title: str = "source_id", mode: str = "append") -> None:
    """One grain table a title, `<path>/<title>.tbl`: the header, then the records in frame order."""
    head = segments.select(title, F.lit(HEADER).alias("record")).distinct().withColumn("f0", F.lit(None).cast("long"))
    rows = segments.select(title, F.col("f0").cast("long").alias("f0"), "record").unionByName(head)
    write_titles(rows, path, F.col(title), ["f0"], F.concat("record", F.lit("\n")), ".tbl", mode)
