"""Exact quantiles of keys of any size.

The built-in exact percentile keeps every distinct value of a key in one
buffer. Here the values of a key of up to `most` rows are ordered in a window,
after one shuffle by key. In larger keys equal values are counted first (a
partial aggregate keyed by (key, value)), a histogram of at most `buckets` rows
per key finds the bucket each wanted rank falls into, and only those buckets
are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.plans.ordered import ROWS, WHOLE, counted_keys, dealt

BUCKETS = 1024


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float],
                   kind: str = "linear", buckets: int = BUCKETS, most: int = WHOLE, each: int = ROWS) -> DataFrame:
    """One row per key with the asked quantiles; NULL values are ignored.

    Tasks get about `each` rows of whole keys.
    kind "linear" interpolates between the two neighbouring ranks (the usual
    median averages them); "upper" takes the value at index floor(n * p).
    """
    names = list(keys)
    # as a struct, keys that are NULL keep their rows in the joins
    key = F.struct(*names) if names else F.lit(0)
    rows = df.filter(F.col(value).isNotNull()).select(*names, F.col(value).cast("double").alias("_v"))
    large, n = counted_keys(rows, names, most)
    if large is None:
        return _whole(dealt(rows, names, n, each), names, wanted, kind)
    rows, large = rows.withColumn("_key", key), F.broadcast(large)
    some = _ranged(rows.join(large, "_key", "left_semi").withColumnRenamed("_key", "_k"), names, wanted, kind, buckets)
    return _whole(dealt(rows.join(large, "_key", "left_anti"), names, n, each), names, wanted, kind).unionByName(some)


def _whole(rows: DataFrame, names: list[str], wanted: Mapping[str, float], kind: str) -> DataFrame:
    """Quantiles of keys that one task can order."""
    # without names all rows are one key
    keys = names or ["_all"]
    rows = rows.select(*names, *([] if names else [F.lit(0).alias("_all")]), "_v")
    key = Window.partitionBy(*keys)
    placed = rows.withColumns({"_at": F.row_number().over(key.orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(key)})
    hit, out = F.lit(False), []
    for name, p in wanted.items():
        low, high = _ranks(p, F.col("_n"), kind)
        hit = hit | (F.col("_at") == low) | (F.col("_at") == high)
        at_low, at_high = (F.max(F.when(F.col("_at") == rank, F.col("_v"))) for rank in (low, high))
        out.append((at_low + (at_high - at_low) * F.max(_rank(p, F.col("_n"), kind) - low)).alias(name))
    return placed.filter(hit).groupBy(*keys).agg(*out).select(*names, *wanted)


def _ranged(df: DataFrame, names: list[str], wanted: Mapping[str, float], kind: str, buckets: int) -> DataFrame:
    """Quantiles of the keys `_k` of any size."""
    keys = ["_k"]
    counts = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    scaled = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)
    binned = counts.join(span, keys).withColumn(
        "_b", F.when(F.col("_hi") > F.col("_lo"), F.least(scaled, F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int"))

    hist = binned.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_bn"))
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # rows of lower buckets, then keep the buckets that hold a wanted rank
    hist = hist.withColumn("_below", F.coalesce(F.sum("_bc").over(up), F.lit(0)))
    hit = F.lit(False)
    for p in wanted.values():
        for rank in _ranks(p, F.col("_bn"), kind):
            hit = hit | ((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_bc")))
    hits = hist.filter(hit).select(*keys, "_b", "_below")

    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = (binned.join(hits, [*keys, "_b"])
              .withColumn("_from", F.col("_below") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
              .withColumn("_to", F.col("_from") + F.col("_c")))
    out = []
    for name, p in wanted.items():
        low, high = _ranks(p, F.col("_n"), kind)
        at_low = F.max(F.when((low >= F.col("_from")) & (low < F.col("_to")), F.col("_v")))
        at_high = F.max(F.when((high >= F.col("_from")) & (high < F.col("_to")), F.col("_v")))
        share = F.max(_rank(p, F.col("_n"), kind) - low)
        out.append((at_low + (at_high - at_low) * share).alias(name))
    result = placed.groupBy(*keys).agg(*out)
    return result.select(*[F.col("_k")[k].alias(k) for k in names], *wanted)


def _rank(p: float, n: Column, kind: str) -> Column:
    return F.floor(n * F.lit(p)) if kind == "upper" else (n - 1) * F.lit(float(p))


def _ranks(p: float, n: Column, kind: str) -> tuple[Column, Column]:
    rank = _rank(p, n, kind)
    return F.floor(rank), F.ceil(rank)
