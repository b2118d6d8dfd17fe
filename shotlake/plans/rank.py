"""Ranks within keys of any size and shape: by rows, not by the width of values.

Rows are range-partitioned by key and order, so a key that holds a third of all rows, all of one value even, is spread
over as many partitions as its rows fill. A rank is the place within the partition plus the rows of the key in earlier
partitions, and those are sums over one row for each key and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlake.plans.lineage import settle


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """0-based rank of each row within its key, by `order`; rows that tie get different ranks. The rows are written."""
    keys = list(keys)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    spread = [*keys, *order, "_tie"]
    ranged = tied.repartitionByRange(partitions, *spread) if partitions else tied.repartitionByRange(*spread)
    # the id counts rows within a sorted partition from its number * 2^33 on
    placed = settle(ranged.sortWithinPartitions(*spread).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    placed = placed.withColumns({"_k": F.struct(*keys) if keys else F.lit(0), "_part": F.shiftright("_at", 33)})
    parts = placed.groupBy("_k", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_k", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(parts, ["_k", "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_k", "_part", "_at", "_shift")
