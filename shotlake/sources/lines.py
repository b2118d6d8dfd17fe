"""Text files as ordered lines, split over as many tasks as the file has blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# order of a line within its file: the block it lies in, then its place in the read
LINE_ORDER = ["_block", "_line"]


def read_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, _block, _line, text. A large file is read in blocks; (_block, _line)
    orders its lines without gathering the file anywhere."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("text"))


def read_whole(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, body: small documents (a probe result, a metric log), one file per row."""
    return spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
