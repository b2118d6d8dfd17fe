"""Image-subtitle segments and .srt files."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.operators.subtitles import srt_blocks
from shotlake.sources.title_files import write_titles

# fixed values: segment types and the header layout (magic, pts, dts, type, size)
COMPOSITION, END = 0x16, 0x80
_HEADER = ">2sIIBH"
_HEADER_SIZE = struct.calcsize(_HEADER)
# segments and bytes after which a frame of them is handed on
FRAME_ROWS, FRAME_BYTES = 1 << 14, 1 << 24


def walk_segments(buf: bytes) -> tuple[list[tuple[int, int, int, bytes]], str | None]:
    """(offset, pts, type, payload) of a stream, and what stopped the walk early.
    A lost sync or a cut payload makes the whole stream an error."""
    off, out = 0, []
    while off < len(buf):
        if off + _HEADER_SIZE > len(buf):
            return [], f"short header at {off}"
        magic, pts, _, kind, size = struct.unpack_from(_HEADER, buf, off)
        if magic != b"PG":
            return [], f"lost sync at {off}"
        end = off + _HEADER_SIZE + size
        if end > len(buf):
            return [], f"truncated payload at {off}"
        out.append((off, pts, kind, buf[off + _HEADER_SIZE:end]))
        off = end
    return out, None


SEGMENTS = "path string, offset long, pts long, type int, payload binary, error string"


def sup_segments(files: DataFrame) -> DataFrame:
    """Segments of binary subtitle files (path, content), files in parallel; a file
    that cannot be read gives one row with its error."""
    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["path", "offset", "pts", "type", "payload", "error"])
        return out.astype({"offset": "Int64", "pts": "Int64", "type": "Int32"})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # short files together, a frame for many of them
            rows, size = [], 0
            for path, content in zip(pdf["path"], pdf["content"]):
                segs, error = walk_segments(bytes(content))
                rows += [(path, *s, None) for s in segs] or [(path, None, None, None, None, error or "empty file")]
                size += len(content)
                if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    return files.select("path", "content").mapInPandas(walk, SEGMENTS)


def read_sup(spark: SparkSession, path: str) -> DataFrame:
    return sup_segments(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def display_sets(segments: DataFrame) -> DataFrame:
    """Ends of display sets (track_id, seq, pts, kind): compose when the set's
    composition puts objects on the screen, erase when it has none."""
    from shotlake.plans import ordered_scan

    # the eleventh payload byte of a composition counts its objects
    objects = F.conv(F.hex(F.substring("payload", 11, 1)), 16, 10).try_cast("int")
    rows = segments.filter("error IS NULL").select(
        F.col("path").alias("track_id"), F.col("offset").alias("seq"), "pts", "type",
        F.when(F.col("type") == COMPOSITION, objects).alias("_objects"))
    held = ordered_scan(rows, ["track_id"], ["seq"], width=1 << 22, running={"_open": ("last", "_objects")})
    return held.filter((F.col("type") == END) & F.col("_open").isNotNull()).select(
        "track_id", "seq", "pts", F.when(F.col("_open") > 0, "compose").otherwise("erase").alias("kind"))


def write_srt(cues: DataFrame, path: str, key: Sequence[str] = ("track_id",)) -> None:
    """One directory per track, its files and blocks in cue order. Rows are ranged
    over (track, number), so a long track is written by several tasks."""
    blocks = srt_blocks(cues, key)
    (blocks.repartitionByRange(*key, "n").sortWithinPartitions(*key, "n")
     .select(*key, F.col("block").alias("value")).write.mode("overwrite").partitionBy(*key).text(path))


def write_srt_files(cues: DataFrame, path: str, key: str = "track_id", mode: str = "append") -> None:
    """One `<path>/<track>.srt` a track, whole or not at all."""
    blocks = srt_blocks(cues, [key])
    write_titles(blocks, path, F.col(key), ["n"], F.concat("block", F.lit("\n")), ".srt", mode)
