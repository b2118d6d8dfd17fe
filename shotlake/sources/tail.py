"""A growing log as a stream: complete lines from a byte position on, over rotation and truncation.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("path", "/var/log/app.log").load()

An offset names each file by identity (its inode and a checksum of its first line) and says how far its complete lines
have been read. A rotated file keeps its identity under its new name, so its last lines are read before those of the
new one; a file under a known name with a new identity, or one that has shrunk, is read from its start. A copy of a
rotated log (same first line, other inode) is not read again. What follows the last line end waits for the next batch.

Options: path (a file, or a glob of several logs), rotated (glob of names it may be moved to, default path + ".*"),
from (`end`, the default, reads what is appended from now on; `start` all there is), block (bytes to a task, 8 MiB).
Files must be reachable by that path from the driver and from executors; a missing one is looked for again at the next
batch, bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, file_id string, pos long, line string"
FIRST_LINE = 256
BACK = 1 << 16


class Stretch(InputPartition):
    """Lines of one file that begin in [start, end)."""

    def __init__(self, path: str, file_id: str, start: int, end: int, first: bool, name: str):
        self.path, self.file_id, self.start, self.end, self.first, self.name = path, file_id, start, end, first, name


def identity(path: str) -> str | None:
    """Inode and checksum of the first line; None for a file without a complete line."""
    with open(path, "rb") as f:
        head = f.read(FIRST_LINE)
        end = head.find(b"\n")
        if end < 0 and len(head) < FIRST_LINE:
            return None
        return f"{os.fstat(f.fileno()).st_ino}:{zlib.crc32(head[:end] if end >= 0 else head)}"


def complete(path: str) -> int:
    """Where the last complete line ends."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - BACK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.rotated = options.get("rotated", self.path + ".*").removeprefix("file://")
        self.start, self.block = options.get("from", "end"), int(options.get("block", 8 << 20))

    def _files(self) -> dict[str, list]:
        """{identity: [path, end of complete lines, whether it is a log's own name]}"""
        out: dict[str, list] = {}
        own = set(glob.glob(self.path))
        for path in sorted(own) + sorted(set(glob.glob(self.rotated)) - own):
            try:
                if os.path.isfile(path) and not path.endswith((".gz", ".xz", ".bz2", ".zst", ".crc")) and (name := identity(path)):
                    out.setdefault(name, [path, complete(path), path in own])
            except OSError:
                continue
        return out

    def initialOffset(self) -> dict:
        return {"files": self._files() if self.start == "end" else {}, "begun": self.start == "end"}

    def latestOffset(self) -> dict:
        return {"files": self._files(), "begun": True}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        known, out = start["files"], []
        seen = {i.split(":")[1] for i in known}
        # moved files first, so that older lines come before newer ones
        for file_id, (path, to, own) in sorted(end["files"].items(), key=lambda f: (f[1][2], f[1][0])):
            at = 0
            if file_id in known:
                at = known[file_id][1] if known[file_id][1] <= to else 0
            elif not own and start["begun"] and file_id.split(":")[1] in seen:
                continue
            for a in range(at, to, self.block):
                out.append(Stretch(path, file_id, a, min(to, a + self.block), a == at, path))
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        path = part.path
        if not self._is(path, part.file_id):
            # moved since the offset was taken
            path = next((p for p in glob.glob(self.rotated) + glob.glob(self.path) if self._is(p, part.file_id)), None)
            if path is None:
                return
        with open(path, "rb") as f:
            at = f.seek(part.start if part.first else part.start - 1)
            if not part.first:
                # the line that a block begins in belongs to the block before
                at += len(f.readline())
            while at < part.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield part.name, part.file_id, at, line[:-1].decode("utf-8", "replace")
                at += len(line)

    @staticmethod
    def _is(path: str, file_id: str) -> bool:
        try:
            return identity(path) == file_id
        except OSError:
            return False

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(dict(self.options))


def follow_log(spark: SparkSession, path: str, start: str = "end", **options: str) -> DataFrame:
    """file, file_id, pos, line: lines appended to a log, each once and only when complete; the checkpoint keeps the position."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("from", start).options(**options).load()
