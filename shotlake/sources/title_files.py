"""One text file a title: a writer whose tasks write beside the target and whose commit moves what succeeded in place.

    spark.dataSource.register(TitleFiles)
    rows.write.format("title_files").option("path", folder).option("suffix", ".srt").mode("append").save()

Rows are (name, text), those of a name together and in order. A task streams each name into a file of its own attempt
under `_attempts`; only the attempts whose task succeeded are moved to `<name><suffix>` when the job commits, and an
abort removes them, so readers see whole files or none. Names are percent-encoded where a file name can't hold them.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, text string"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class TitleWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.suffix, self.overwrite = options.get("suffix", ""), overwrite
        self.job = os.path.join(self.path, "_attempts", uuid.uuid4().hex)

    def write(self, rows: Iterator) -> Written:
        context = TaskContext.get()
        folder = os.path.join(self.job, f"{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(folder, exist_ok=True)
        names, out, now, met = [], None, None, set()
        try:
            for row in rows:
                if row["name"] != now or out is None:
                    if out:
                        out.close()
                    now = row["name"]
                    names.append(quote(now if now is not None else "_null", safe=" ()[]+,='@") + self.suffix)
                    if names[-1] in met:
                        raise ValueError(f"rows of {now!r} do not lie together")
                    met.add(names[-1])
                    out = open(os.path.join(folder, names[-1]), "wb")
                out.write((row["text"] or "").encode())
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: Sequence[Written | None]) -> None:
        done = [m for m in messages if m]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("a title was written by two tasks")
        if self.overwrite:
            for old in os.listdir(self.path):
                if old not in ("_attempts", *every) and os.path.isfile(os.path.join(self.path, old)) and old.endswith(self.suffix):
                    os.remove(os.path.join(self.path, old))
        for m in done:
            for n in m.names:
                os.replace(os.path.join(m.folder, n), os.path.join(self.path, n))
        self._clear()

    def abort(self, messages: Sequence[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.job, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.job))
        except OSError:
            pass


class TitleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "title_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TitleWriter:
        return TitleWriter(dict(self.options), overwrite)


def write_titles(rows: DataFrame, path: str, name: Column, order: Sequence[str], text: Column, suffix: str = "", mode: str = "append") -> None:
    """Write the texts of each name, in order, as the file `<path>/<name><suffix>`. A file is a sequence, so a task
    writes it alone, row by row; titles are spread over tasks."""
    spark = rows.sparkSession
    spark.dataSource.register(TitleFiles)
    dealt = rows.select(name.cast("string").alias("name"), text.alias("text"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    ranks = [f"_o{i}" for i in range(len(order))]
    (dealt.repartition("name").sortWithinPartitions("name", *ranks).select("name", "text")
     .write.format("title_files").option("path", path).option("suffix", suffix).mode(mode).save())
