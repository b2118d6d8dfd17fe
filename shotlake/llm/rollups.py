"""Token counts as delta-maintained rollups.

A batch of changes (documents inserted, deleted, or counted anew) becomes signed rows in a ledger: what a
document counted for so far leaves with -1, what it counts for now enters with +1. The sums of a batch's signed rows by
source, language and tokenizer version are its deltas; totals are sums of deltas alone. A batch is written under its
own name, ledger first and deltas last, and counts once its deltas are complete. Committing it again changes
nothing; a batch that broke off is written anew, from the same ledger of other batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm.common import delete, row_key
from shotlake.llm.tokens import byte_level, ranked

GROUP = ["source", "lang", "version"]
LEDGER = "key long, source string, lang string, version string, sign int, n_tokens long"
DELTAS = "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """`docs` (doc_id, text, source, lang) as (key, doc_id, source, lang, a count for each version). `versions` names a
    vocabulary file for each: .json for the tokenizers library, .tiktoken for ranks. NULL texts have no tokens."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = {v: (byte_level if f.endswith(".json") else ranked)(f) for v, f in versions.items()}
        for df in batches:
            out = df.drop(columns="text")
            for v, tool in tools.items():
                out[v] = [len(x) // tool.dtype.itemsize for x in tool.encode(df["text"])]
            yield out

    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(count, "key long, doc_id long, source string, lang string, " + ", ".join(f"`{v}` long" for v in versions))


class Rollup:
    """Totals of tokens kept in a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self, kind: str, batch: int) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch={batch}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> list[int]:
        """The committed batches."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(b for n in names if n.startswith("batch=") and self._done("deltas", b := int(n[6:])))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counted(self) -> DataFrame:
        """What each document counts for now: its signed rows summed."""
        live = self._read("ledger", LEDGER).groupBy("key", *GROUP).agg(F.sum("sign").alias("live"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        return live.where("live <> 0").drop("live")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply `changes` (key, op, seq, source, lang, version, n_tokens; op is insert, revise or delete), once.

        Of several changes to a key the one of the highest seq holds, of equal ones the greatest row, so repeated rows
        count once. An insert of a known document revises it; a delete or revision of an unknown one finds
        nothing to take back. False if the batch was committed before.
        """
        if self._done("deltas", batch):
            return False
        last = F.max(F.struct("seq", "op", *GROUP, "n_tokens")).alias("c")
        changes = changes.groupBy("key").agg(last).select("key", "c.*")
        gone = self.counted().join(changes.select("key"), "key", "left_semi").select("key", *GROUP, F.lit(-1).alias("sign"), "n_tokens")
        come = changes.where("op <> 'delete'").select("key", *GROUP, F.lit(1).alias("sign"), "n_tokens")
        ledger = f"{self.path}/ledger/batch={batch}"
        gone.unionByName(come).write.mode("overwrite").parquet(ledger)
        rows = self.spark.read.schema(LEDGER).parquet(ledger)
        deltas = rows.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens), from the deltas alone; groups without documents are left out."""
        sums = self._read("deltas", DELTAS).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")

    def remove(self) -> None:
        delete(self.spark, self.path)


def change(rows: DataFrame, op: str, version: str | None, n_tokens: Column | None = None, seq: int = 0) -> DataFrame:
    """Rows (key, source, lang) as changes of one kind."""
    return rows.select("key", F.lit(op).alias("op"), F.lit(seq).alias("seq"), "source", "lang", F.lit(version).cast("string").alias("version"),
                       (F.lit(None).cast("long") if n_tokens is None else n_tokens).alias("n_tokens"))
