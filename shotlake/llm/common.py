"""What the operators of this subpackage share: written tables, keys, grouped streams, components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# keys made for rows without an id lie from here on, after all ids of the data
NO_ID = 1 << 62
# a row group stays under this many rows where a join on a hot key is dealt out
SALTS = 16


def folder(spark: SparkSession) -> str:
    """The folder every executor reaches; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-llm-")


def written(df: DataFrame, name: str = "table", rows_a_file: int = 0) -> DataFrame:
    """The rows of `df` as a written table; its lineage ends there. `drop` removes it. Parquet writers buffer 100 rows at
    least and readers decode up to 4,096 rows of a file at once, so rows of megabytes need a limit (0: none)."""
    path = f"{folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove written tables that no later step reads."""
    for t in tables:
        if path := getattr(t, "_llm_path", None):
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks, until one of another name is asked for: workers
    outlive a step, and the memory of the last one's tables is needed by the next."""
    held = vars(sys).setdefault("_llm_caches", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id, or a made key from the text for rows without one."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 61)))


def real_key(key: Column) -> Column:
    """The key, or NULL where `row_key` made it."""
    return F.when(key < NO_ID, key)


Run = dict[str, np.ndarray]


def by_run(batches: Iterator[pd.DataFrame], key: list[str], fn: Callable[[Run], dict | None], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Apply `fn` to the columns of each run of equal keys of a partition sorted by `key`; results leave in batches of
    about `rows`. Only the last run of a batch is carried on, so memory holds a batch and a group."""
    rest, out, held = None, [], 0

    def cut(df: pd.DataFrame, last: bool) -> None:
        nonlocal rest, held
        columns = {c: df[c].to_numpy() for c in df.columns}
        new = np.zeros(len(df), bool)
        for c in key:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(df)]
        if not last:
            rest = df.iloc[edges[-2]:]
            edges = edges[:-1]
        for a, b in zip(edges, edges[1:]):
            got = fn({c: x[a:b] for c, x in columns.items()})
            if got is not None:
                out.append(got)
                held += len(next(iter(got.values())))

    def flush() -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in out[0]})

    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch, rest = pd.concat([rest, batch], ignore_index=True), None
        cut(batch, False)
        if held >= rows:
            yield flush()
            out, held = [], 0
    if rest is not None:
        cut(rest, True)
    if held:
        yield flush()


def grouped(df: DataFrame, key: list[str], fn: Callable[[Run], dict | None], schema: str) -> DataFrame:
    """`fn` on each group of `key`, many groups to a task, without a call into Spark for every group."""
    return df.repartition(*key).sortWithinPartitions(*key).mapInPandas(lambda it: by_run(it, key, fn), schema)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of 0..n-1's piece under links a-b, by repeated pointer jumps."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_rows(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict | None:
    """Links i-j between rows of a group as a row (node, n, root) for each linked row: the documents it links
    with here, and the smallest node of its piece."""
    if not len(i):
        return None
    n = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), int)
    rank[order] = np.arange(len(node))
    root = node[order][union_find(len(node), rank[i], rank[j])[rank]]
    met = n > 0
    return {"node": node[met], "n": n[met].astype(np.int64), "root": root[met]}


def with_salt(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The connected components of `edges` (a, b): a row (node, component) for each node of
    an edge, component the smallest node. Alternating large and small stars; the joins on a
    node are salted, as the centre of a star has many neighbours."""
    def joined(rows: DataFrame, least: DataFrame) -> DataFrame:
        return with_salt(rows, "v").join(every_salt(least), ["u", "_salt"]).drop("_salt")

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least).distinct(), "small")
        drop(now, large)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
