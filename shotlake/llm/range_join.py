"""Embedding near-duplicates: an exact metric range join on angles.

Pivots from a bounded sample part the vectors of a label into cells of the nearest pivot. Within the angle r of
a vector at home in cell j, another can be at home in cell i only if the first is at most 2r farther from pivot i than from its
own (triangle inequality), so it is a guest there; a pair of two cells meets in the lower one. Cells are cut into blocks of bounded
size, block pairs are compared on their own, and each leaves one row for each vector with a link: the number of links and the smallest
vector of its piece of the link graph. Equal vectors of a label are one vector with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm.common import NO_ID, components, every_salt, link_rows, real_key, with_salt, written
from shotlake.llm.mtree import finite

CELL, BLOCK, MOST_PIVOTS = 2_048, 1_024, 4_096


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding, label): the other rows of
    its label with a cosine of at least `cosine`, and the smallest vec_id reachable over links.

    Vectors that are NULL, zero or hold NULL or non-finite components, and rows with a NULL label, link with
    nothing; vectors of different lengths don't either. Rows without vec_id take part and have no component_id of their own.
    Repeated rows link with each other; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = rows.select("vec_id", "label", F.when(F.col("label").isNotNull() & finite(F.col("embedding")), F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    # by a power of two, which loses nothing, so that no square under- or overflows
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # bound in a lambda, or it would be computed anew for each component
    scaled = F.transform(F.array(F.pow(F.lit(2.0), F.floor(F.log2(most)))), lambda s: F.transform("v", lambda x: x / s))[0]
    rows = rows.select("vec_id", "label", F.when(most > 0, scaled).alias("v"))
    made = F.lit(NO_ID) + F.pmod(F.xxhash64("label", "v"), F.lit(1 << 61))
    rows = rows.withColumn("key", F.coalesce("vec_id", made))
    able = rows.where("v IS NOT NULL")
    # a node is a vector of a label, whatever ids it goes by; `least` is the smallest of them
    nodes = able.groupBy("label", "v").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    sizes = {r.label: r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
             .orderBy(F.desc("n"), "label").limit(MOST_PIVOTS).collect()}
    total, chosen = sum(sizes.values()), {}
    if sizes:
        share = max(CELL, math.ceil(total / MOST_PIVOTS))  # a pivot for so many vectors
        sample = nodes.where(F.col("label").isin(list(sizes)) & (F.pmod(F.xxhash64("node", F.lit(5)), F.lit(share)) == 0))
        for r in sample.orderBy(F.xxhash64("node"), "node").limit(MOST_PIVOTS).select("label", "v").collect():
            chosen.setdefault((r.label, len(r.v)), []).append(r.v)
    pivots, reach = {k: unit(x) for k, x in chosen.items()}, 2 * math.acos(cosine) + 1e-9

    def to_cells(batches):
        for df in batches:
            out = []
            for (label, width), part in df.groupby(["label", df["v"].map(len)], sort=False):
                p = pivots.get((label, width))
                if p is None:
                    out.append(part.assign(cell=0, guest=False))
                    continue
                angle = np.arccos(np.clip(unit(part["v"]) @ p.T, -1, 1))
                home = angle.argmin(axis=1)
                out.append(part.assign(cell=home, guest=False))
                i, j = np.nonzero((angle - angle.min(axis=1)[:, None] <= reach) & (np.arange(len(p))[None, :] < home[:, None]))
                if len(i):
                    out.append(part.iloc[i].assign(cell=j, guest=True))
            if out:
                df = pd.concat(out, ignore_index=True)
                yield df.assign(width=df["v"].map(len))

    cells = nodes.select("label", "v", "node", "copies").mapInPandas(to_cells, "label string, v array<double>, node long, copies long, cell long, guest boolean, width int")
    cells = written(cells, "cells")
    key = ["label", "width", "cell"]
    counts = cells.groupBy(*key).agg(F.sum((~F.col("guest")).cast("long")).alias("homes"), F.sum(F.col("guest").cast("long")).alias("guests"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    counts = counts.select(*key, blocks("homes").alias("nh"), blocks("guests").alias("ng")).where("nh > 0")
    # a cell may hold a third of the rows
    placed = with_salt(cells, "node").join(every_salt(counts), [*key, "_salt"]).drop("_salt")
    own = F.when(F.col("guest"), F.pmod(F.xxhash64("node"), F.col("ng"))).otherwise(F.pmod(F.xxhash64("node"), F.col("nh")))
    placed = placed.withColumn("own", own)
    # pairs of home blocks (a <= b), and of a home block a with a guest block b, named -1 - b
    zero = F.lit(0).cast("long")
    upto = lambda c: F.sequence(zero, c - 1)
    pairs = F.when(F.col("guest"), F.transform(upto(F.col("nh")), lambda a: F.struct(a.alias("a"), (-1 - F.col("own")).alias("b"))))
    homes = F.transform(upto(F.col("nh")), lambda b: F.struct(F.least(b, F.col("own")).alias("a"), F.greatest(b, F.col("own")).alias("b")))
    guests = F.when(F.col("ng") > 0, F.transform(upto(F.greatest("ng", F.lit(1).cast("long"))), lambda g: F.struct(F.col("own").alias("a"), (-1 - g).alias("b")))).otherwise(F.slice(homes, 1, 0))
    placed = placed.withColumn("pair", F.explode(pairs.otherwise(F.concat(homes, guests)))).select(*key, "pair.a", "pair.b", "v", "node", "copies", "guest", "own")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        b = df["b"].iloc[0]
        right = (df["guest"] if b < 0 else df["own"] == b).to_numpy()
        left = ~df["guest"].to_numpy() & (df["own"] == df["a"]).to_numpy()
        x, node, copies = unit(df["v"]), df["node"].to_numpy(), df["copies"].to_numpy()
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        close = x[li] @ x[ri].T >= cosine
        if b == df["a"].iloc[0]:
            close &= li[:, None] < ri[None, :]
        i, j = np.nonzero(close)
        got = link_rows(node, copies, li[i], ri[j])
        return pd.DataFrame(got or {"node": node[:0], "n": node[:0], "root": node[:0]})

    links = written(placed.groupBy(*key, "a", "b").applyInPandas(compare, "node long, n long, root long"), "links")
    found = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    member = nodes.select("node", "least").join(found, "node")
    smallest = member.groupBy("component").agg(F.min("least").alias("root"))
    # a component may hold a third of the nodes
    rooted = with_salt(member, "node").join(every_salt(smallest), ["component", "_salt"]).select("node", "root")
    table = (nodes.join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(rooted, "node", "left")
             .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "least").alias("component")))
    joined = with_salt(rows, "key", "vec_id").join(every_salt(table), ["label", "v", "_salt"], "left")
    component = real_key(F.coalesce("component", "key"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT a AS x, a AS y FROM l UNION SELECT c.x, l.b FROM c JOIN l ON c.y = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(y, e.vec_id) AS component_id, e.vec_id = coalesce(y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT x, min(y) AS y FROM c GROUP BY x) c ON c.x = e.vec_id
"""
