"""Exact top-k inner products by best-first search in M-trees.

Integer vectors of norm up to m become points of a metric space by one more coordinate, sqrt(m^2 - |x|^2):
there the nearest point to (q, 0) is the one of largest inner product. Rows are dealt to shards of
bounded size; a shard is an M-tree of two levels of routing objects over pages, each with its
covering radius and the distance to its parent stored. Queries, in slices of bounded size, meet every
shard. A query takes pages in the order of what they can hold at best and stops when that is less than its
k-th score; stored distances rule out routing objects and runs of a page without computing theirs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.llm.common import every_salt, with_salt

SHARD, SLICE, PAGE, FANOUT = 16_384, 4_096, 256, 8
SCALE, LOWEST = 64, -(1 << 200)


def as_matrix(rows: list) -> np.ndarray:
    """Whole numbers as doubles while all inner products fit 53 bits, as Python numbers beyond."""
    width = len(rows[0]) if len(rows) else 0
    floats = np.array([np.floor(SCALE * np.asarray(r, np.float64)) for r in rows]).reshape(len(rows), width)
    if not floats.size or np.abs(floats).max() ** 2 * max(width, 1) < 2.0 ** 53:
        return floats
    return np.array([[int(x) for x in r] for r in floats.tolist()], object).reshape(len(rows), width)


class Tree:
    """Pages of ids and vectors under routing objects under their parents."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        rng = np.random.default_rng(len(ids))
        self.norm2 = (vectors * vectors).sum(axis=1)
        self.m2 = float(self.norm2.max())
        points = self._lift(vectors, self.norm2)
        n_pivots = max(1, -(-len(ids) // PAGE))
        pick = rng.permutation(len(ids))[:n_pivots]
        near, dist = self._nearest(points, points[pick])
        pages = []  # (pivot, rows in order of their parent distance)
        for p in range(n_pivots):
            own = np.flatnonzero(near == p)
            own = own[np.argsort(dist[own], kind="stable")]
            pages += [(p, own[i:i + PAGE]) for i in range(0, len(own), PAGE)]
        self.ids = [ids[r] for _, r in pages]
        self.vectors = [vectors[r] for _, r in pages]
        self.to_parent = [dist[r] for _, r in pages]
        self.pivot = points[pick[[p for p, _ in pages]]]
        self.outer = np.array([d[-1] for d in self.to_parent])
        self.inner = np.array([d[0] for d in self.to_parent])
        tops = rng.permutation(len(pages))[: max(1, len(pages) // FANOUT)]
        self.top = self.pivot[tops]
        self.parent, self.parent_dist = self._nearest(self.pivot, self.top)
        self.reach = np.zeros(len(tops))
        np.maximum.at(self.reach, self.parent, self.parent_dist + self.outer)

    def _lift(self, vectors: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors.astype(float), np.sqrt(np.maximum(self.m2 - norm2.astype(float), 0))])

    @staticmethod
    def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))

    def _nearest(self, points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, dist = np.zeros(len(points), int), np.zeros(len(points))
        for i in range(0, len(points), 4096):
            d = self._dist(points[i:i + 4096], pivots)
            near[i:i + 4096] = d.argmin(1)
            dist[i:i + 4096] = d.min(1)
        return near, dist

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of each query but rows of its own id; the least possible score where there are fewer."""
        n, q2 = len(qids), (queries * queries).sum(axis=1).astype(float)
        points = np.column_stack([queries.astype(float), np.zeros(n)])
        slack = 1e-6 * (1 + np.sqrt(self.m2 + q2))
        lowest = LOWEST if queries.dtype == object else -np.inf
        best = np.full((n, k), lowest, queries.dtype)
        names = np.full((n, k), np.iinfo(np.int64).max)

        def radius(rows: np.ndarray) -> np.ndarray:
            """How far a row that still counts can lie from its query."""
            worst = best[rows, -1].astype(float)
            return np.sqrt(np.maximum(q2[rows] + self.m2 - 2 * worst, 0)) + slack[rows]

        def visit(rows: np.ndarray, page: int, to_pivot: np.ndarray) -> None:
            away, r = self.to_parent[page], radius(rows)
            a = int(np.searchsorted(away, (to_pivot - r).min(), "left"))
            b = int(np.searchsorted(away, (to_pivot + r).max(), "right"))
            if a >= b:
                return
            ids = self.ids[page][a:b]
            scores = queries[rows] @ self.vectors[page][a:b].T
            scores = np.where(qids[rows][:, None] == ids[None, :], lowest, scores)
            scores = np.concatenate([best[rows], scores], axis=1)
            ids = np.concatenate([names[rows], np.broadcast_to(ids, (len(rows), b - a))], axis=1)
            if scores.dtype == object:
                order = np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores, ids)])
            else:
                cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
                keep = np.flatnonzero((scores >= cut).any(axis=0))  # columns no query needs are left out before sorting
                scores, ids = scores[:, keep], ids[:, keep]
                order = np.lexsort((ids, -scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(scores, order, 1)
            names[rows] = np.take_along_axis(ids, order, 1)

        far = np.full((n, len(self.ids)), np.inf)  # to routing objects, as far as computed
        low = np.full((n, len(self.ids)), np.inf)  # the least a row of the page can be away
        to_top = self._dist(points, self.top)

        def open_children(top: int, rows: np.ndarray) -> None:
            child = np.flatnonzero(self.parent == top)
            r = radius(rows)
            # the stored parent distance alone rules some children out
            need = np.abs(to_top[rows, top][:, None] - self.parent_dist[child][None, :]) - self.outer[child][None, :] <= r[:, None]
            child = child[need.any(axis=0)]
            if len(child):
                d = self._dist(points[rows], self.pivot[child])
                far[np.ix_(rows, child)] = d
                low[np.ix_(rows, child)] = np.maximum(np.maximum(d - self.outer[child], self.inner[child] - d), 0)

        def best_first() -> None:
            while True:
                page = low.argmin(axis=1)
                least = low[np.arange(n), page]
                live = np.flatnonzero(np.isfinite(least) & (least <= radius(np.arange(n))))
                if not len(live):
                    break
                order = live[np.argsort(page[live], kind="stable")]
                edge = np.flatnonzero(np.diff(page[order])) + 1
                for rows in np.split(order, edge):
                    p = int(page[rows[0]])
                    visit(rows, p, far[rows, p])
                    low[rows, p] = np.inf

        nearest = to_top.argmin(axis=1)
        for top in np.unique(nearest):
            open_children(int(top), np.flatnonzero(nearest == top))
        best_first()
        for top in range(len(self.top)):
            rows = np.flatnonzero(nearest != top)
            rows = rows[to_top[rows, top] - self.reach[top] <= radius(rows)]
            if len(rows):
                open_children(top, rows)
        best_first()
        return names, best


def finite(embedding: Column) -> Column:
    x = F.transform(embedding, lambda v: v.cast("double"))
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` largest inner products of each row for which the column `is_query`
    holds, over all rows of `vectors` (vec_id, embedding) but the query's own; components are floor(64 x).

    Rows without vec_id, with a NULL embedding or NULL or non-finite components take no part; rows equal in both
    count once; only vectors of one length are compared; ties go to the smaller vec_id; scores beyond a long are cut to
    its range; an empty table gives an empty one.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), is_query.alias("is_query"))
    rows = rows.dropDuplicates(["vec_id", "v"]).withColumn("width", F.size("v"))
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"))
    sizes = sizes.select("width", F.ceil(F.col("n") / SHARD).alias("shards"), F.greatest(F.ceil(F.col("q") / SLICE), F.lit(1)).alias("slices"))
    rows = with_salt(rows, "vec_id").join(every_salt(sizes), ["width", "_salt"]).drop("_salt")
    place = F.xxhash64("vec_id")
    zero, long = F.lit(0).cast("long"), lambda c: c.cast("long")
    data = rows.withColumn("shard", F.pmod(place, "shards")).withColumn("slice", F.explode(F.sequence(zero, long(F.col("slices") - 1))))
    asks = rows.where("is_query").withColumn("slice", F.pmod(place, "slices")).withColumn("shard", F.explode(F.sequence(zero, long(F.col("shards") - 1))))
    key = ["width", "shard", "slice"]
    data, asks = data.select(*key, "vec_id", "v"), asks.select(*(F.col(c).alias(f"q_{c}") for c in [*key, "vec_id", "v"]))

    def search(tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(tree) or not len(queries):
            return none
        both = as_matrix([*tree["v"], *queries["q_v"]])
        names, best = Tree(tree["vec_id"].to_numpy(), both[: len(tree)]).search(queries["q_vec_id"].to_numpy(), both[len(tree):], k)
        asked = np.repeat(queries["q_vec_id"].to_numpy(), k)
        names, best = names.ravel(), best.ravel()
        real = best > (-np.inf if best.dtype != object else LOWEST)
        best = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in best[real]]
        return pd.DataFrame({"query_id": asked[real], "vec_id": names[real], "score": np.array(best, np.int64)})

    found = data.groupBy(*key).cogroup(asks.groupBy(*(f"q_{c}" for c in key))).applyInPandas(search, "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
