"""Centroid clustering over zone maps: vectors in Hilbert order lie in blocks with boxes, and a block is compared
only with the centroids that can be nearest somewhere in its box.

Vectors are taken as integers floor(scale * x); all comparisons and means are exact. A block of the written table holds
up to BLOCK vectors that follow each other on the curve, their box (least and greatest integer of each component) and
their sums. In a round a task reads blocks, finds the candidates of each from its box, compares vectors with these only
(none at all if one is left: its sums go to that centroid) and gives sums for each centroid. What reaches the driver
are the centroids and MERGES rows of sums for each of them, whatever the input holds.

Rows: a vector that is NULL, has another number of components, or holds a NULL or non-finite one takes no part.
Repeated rows all take part. Starting centroids are the vectors of the least hashes of their ids; rows without an id
come after all others, and ties (a repeated id) go by components. With fewer than k vectors there are as many centroids.
Integers over 2^25 are compared with unbounded ones; a distance or sum past 63 bits is NULL. An empty table gives no
rows. Columns other than the id and the vector are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm.common import drop, written

BLOCK = 1024
# bits of each component that place a vector on the curve
BITS = 4
# integers up to this keep squared distances of 2048 components below 2^63
PLAIN = 1 << 25
# up to this products of 2048 components are exact as doubles
SMALL = 1 << 20
MERGES = 32
LONG = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of `cells` (rows x dimensions, integers of `bits` bits) on the Hilbert curve, as bytes that
    sort in its order. All rows take each step together."""
    rows, dims = cells.shape
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for d in range(dims):
            turned = (x[d] & np.uint32(q)) != 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip, q = np.zeros(rows, np.uint32), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as unbounded integers if one does not fit in PLAIN."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not len(y) or np.abs(y).max() <= PLAIN:
        return y.astype(np.int64)
    # from 2^53 on a double is an integer itself
    exact = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(scale * v) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def box_candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that are nearest to some point of the box, as far as its bounds tell: j goes if an i is
    nearer all over the box (|x-i|^2 - |x-j|^2 is linear in x, so its greatest value lies at a corner), or as near with
    a smaller number."""
    apart = 2 * (centroids[None, :, :] - centroids[:, None, :])
    size = (centroids * centroids).sum(1)
    most = size[:, None] - size[None, :] + np.maximum(apart * lo, apart * hi).sum(2)
    number = np.arange(len(centroids))
    beaten = (most < 0) | ((most == 0) & (number[:, None] < number[None, :]))
    return number[~beaten.any(0)]


def nearest(x: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the candidates to each row and the squared distance; ties go to the smaller number."""
    near = centroids[candidates]
    if x.dtype != object and near.dtype != object and max(np.abs(x).max(), np.abs(near).max()) <= SMALL:
        a, b = x.astype(np.float64), near.astype(np.float64)
        far = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        far = np.stack([((x - c) ** 2).sum(1) for c in near], axis=1)
    at = far.argmin(1)
    return candidates[at], far[np.arange(len(x)), at]


def as_integers(rows: list[list[int]]) -> np.ndarray:
    flat = [abs(v) for r in rows for v in r]
    return np.array(rows, np.int64 if max(flat, default=0) <= PLAIN else object)


def vectors_of(row: dict, dims: int, scale: int) -> np.ndarray:
    if row["wide"]:
        return whole(np.frombuffer(row["data"], "<f8").reshape(-1, dims), scale)
    return np.frombuffer(row["data"], "<i4").reshape(-1, dims).astype(np.int64)


def build_blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """The zone-mapped table of (vec_id, v): vectors in curve order, cut into blocks, written."""
    spread = vectors.agg(*[f(F.col("v")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([spread[f"m{d}"] or 0.0 for d in range(dims)])
    reach = 2 * np.array([spread[f"s{d}"] or 0.0 for d in range(dims)])
    cells = 1 << BITS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(all="ignore"):
                cell = np.floor((x - mean + reach) / (2 * reach) * cells)
            key = hilbert_keys(np.clip(np.nan_to_num(cell), 0, cells - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([k.tobytes() for k in key], pa.binary()),
                                              b.column("tie")], ["vec_id", "v", "key", "tie"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for i in range(0, len(xs), BLOCK):
                x = whole(xs[i:i + BLOCK], scale)
                wide = x.dtype == object
                data = xs[i:i + BLOCK].astype("<f8") if wide else x.astype("<i4")
                told = [None] * 3 if wide else [x.min(0).tolist(), x.max(0).tolist(), x.sum(0).tolist()]
                ids = b.column("vec_id")[i:i + BLOCK].to_pylist()
                yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, [ids, wide, data.tobytes(), *told]))], schema=BLOCKS)

    placed = vectors.withColumn("tie", F.monotonically_increasing_id()).mapInArrow(place, "vec_id long, v array<double>, key binary, tie long")
    # the tie splits many equal vectors over ranges
    ordered = placed.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    return written(ordered.mapInArrow(pack, "ids array<long>, wide boolean, data binary, lo array<long>, hi array<long>, sums array<long>"), "blocks")


BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("wide", pa.bool_()), ("data", pa.binary()), ("lo", pa.list_(pa.int64())),
                    ("hi", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
ROWS = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def compared(row: dict, centroids: np.ndarray, dims: int, scale: int) -> tuple[np.ndarray | None, np.ndarray]:
    """A block's vectors (None if the zone map alone decides) and its candidates."""
    if row["wide"] or centroids.dtype == object:
        x = vectors_of(row, dims, scale)
        x = x.astype(object)
        return x, box_candidates(x.min(0), x.max(0), centroids.astype(object))
    near = box_candidates(np.array(row["lo"]), np.array(row["hi"]), centroids)
    return (None if len(near) == 1 else vectors_of(row, dims, scale)), near


def added(parts: Iterator[tuple[int, int, list[int]]]) -> dict[int, tuple[int, list[int]]]:
    """Counts and sums of components by cluster, in unbounded integers."""
    out: dict[int, tuple[int, list[int]]] = {}
    for c, n, sums in parts:
        if c in out:
            m, old = out[c]
            out[c] = (m + n, [a + b for a, b in zip(old, sums)])
        else:
            out[c] = (n, list(sums))
    return out


def sum_rows(found: dict[int, tuple[int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"cluster": c, "n": n, "sums": [str(v) for v in s]} for c, (n, s) in sorted(found.items())], schema=SUMS)


def moved(blocks: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """One round: the floored means of the vectors nearest to each centroid; an empty one stays."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = as_integers(centroids)

        def parts():
            for b in batches:
                for row in b.to_pylist():
                    x, near = compared(row, at, dims, scale)
                    if x is None:
                        yield int(near[0]), len(row["ids"]), row["sums"]
                        continue
                    cluster, _ = nearest(x, at, near)
                    for c in near[np.isin(near, cluster)]:
                        mine = x[cluster == c]
                        yield int(c), len(mine), mine.sum(0).tolist()

        yield sum_rows(added(parts()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield sum_rows(added((r["cluster"], r["n"], [int(v) for v in r["sums"]]) for b in batches for r in b.to_pylist()))

    kinds = "cluster int, n long, sums array<string>"
    rows = blocks.select("ids", "wide", "data", "lo", "hi", "sums").mapInArrow(local, kinds).repartition(MERGES).mapInArrow(merge, kinds).collect()
    found = added((r.cluster, r.n, [int(v) for v in r.sums]) for r in rows)
    return [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1",
                    vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Cluster, squared distance, sums of distances and the hash of the final centroid of each vector."""
    held = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = held.filter((F.size("v") == dims) & sound)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    starts = [r.v for r in held.orderBy(order, "v").limit(k).collect()]
    if not starts:
        return held.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    blocks = build_blocks(held, dims, scale)
    centroids = [r.tolist() for s in starts for r in [whole(np.array([s]), scale)[0]]]
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dims, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = as_integers(centroids)
        for b in batches:
            for row in b.to_pylist():
                x, near = compared(row, at, dims, scale)
                cluster, far = nearest(vectors_of(row, dims, scale) if x is None else x, at, near)
                far = [v if v <= LONG else None for v in far.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], schema=ROWS)

    rows = written(blocks.select("ids", "wide", "data", "lo", "hi", "sums").mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    drop(blocks)
    # a row for each centroid
    told = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count("distance").alias("m"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.cluster: int(r.s) if r.n == r.m and r.s <= LONG else None for r in told}
    total = None if None in sums.values() else sum(sums.values())
    total = None if total is not None and total > LONG else total
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = F.array(*[F.struct(F.lit(sums.get(c)).cast("long").alias("cluster_inertia"), F.lit(marks[c]).alias("centroid_sha256")) for c in range(len(centroids))])
    fact = facts[F.col("cluster")]
    return rows.select("vec_id", "cluster", "distance", fact["cluster_inertia"].alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
                       fact["centroid_sha256"].alias("centroid_sha256"))


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The same in DuckDB: distances of every vector from every centroid, one pair of steps a round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, vec_id, v, cluster, distance FROM (
  SELECT rid, vec_id, v, c.cluster, list_sum(list_transform(list_zip(v, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
         row_number() OVER (PARTITION BY rid ORDER BY list_sum(list_transform(list_zip(v, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster) AS place
  FROM kept, c{i} c) WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(mean ORDER BY d) AS w FROM (
  SELECT cluster, d, CAST(floor(sum(v[d]) / count(*)) AS BIGINT) AS mean FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS d) GROUP BY cluster, d) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN m{i} m ON o.cluster = m.cluster)""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS w FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k}),
{", ".join(steps)},
s AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a{rounds}) AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN s ON a.cluster = s.cluster JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE = oracle()
