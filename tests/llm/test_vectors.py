"""Range join and top-k search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.llm import mtree, range_join

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def cloud(n, width=6, spread=0.12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    x = (centres[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)
    return [(i, x[i].tolist(), int(i % 2) if i % 5 else 0, 0) for i in range(n)]


def links(rows, cosine):
    able = [(i, np.array(v, np.float64), l) for i, v, l, _ in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {r[0]: set() for r in rows}
    for a, x, l in able:
        for b, y, m in able:
            if a != b and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                near[a].add(b)
    low = {a: a for a in near}
    for _ in near:
        new = {a: min([low[a], *(low[b] for b in s)]) for a, s in near.items()}
        if new == low:
            break
        low = new
    return {a: (len(s), low[a], low[a] == a) for a, s in near.items()}


@pytest.mark.parametrize("cell", [2048, 16])
def test_range_join(spark, monkeypatch, cell):
    monkeypatch.setattr(range_join, "CELL", cell)
    monkeypatch.setattr(range_join, "BLOCK", cell // 2)
    rows = cloud(220) + [(900, None, 1, 0), (901, [0.0] * 6, 1, 0), (902, [float("nan")] * 6, 1, 0), (903, [1.0] * 6, None, 0), (904, [None] + [1.0] * 5, 0, 0),
                         (905, [1.0, 2.0], 0, 0), (906, [1.0, 2.0], 0, 0), (907, [], 0, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93).collect()}
    assert got == links(rows, 0.93)


def test_range_join_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0, 0)] * 2 + [(None, [1.0, 0.0], 0, 0), (3, [1.0, 0.01], 0, 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in range_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (3, 3, 1)]
    assert range_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_with_two_vectors(spark):
    """Links belong to a row's vector, not to its id."""
    rows = [(1, [1.0, 0.0, 0.0], 0, 0), (1, [0.0, 0.0, 1.0], 0, 0), (2, [1.0, 0.01, 0.0], 0, 0), (5, [0.0, 0.01, 1.0], 1, 0), (4, [0.0, 0.01, 1.0], 1, 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in range_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_magnitudes(spark):
    """Vectors whose squares leave the range of doubles still have a cosine; one vector twice as long is a copy."""
    rows = [(1, [1e-170, 0.0, 0.0]), (2, [1e-170, 1e-175, 0.0]), (3, [1e200, 1e199, 0.0]), (4, [5e-324, 0.0, 0.0]), (5, [2e-170, 0.0, 0.0]), (6, [0.0, -1e308, 0.0]), (7, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA.replace("float", "double"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in range_join.near_duplicates(frame).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (0, 7)}


def brute_top(rows, k):
    data = {(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v, _, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, x in data:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in data if c != q and len(x) == len(y))[:k]
            out += [(q, r + 1, c, max(-2**63, min(2**63 - 1, -s))) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,page", [(16_384, 256), (64, 8)])
def test_top_k(spark, monkeypatch, shard, page):
    monkeypatch.setattr(mtree, "SHARD", shard)
    monkeypatch.setattr(mtree, "SLICE", shard // 8)
    rows = cloud(300) + [(i, [0.5] * 6, 1, 0) for i in range(1000, 1040)] + [(1100, None, 1, 0), (1120, [float("inf")] * 6, 1, 0), (None, [1.0] * 6, 1, 0), (40, rows_of(cloud(300), 40), 1, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, mtree.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute_top(rows, 20)


def rows_of(rows, i):
    return rows[i][1]


def test_top_k_edges(spark):
    few = [(0, [1.0, -1.0], 1, 0), (1, [1e30, 1.0], 1, 0), (2, [3.0, 4.0], None, 0), (20, [1.0], 1, 0)]
    got = sorted(map(tuple, mtree.top_k(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 20 == 0).collect()))
    assert got == brute_top(few, 20)
    assert mtree.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_skips_pages():
    """Stored bounds save most computations where rows cluster, and lose nothing."""
    rng = np.random.default_rng(1)
    x = np.floor(64 * (np.repeat(rng.normal(size=(40, 8)), 100, axis=0) + 0.02 * rng.normal(size=(4000, 8))))
    tree, seen = mtree.Tree(np.arange(4000), x), []
    pages = tree.vectors

    class Counted(list):
        def __getitem__(self, i):
            seen.append(i)
            return pages[i]

    tree.vectors = Counted(pages)
    names, best = tree.search(np.arange(0, 4000, 200), x[::200], 20)
    for q, ids in zip(range(0, 4000, 200), names):
        s = x @ x[q]
        want = [i for i in sorted(range(4000), key=lambda i: (-s[i], i)) if i != q][:20]
        assert ids.tolist() == want
    random.seed(0)
    assert len(seen) < 0.5 * 20 * len(pages)
