"""Centroid clustering against brute force in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from shotlake.llm import zone_maps

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string"


def brute(rows, k, rounds, dims):
    """Lists of (vec_id, cluster, distance, cluster sum, sum, hash), sums past 63 bits as None."""
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**53 else int(x) * 64 for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    at = [v for i, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        homes = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), h in zip(kept, homes) if h == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    told = [(i, *nearest(v)) for i, v in kept]
    fit = lambda x: x if x < 2**63 else None
    total = sum(d for _, d, _ in told)
    return [(i, j, fit(d), fit(sum(e for _, e, h in told if h == j)), fit(total), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest())
            for i, d, j in told]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def clouds(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(i, (centres[rng.integers(0, 7)] + spread * rng.normal(size=dims)).tolist(), 0, "x") for i in range(n)]


ODD = [(900, None, 0, "x"), (901, [1.0], 0, "x"), (902, [], 0, "x"), (903, [float("nan")] * 5, 0, "x"), (904, [None, 1.0, 1.0, 1.0, 1.0], 0, "x"),
       (905, [float("inf")] * 5, 0, "x"), (None, [0.5] * 5, 0, "x"), (None, [-0.5] * 5, 0, "x"), (7, [0.25] * 5, 0, "x"), (7, [0.25] * 5, 0, "x")]


@pytest.mark.parametrize("block,k", [(1024, 6), (8, 6), (8, 60), (16, 1)])
def test_against_brute_force(spark, monkeypatch, block, k):
    monkeypatch.setattr(zone_maps, "BLOCK", block)
    rows = clouds(300, 5, k) + ODD + [(2000 + i, [0.125] * 5, 0, "y") for i in range(90)]
    got = zone_maps.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=k, dims=5)
    assert in_order(got.collect()) == in_order(brute(rows, k, 3, 5))


def test_few_and_none(spark):
    rows = clouds(4, 5, 3)
    got = zone_maps.cluster_vectors(spark.createDataFrame(rows, SCHEMA), dims=5)
    assert in_order(got.collect()) == in_order(brute(rows, 16, 3, 5))
    for none in ([], ODD[:6]):
        got = zone_maps.cluster_vectors(spark.createDataFrame(none, SCHEMA), dims=5)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


@pytest.mark.parametrize("size", [3e6, 1e12, 1e300])
def test_large_components(spark, size):
    rows = clouds(60, 5, 9) + [(500 + i, [size * (i % 3), -size, 0.1 * i, 1.0, size / 7], 0, "x") for i in range(12)]
    got = zone_maps.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=5, dims=5)
    assert in_order(got.collect()) == in_order(brute(rows, 5, 3, 5))


def test_curve_visits_neighbours():
    """Cells in the order of their keys differ by one step in one dimension, and none is met twice."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = [k.tobytes() for k in zone_maps.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_leave_out_no_nearest():
    rng = random.Random(5)
    pruned = 0
    for _ in range(200):
        x = np.array([[rng.randrange(-9, 10) + 20 * rng.random() for _ in range(3)] for _ in range(6)]).astype(np.int64)
        at = np.array([[rng.randrange(-40, 40) for _ in range(3)] for _ in range(8)], np.int64)
        near = zone_maps.box_candidates(x.min(0), x.max(0), at)
        pruned += len(at) - len(near)
        best = ((x[:, None] - at) ** 2).sum(2).argmin(1)
        assert set(best) <= set(near)
    assert pruned > 400
