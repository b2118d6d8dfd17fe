"""Chunked scans, quantiles and folds against plain ones."""

import random

import pandas as pd

from shotlake.plans import exact_quantile, finite_fold, greedy_spacing, ordered_scan
from shotlake.plans.ordered import dealt
from pyspark.sql import functions as F


def test_ordered_scan_is_the_plain_window(spark):
    rng = random.Random(1)
    d = pd.DataFrame({"k": [rng.randrange(3) for _ in range(600)], "v": [rng.choice([None, rng.random()]) for _ in range(600)],
                      "o": rng.sample(range(100000), 600)})
    df = spark.createDataFrame(d)
    spec = dict(lag={"l": "v"}, lead={"e": "v"}, running={"rs": ("sum", "v"), "rc": ("count", "v"), "rl": ("last", "v")},
                before={"bm": ("max", "v")}, following={"fm": ("min", "v"), "ff": ("first", "v")}, totals={"t": ("sum", "v")})
    a, b = (ordered_scan(df, ["k"], ["o"], width=w, **spec).toPandas().sort_values(["k", "o"]).reset_index(drop=True).round(9)
            for w in (500, None))
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_null_keys_and_order_values_stay(spark):
    rows = [(None, None, 5), (None, 7, 1), (None, 25, 2), (1, None, 3), (1, 3, 4), (1, 31, None), (2, 8, 6)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    spec = dict(lag={"l": "v"}, lead={"e": "v"}, running={"s": ("sum", "v"), "t": ("last", "v")}, following={"f": ("first", "v")}, totals={"n": ("count", "v")})
    a, b = (sorted(map(str, ordered_scan(df, ["k"], ["o"], width=w, **spec).select("k", "o", "v", "l", "e", "s", "t", "f", "n").collect())) for w in (10, None))
    assert a == b and len(a) == len(rows)
    got = {r.k: r.m for r in exact_quantile(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, 1: 3.5, 2: 6.0}


def test_exact_quantile(spark):
    rng = random.Random(2)
    d = pd.DataFrame({"k": [rng.randrange(4) for _ in range(400)], "v": [round(rng.gauss(0, 5), 1) for _ in range(400)]})
    df = spark.createDataFrame(d)
    got = {r.k: (r.m, r.p) for r in exact_quantile(df, ["k"], "v", {"m": 0.5, "p": 0.9}, buckets=8).collect()}
    upper = {r.k: r.u for r in exact_quantile(df, ["k"], "v", {"u": 0.5}, "upper", buckets=8).collect()}
    for k, g in d.groupby("k"):
        assert abs(got[k][0] - g.v.median()) < 1e-9 and abs(got[k][1] - g.v.quantile(0.9)) < 1e-9
        assert upper[k] == sorted(g.v)[len(g) // 2]


def test_greedy_spacing_over_chunks(spark):
    rng = random.Random(3)
    rows = [(k, i) for k, p in enumerate([0.02, 0.3, 0.9, 1.0]) for i in range(700) if rng.random() < p]
    df = spark.createDataFrame(rows, "k int, at long")
    for gap, chunk in ((5, 32), (24, 64)):
        want = set()
        for k in range(4):
            last = -10**9
            for kk, i in rows:
                if kk == k and i - last >= gap:
                    want.add((k, i))
                    last = i
        assert {(r.k, r.at) for r in greedy_spacing(df, ["k"], "at", gap, chunk).collect()} == want


def test_finite_fold(spark):
    table = [[1, 0], [2, 0], [2, 1]]
    rng = random.Random(4)
    syms = [rng.randrange(2) for _ in range(300)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(syms)], "k int, i long, s int")
    state = 0
    for s in syms:
        state = table[state][s]
    row = finite_fold(df, ["k"], ["i"], F.col("s"), table, 0, 64.0, chunk=16).first()
    assert (row.state, row.n_events) == (state, 300)


def test_lut_lookup(spark):
    """A table read by joins, between, on and past its lines; one line only; missing cells."""
    import numpy as np
    from pyspark.sql import functions as F

    from shotlake.operators.visibility import lut_lookup

    rng = np.random.default_rng(5)
    r, c = np.sort(rng.uniform(-3, 3, 23)), np.sort(rng.uniform(0, 9, 17))
    v = rng.normal(size=(23, 17))

    def brute(x, y):
        x, y = min(max(x, r[0]), r[-1]), min(max(y, c[0]), c[-1])
        i, j = min(np.searchsorted(r, x, "right") - 1, 21), min(np.searchsorted(c, y, "right") - 1, 15)
        t, u = (x - r[i]) / (r[i + 1] - r[i]), (y - c[j]) / (c[j + 1] - c[j])
        return (1 - t) * (1 - u) * v[i, j] + t * (1 - u) * v[i + 1, j] + (1 - t) * u * v[i, j + 1] + t * u * v[i + 1, j + 1]

    cells = spark.createDataFrame([(float(a), float(b), float(v[i, j])) for i, a in enumerate(r) for j, b in enumerate(c)], "row double, column double, value double")
    asked = [(float(rng.uniform(-5, 5)), float(rng.uniform(-2, 11))) for _ in range(200)] + [(float(r[3]), float(c[16])), (float(r[22]), float(c[0]))]
    rows = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(asked)] + [(900, None, 1.0), (901, 1.0, None)], "k int, x double, y double")
    got = {q.k: q.out for q in lut_lookup(rows, cells, F.col("x"), F.col("y"), "out").collect()}
    assert len(got) == len(asked) + 2 and got[900] is None and got[901] is None
    assert all(abs(got[k] - brute(x, y)) < 1e-9 for k, (x, y) in enumerate(asked))
    line = cells.filter(F.col("row") == float(r[4]))
    mid = {q.k: q.out for q in lut_lookup(rows.filter("k < 900"), line, F.col("x"), F.col("y"), "out").collect()}
    assert all(abs(mid[k] - np.interp(y, c, v[4])) < 1e-9 for k, (_, y) in enumerate(asked))


def test_ranked_spreads_one_value(spark):
    """Ranks of a key whose rows all tie, of NULL keys, and of no key at all."""
    from shotlake.plans import ranked

    rows = [("hot", 5, i) for i in range(900)] + [(None, i % 3, i) for i in range(30)] + [("b", -i, i) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(6)
    got = {}
    for r in ranked(df, ["k"], ["o"], "p", 5).collect():
        got.setdefault(r.k, []).append((r.p, r.o))
    assert {k: [p for p, _ in sorted(v)] for k, v in got.items()} == {k: list(range(n)) for k, n in (("hot", 900), (None, 30), ("b", 7))}
    assert all([o for _, o in sorted(v)] == sorted(o for _, o in v) for v in got.values())
    assert [r.p for r in sorted(ranked(df, [], ["o", "i"], "p").collect(), key=lambda r: (r.o, r.i))] == list(range(937))


def test_scans_and_quantiles_of_small_and_large_keys(spark):
    """Keys over `most` rows are cut, others stay whole; both give the plain results, NULL keys and totals too."""
    rng = random.Random(5)
    sizes = {None: 90, 1: 300, 2: 20, 3: 1}
    rows = [(k, o, rng.choice([None, rng.random()])) for k, n in sizes.items() for o in rng.sample(range(9000), n)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    spec = dict(lag={"l": "v"}, lead={"e": "v"}, running={"rs": ("sum", "v"), "rl": ("last", "v")}, before={"bc": ("count", "v")},
                following={"ff": ("first", "v")}, totals={"t": ("max", "v"), "c": ("count", "o")})
    plain, cut, mixed = (ordered_scan(df, ["k"], ["o"], width=w, most=m, **spec).toPandas().sort_values(["k", "o"]).reset_index(drop=True).round(9)
                         for w, m in ((None, 0), (500, 0), (500, 50)))
    pd.testing.assert_frame_equal(cut[plain.columns], plain)
    pd.testing.assert_frame_equal(mixed[plain.columns], plain)
    for keys in (["k"], []):
        told = [sorted(map(str, exact_quantile(df, keys, "v", {"m": 0.5, "p": 0.9}, most=m).select(
            *keys, F.round("m", 9), F.round("p", 9)).collect())) for m in (0, 50, 10**6)]
        assert told[0] == told[1] == told[2] and len(told[0]) == (len({k for k, _, v in rows if v is not None}) if keys else 1)


def test_small_keys_are_shuffled_once_and_joined_with_nothing(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("o"))
    for told in (ordered_scan(rows, ["k"], ["o"], width=4.0, running={"s": ("sum", "o")}), exact_quantile(rows, ["k"], "o", {"m": 0.5})):
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lut_lookup_of_long_axes(spark):
    """Both axes of thousands of lines, rows on, between and past them, more places than are broadcast; no array holds an axis."""
    import numpy as np
    from shotlake.operators import visibility as vis

    n = 3000
    cells = spark.range(n).selectExpr("id * 3 AS row", "explode(array(id % 7, (id + 1) % 7, (id + 2) % 7, (id + 3) % 7, (id + 4) % 7, (id + 5) % 7, (id + 6) % 7)) AS column")
    cells = cells.selectExpr("row", "column", "row * 2 + column * 10 + row * column * 0.5 AS value")
    rows = spark.range(900).selectExpr("id", "id * 11.3 - 50 AS x", "CASE WHEN id % 50 = 0 THEN NULL ELSE id % 13 - 2.25 END AS y")
    old, vis.AXIS = vis.AXIS, 100
    try:
        told = vis.lut_lookup(rows, cells, F.col("x"), F.col("y"), "out")
        got = {r.id: (r.x, r.y, r.out) for r in told.collect()}
    finally:
        vis.AXIS = old
    assert len(got) == 900 and "collect_set" not in told._jdf.queryExecution().executedPlan().toString()
    for x, y, out in got.values():
        if y is None:
            assert out is None
            continue
        x, y = np.clip(float(x), 0, 3 * (n - 1)), np.clip(float(y), 0, 6)
        assert abs(out - (2 * x + 10 * y + 0.5 * x * y)) < 1e-6


def test_scans_are_dealt_by_rows_unasked(spark):
    df = spark.range(9_000_000).selectExpr("id % 5000 AS k", "id AS o")
    plan = ordered_scan(df, ["k"], ["o"], width=1e6, lag={"l": "o"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1 and "hashpartitioning(k#" in plan and ", 9), REPARTITION_BY_NUM" in plan
    small = ordered_scan(df.limit(1000), ["k"], ["o"], width=1e6, lag={"l": "o"})._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in small


def test_rows_that_compress_well_are_dealt_by_rows(spark):
    # few values: 64 MB of a shuffle would hold millions of them
    df = spark.range(40000).selectExpr("id % 400 AS k", "id AS o", "id % 7 AS v")
    plain = {r.k: r.m for r in exact_quantile(df, ["k"], "v", {"m": 0.5}).collect()}
    by_rows = exact_quantile(df, ["k"], "v", {"m": 0.5}, each=2000)
    assert {r.k: r.m for r in by_rows.collect()} == plain and by_rows.rdd.getNumPartitions() == 20
    # few enough tasks for a shuffle that sorts nothing in memory, unless they would be large
    assert [dealt(df, ["k"], n, 2000).rdd.getNumPartitions() for n in (1000000, 4000000)] == [200, 250]
    for most in (1 << 16, 50):
        spec = dict(width=1000.0, running={"s": ("sum", "v")}, lag={"l": "v"}, most=most)
        scanned = ordered_scan(df, ["k"], ["o"], each=2000, **spec)
        assert {tuple(r) for r in scanned.select("k", "o", "s", "l").collect()} == {tuple(r) for r in ordered_scan(df, ["k"], ["o"], **spec).select("k", "o", "s", "l").collect()}
        assert scanned.rdd.getNumPartitions() == 20 and max(scanned.rdd.glom().map(len).collect()) < 6000
    assert exact_quantile(df.filter("k < 0"), ["k"], "v", {"m": 0.5}).count() == 0
