"""Merging in rounds against one step at a time."""

import random

import pytest
from test_timeline import brute_max, brute_short, lists, shots_df

from shotlake.operators import merging
from shotlake.operators import timeline as op


def laid(sizes):
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    return list(zip(ends, ends[1:]))


def titles():
    """Runs that chain from one end to the other: equal lengths, alternation, stairs, and mixes of them."""
    rng = random.Random(7)
    cases = {"equal": [12] * 301, "odd": [40] + [12] * 200 + [40, 11], "alternate": [1, 5] * 150, "alternate long": [3, 90] * 120, "stairs": list(range(1, 24)) * 12,
             "down": list(range(23, 0, -1)) * 12, "alone": [5], "two": [5, 5], "ones": [1] * 257, "calm": [30] * 40}
    for k in range(8):
        kinds = ([1, 2], [3, 8, 15, 23, 24, 40, 90], [5, 5, 5, 60], [2, 2, 9], [1, 30, 30])[k % 5]
        cases[f"r{k}"] = [rng.choice(kinds) for _ in range(rng.randrange(120, 260))]
    return {k: laid(s) for k, s in cases.items()}


@pytest.mark.parametrize("least,chunk,group", [(6, 64, 20), (24, 1 << 16, 1 << 16)])
def test_merge_short_in_rounds(spark, monkeypatch, least, chunk, group):
    monkeypatch.setattr(merging, "GROUP", group)
    cases = titles()
    assert lists(op.merge_short(shots_df(spark, cases), least, chunk=chunk)) == {k: brute_short(s, least) for k, s in cases.items()}


def test_levels_alone_finish(spark):
    """Rounds without the heap, one for each length at most."""
    cases = {k: s for k, s in titles().items() if len(s) > 1}
    rounds = []
    real = merging.level_round
    merging.level_round = lambda runs, v, chunk=None: rounds.append(v) or real(runs, v, chunk)
    try:
        df = shots_df(spark, cases).selectExpr("struct(source_id) AS _id", "s0", "s1")
        done = merging.merge_levels(df, 6, 100, 1).selectExpr("_id.source_id", "s0", "s1")
    finally:
        merging.level_round = real
    got = {}
    for r in done.collect():
        got.setdefault(r.source_id, []).append((r.s0, r.s1))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_short(s, 6) for k, s in cases.items()}
    assert rounds == sorted(set(rounds)) and len(rounds) < 6


def test_merge_to_max_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(merging, "GROUP", 60)
    cases = titles()
    assert lists(op.merge_to_max(shots_df(spark, cases), 17, chunk=128)) == {k: brute_max(s, 17) for k, s in cases.items()}


def test_many_short_shots_are_spread(spark, monkeypatch):
    """A title of short shots only: no task sees more than a chunk of them, and the rounds stay few."""
    shots = laid([2 + (i * 7) % 5 for i in range(20_000)])
    monkeypatch.setattr(merging, "GROUP", 500)
    got = lists(op.merge_short(shots_df(spark, {"t": shots}), 7, chunk=2048))["t"]
    assert got[0][0] == 0 and got[-1][1] == shots[-1][1] and all(a[1] == b[0] for a, b in zip(got, got[1:])) and min(b - a for a, b in got) >= 7
    assert got == [(r["s0"], r["s1"]) for r in op._merge_shortest([s[0] for s in shots], [s[1] for s in shots], 7)]
