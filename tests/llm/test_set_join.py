"""The chosen-path join against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from shotlake.llm import set_join as S

SCHEMA = "doc_id long, text string, class_id long, key string"


def brute(rows):
    def shingled(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingled(t) for _, t, *_ in rows]
    near = [[j for j, b in enumerate(sets) if i != j and a and b and 10 * len(a & b) >= 8 * len(a | b)] for i, a in enumerate(sets)]
    low = [(r[0] is None, r[0] or 0) for r in rows]
    for _ in rows:
        new = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(rows))]
        if new == low:
            break
        low = new
    return Counter((r[0], None if c[0] else c[1], len(n)) for r, c, n in zip(rows, low, near))


def corpus(seed=1, n=160, families=6):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [random.choice(words) for _ in range(25)]
    bases = [[random.choice(words) for _ in range(random.randint(40, 120))] for _ in range(families)]
    out = []
    for i in range(n):
        if i % 2:
            text = list(bases[min(int(random.expovariate(0.7)), families - 1)])
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                text[random.randrange(len(text))] = random.choice(words)
        else:
            text = passage + [random.choice(words) for _ in range(random.randint(5, 200))]
        out.append((i, " ".join(text), 0, "k"))
    return out


ODD = [(None, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"), (500, "A b c d e F", 1, "x"), (501, None, 1, "x"), (502, "", 1, "x"), (503, " \n", 1, "x"), (504, "two words", 1, "x"),
       (505, "two  WORDS", 1, "x"), (506, "long " * 40_000, 1, "x"), (507, " ".join(f"v{i}" for i in range(30_000)), 1, "x"), (508, "v0 " + " ".join(f"v{i}" for i in range(30_000)), 1, "x")]


@pytest.mark.parametrize("small,block", [(64, 256), (4, 8)])
def test_same_as_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "BLOCK", block)
    rows = corpus() + ODD
    random.shuffle(rows)
    got = S.near_classes(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_runs_meet_the_recall():
    """Simulated signatures of pairs at the threshold meet in some bucket about as often as stated."""
    assert S.missed(0.8, 1) == pytest.approx(0.75 * 0.2 + 0.25 * 0.04)
    for depth in (1, 4, 8):
        runs = S.runs_needed(0.8, 0.99, depth)
        assert S.missed(0.8, depth) ** runs <= 0.01 < S.missed(0.8, depth) ** (runs - 1)


def test_simulated_signatures_meet_the_recall(spark):
    """Of 4000 pairs whose 64 minima agree with a probability of 0.8 each, 0.5 % miss each other in all runs of eight levels; 1.9 % would in
    10 runs, which fresh minima for each run would allow."""
    rng, n, nodes = np.random.default_rng(3), 4000, "node long, signature binary"
    one = rng.integers(0, 1 << 32, (n, S.TOKENS), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < S.THRESHOLD, one, rng.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    sig = np.stack([one, two], axis=1).reshape(2 * n, S.TOKENS)
    table = spark.createDataFrame(pd.DataFrame({"node": np.arange(2 * n), "signature": [x.tobytes() for x in sig]}), nodes).cache()
    seen = {}

    class Asked(Exception):
        pass

    def runs_of_join(nodes, runs):
        seen["runs"] = runs
        raise Asked

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S, "final_buckets", runs_of_join)
        with pytest.raises(Asked):
            S.near_classes(spark.createDataFrame([(1, "a text of the join", 0, "k")], SCHEMA))
    rows = S.first_buckets(table, seen["runs"]).toPandas()
    for level in range(S.DEPTH):
        pair = rows.assign(pair=rows["node"] // 2).drop_duplicates(["path", "node"])
        met = pair[pair.duplicated(["path", "pair"], keep=False)]
        if level < S.DEPTH - 1:
            split = spark.createDataFrame(met[["path", "node"]]).join(table, "node").select("path", "node", "signature")
            rows = S.split_buckets(split).toPandas()
    missed = n - met["pair"].nunique()
    expected = n * (1 - S.RECALL)
    assert missed <= expected + 4 * expected ** 0.5


def test_keep_one(spark):
    rows = corpus() + ODD + [(504, "two words", 1, "x"), (7, "another text of the same id here", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    classes = {}
    for (d, c, n), m in brute(rows).items():
        classes.setdefault((d, c, n), m)
    alone = sum(m for (d, c, n), m in classes.items() if n == 0)
    linked = {c for (d, c, n), m in classes.items() if n}
    assert sum(got.values()) == alone + len(linked)
    assert got[504] == 1 and got[501] == got[502] == got[503] == 1


@pytest.mark.parametrize("linked", [0, 1])
def test_texts_of_one_id(spark, linked):
    """Either text of id 1 links with id 2, so both orders of their hashes come up; only the near copy goes."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    rows = [(1, texts[0], 0, "k"), (1, texts[1], 0, "k"), (2, texts[linked] + " tail", 0, "k"),
            (3, " ", 0, "k"), (3, "a text with words that links with none", 0, "k"), (3, None, 0, "k"), (4, "no twin of any other text at all", 0, "k"),
            (None, texts[1 - linked] + " end", 0, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = S.near_classes(docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == brute(rows)
    kept = Counter((r.doc_id, r.text) for r in S.keep_one(docs).collect())
    assert kept == Counter(r[:2] for r in rows[:2] + rows[3:7])


def test_empty(spark):
    assert S.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
