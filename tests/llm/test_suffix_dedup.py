"""Induced suffix arrays and the removal of repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from shotlake.llm import suffix_dedup as S


def test_suffix_array():
    random.seed(2)
    for _ in range(250):
        k, n = random.choice([2, 3, 5]), random.randint(1, 60)
        text = np.array([random.randrange(k) for _ in range(n)])
        at, common = S.suffix_array(text, 200, random.choice([4, 10**6]))
        tail = [text[i:].tolist() for i in range(n)]
        assert at.tolist() == sorted(range(n), key=tail.__getitem__)
        for i in range(1, n):
            a, b = tail[at[i]], tail[at[i - 1]]
            want = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[i] == want


def test_queue_spills():
    queue, want = S.BucketQueue(3, 10), {0: [], 1: [], 2: []}
    random.seed(1)
    for i in range(200):
        b = random.randrange(3)
        queue.push(b, np.arange(i, i + 3), np.arange(3))
        want[b] += range(i, i + 3)
        if i % 50 == 49:
            assert queue.pop(b)[0].tolist() == want[b]
            want[b] = []
    assert [queue.pop(b)[0].tolist() for b in range(3)] == [want[b] for b in range(3)] and queue.file is not None
    queue.close()


def brute(rows, window):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for row, t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i + 1:i + window + 1] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((row[0], len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return Counter(out)


SCHEMA = "doc_id long, text string, anchor long, repeats string"


@pytest.mark.parametrize("hot", [256, 2])
def test_same_as_brute_force(spark, hot):
    random.seed(7)
    letters = "abcdé"
    word = lambda n: "".join(random.choice(letters) for _ in range(n))
    passages = [word(random.randint(12, 60)) for _ in range(5)]
    rows = []
    for i in range(150):
        text = word(random.randint(0, 40))
        for _ in range(random.choice([0, 1, 1, 2])):
            p = random.choice(passages)
            a = random.randrange(len(p) // 2)
            text += p[a:random.randint(a + 5, len(p))] + word(random.randint(0, 20))
        rows.append((i, text, 1, "x"))
    rows += [(3, rows[3][1], 1, "x"), (900, rows[9][1], 1, "x"), (None, rows[10][1], 1, "x"), (901, None, 1, "x"), (902, "", 1, "x"), (903, "ab" * 4000, 1, "x"),
             (904, word(20_000), 1, "x"), (905, "a" * 12, 1, "x"), (906, "short", 1, "x")]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=12, gram=4, hot=hot).select("doc_id", "repeats.*").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 12)


def test_real_window(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage = text(70)
    rows = [(i, text(60) + (" " + passage + " " if i % 3 == 0 else " ") + text(50), 1, "x") for i in range(30)] + [(99, "q" * 1000, 1, "x")]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "repeats.*").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 200)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
