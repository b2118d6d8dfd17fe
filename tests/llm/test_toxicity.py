"""Segments against brute force, and held-out accuracy of the score."""

import random

import numpy as np

from shotlake.llm import toxicity as T


def brute(x):
    """The best segment, the shortest of equals, then the same on either side."""
    def cut(a, b):
        best = None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += x[j]
                if s > 0 and (best is None or s > best[0] + 1e-12):
                    best = (s, i, j + 1)
        return [] if best is None else cut(a, best[1]) + [(best[1], best[2], best[0])] + cut(best[2], b)

    return cut(0, len(x))


def test_segments():
    random.seed(3)
    for _ in range(300):
        x = [random.choice([-3, -2, -1.5, -1, 1, 2, 2.5, 4.25]) + random.random() * 0.01 for _ in range(random.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in T.maximal_segments(np.array(x))]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(x)]


def corpus(spark, n=600):
    random.seed(11)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = [random.choice(words) for _ in range(random.randint(20, 200))]
        toxic = i % 6 == 0
        for _ in range(random.randint(2, 5) if toxic else 0):
            text.insert(random.randrange(len(text)), random.choice(["oaf", "cretin", "dolt"]))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    rows = T.score_toxicity(docs, labels).join(labels, "doc_id").where("toxicity.held_out").collect()
    assert len(rows) > 100
    assert sum(r.toxicity.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert all(r.toxicity.passages for r in rows if r.toxic and r.toxicity.predicted)
    # labels of held-out rows teach nothing
    known = T.train_rows(docs, labels).count()
    assert known == labels.where(T.remainder(labels.doc_id) != 2).count()


def test_edges(spark):
    docs, labels = corpus(spark, 500)
    odd = spark.createDataFrame([(None, None, "x"), (5000, "", "x"), (5000, "", "x"), (5001, "oaf " * 50_000, "x")], docs.schema)
    rows = T.score_toxicity(docs.union(odd), labels.union(spark.createDataFrame([(None, 1), (5, None), (5000, 7)], labels.schema))).where("doc_id IS NULL OR doc_id >= 5000").collect()
    got = {(r.doc_id, None if r.text is None else len(r.text)): r.toxicity for r in rows}
    assert len(rows) == 4 and 0 <= got[(5000, 0)].score < 0.3 and got[(5001, 200_000)].score > 0.3 and got[(None, None)].held_out is False
    none = T.score_toxicity(docs, labels.limit(0))
    assert {r.toxicity.score for r in none.collect()} == {0.0}
    assert T.score_toxicity(docs.limit(0), labels).count() == 0
    assert T.reject_toxic(docs, labels).columns == docs.columns
