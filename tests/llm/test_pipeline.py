"""The pipeline's stages against brute force on a small table, and the registered queries' frame."""

import random
from collections import Counter

import corpus_pipeline as P
from shotlake.llm import lattice, secret_scan, set_join, toxicity


def tables(spark, folder):
    random.seed(21)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = [random.choice(words) for _ in range(random.randint(20, 90))]
        toxic = i % 8 == 0
        for _ in range(4 if toxic else 0):
            text.insert(random.randrange(len(text)), random.choice(["oaf", "cretin", "dolt"]))
        if i % 50 == 3:
            text = docs[-2][1].split()
        if i % 20 == 1:
            text += ["token", "=", "abcdef0123456"]
        docs.append((i, " ".join(text), "en", "big" if i % 3 else f"s{i % 4}", len(" ".join(text))))
        labels.append((i, 1, int(toxic)))
    docs += [(None, None, None, None, None), (1000, "", "en", "big", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    data = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {0: docs}
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, kept[k], str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept[k + 1] = spark.read.parquet(f"{tmp_path}/{name}")
    rows = {k: [tuple(r) for r in df.collect()] for k, df in kept.items()}
    # toxic documents go, clean ones stay
    ids = {r[0] for r in rows[1]}
    assert not any(i % 8 == 0 for i in ids if i is not None and i < 400) and len(ids) >= 348
    # one document of each group of similar shingles stays
    def near(a, b):
        x, y = (set(set_join.shingles(t or "").tolist()) for t in (a, b))
        return bool(x and y) and 10 * len(x & y) >= 8 * len(x | y)
    two = {r[0] for r in rows[2]}
    for r in rows[1]:
        lower = any(o[0] < r[0] and near(o[1], r[1]) for o in rows[1] if r[0] is not None and o[0] is not None)
        assert (r[0] in two) != lower
    # secrets are masked where they were, nothing else changes
    before = {r[0]: r for r in rows[2]}
    for r in rows[3]:
        base, spans, _ = secret_scan.scan(before[r[0]][1] or "")
        assert (r[1] == before[r[0]][1]) == (not spans) and not secret_scan.scan(r[1] or "")[1]
        assert (r[0], *r[2:]) == (before[r[0]][0], *before[r[0]][2:])
    # every document is mixed in, small sources more often
    times = Counter(r[0] for r in rows[4])
    assert set(times) == {r[0] for r in rows[3]} and max(times.values()) > 1
    # pieces spell the texts
    last = P.STAGES[-1][1](spark, kept[4], str(tmp_path)).collect()
    assert all(r.decoded for r in last) and {r.doc_id for r in last} == set(times)
    tool = lattice.Sampler("piece_bpe_32k.model")
    masked = {r[0]: r[1] or "" for r in rows[3]}
    assert all(tool.pieces.decode(__import__("numpy").array(r.ids)) == masked[r.doc_id] for r in last)
    whole = P.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, last))
    assert toxicity.CUT == 0.3 and len(data) == 402


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_worker_holds_one_operator_s_tables():
    from shotlake.llm.common import worker_cache

    worker_cache("words")["the"] = 1
    worker_cache("lattice")["file"] = 2
    assert worker_cache("lattice") == {"file": 2} and worker_cache("words") == {}
