"""Rollups against counting from scratch, replays and broken batches."""

import random
import uuid
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotlake.llm import rollups
from shotlake.llm.common import folder
from shotlake.llm.tokens import tokenizer_file

SCHEMA = "key long, op string, seq int, source string, lang string, version string, n_tokens long"


def test_deltas_equal_a_recount(spark):
    random.seed(6)
    rollup, state = rollups.Rollup(spark, f"{folder(spark)}/rollup-{uuid.uuid4().hex}"), {}
    assert rollup.totals().count() == 0
    for batch in (1, 2, 3):
        rows = []
        for i in range(60):
            op = random.choice(["insert", "revise", "delete"] if batch > 1 else ["insert"])
            key = random.randrange(40)
            rows.append((key, op, i, random.choice(["a", None]), random.choice(["en", "de"]), f"v{batch}", random.randrange(100)))
        changes = spark.createDataFrame(rows + rows[-3:], SCHEMA)
        for _ in range(2):
            assert rollup.commit(batch, changes) == (batch not in rollup.batches() or _ == 0)
        last = {r[0]: r for r in rows}
        for k, r in last.items():
            state.pop(k, None)
            if r[1] != "delete":
                state[k] = (r[3], r[4], r[5], r[6])
        want = Counter()
        for s, l, v, n in state.values():
            want[s, l, v, "docs"] += 1
            want[s, l, v, "tokens"] += n
        got = {(r.source, r.lang, r.version, k): x for r in rollup.totals().collect() for k, x in (("docs", r.n_docs), ("tokens", r.n_tokens))}
        assert got == dict(want)
    # a batch that broke off before its deltas were complete is invisible, and is written anew
    spark.createDataFrame([(1, "a", "en", "v9", 1, 5)], rollups.LEDGER).write.parquet(f"{rollup.path}/ledger/batch=4")
    assert rollup.batches() == [1, 2, 3]
    assert rollup.commit(4, spark.createDataFrame([(77, "insert", 0, "z", "z", "v9", 3)], SCHEMA))
    assert rollup.totals().where("version = 'v9'").collect()[0].n_tokens == 3
    rollup.remove()


def test_counts(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "a", "en", 0), (2, None, None, None, 0), (None, "", "a", "en", 0), (4, "word " * 50_000, "a", "en", 0)],
                                 "doc_id long, text string, source string, lang string, key int")
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = rollups.count_tokens(docs, {"x": "byte_bpe_50k.json", "y": "byte_bpe_multi_50k.tiktoken"}).collect()
    for r, d in zip(rows, docs.collect()):
        assert r.x == len(library.encode(d.text or "", add_special_tokens=False).ids) and (r.y > 0) == bool(d.text)
    assert rollups.count_tokens(docs.where(F.lit(False)), {"x": "byte_bpe_50k.json"}).count() == 0
