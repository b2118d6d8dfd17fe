"""Mixing against plain Python, and its edge cases."""

import hashlib
import math
from collections import defaultdict

import pytest

from shotlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_key string, n int"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def brute(data, entropy, repeats, block):
    tokens = defaultdict(int)
    for d in data:
        tokens[d[2]] += len((d[1] or "").split()) + 1
    total, k = sum(tokens.values()), len(tokens)
    low, high = 0.0, 1.0
    for _ in range(40):
        a = (low + high) / 2
        z = sum((t / total) ** a for t in tokens.values())
        h = -sum((t / total) ** a / z * math.log((t / total) ** a / z) for t in tokens.values())
        flat = h > entropy * math.log(k) or (max(tokens.values()) / min(tokens.values())) ** (1 - a) > repeats
        low, high = (a, high) if flat else (low, a)
    z = sum((t / total) ** high for t in tokens.values())
    weight = {s: (t / total) ** high / z for s, t in tokens.items()}
    budget = max(tokens[s] / weight[s] for s in tokens)
    plan = {s: max(tokens[s], math.floor(weight[s] * budget + 0.5)) for s in tokens}
    blocks, out = math.ceil(sum(plan.values()) / block), []
    for s in tokens:
        start, epoch = 0, 0
        while start < plan[s]:
            def key(d):
                name = "-" if d[0] is None else str(d[0])
                return (hashlib.md5(f"7:{epoch}:{name}".encode()).hexdigest(), d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).hexdigest())
            for d in sorted((d for d in data if d[2] == s), key=key):
                if start < plan[s]:
                    n = len((d[1] or "").split()) + 1
                    out.append((d[0], s, epoch, start, n, math.floor(start / plan[s] * blocks)))
                    start += n
            epoch += 1
    return out


DATA = [(i, "w " * (i % 5), f"s{0 if i % 3 else i % 7}", "x", i) for i in range(120)]
EDGE = [(None, None, None, None, None), (1, "", "a", "k", 0), (1, "", "a", "k", 0), (2, "long " * 30_000, None, "k", 1), (3, "b c", "", "k", 2)]


@pytest.mark.parametrize("data", [DATA, EDGE])
def test_same_as_plain_python(spark, data):
    docs = rows(spark, data)
    got = mixing.place(docs, block_tokens=50).select("doc_id", "source", "mix_epoch", "mix_start", "mix_tokens", "mix_block").collect()
    null = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted(map(tuple, got), key=null) == sorted(brute(data, mixing.TARGET_ENTROPY, mixing.MOST_REPEATS, 50), key=null)


def test_every_document_stays_and_blocks_are_whole(spark):
    docs = rows(spark, DATA)
    out = mixing.permute_blocks(mixing.place(docs, block_tokens=64)).collect()
    assert {r.doc_id for r in out} == {d[0] for d in DATA}
    blocks = defaultdict(list)
    for r in out:
        blocks[r.mix_block].append(r.mix_position)
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values())


def test_budget_and_empty(spark):
    docs = rows(spark, DATA)
    out = mixing.place(docs, budget_tokens=60).groupBy().agg({"mix_tokens": "sum"}).first()[0]
    assert 60 <= out <= 60 + 5 * 7
    assert mixing.mix(rows(spark, [])).count() == 0
    assert mixing.mix(docs).columns == [c for c in docs.columns if c != "mix_key"]
