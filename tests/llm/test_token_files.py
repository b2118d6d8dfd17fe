"""Codes against a plain Huffman tree, and round trips through files."""

import heapq
import random
import uuid
import zlib

import numpy as np
from tokenizers import Tokenizer

from shotlake.llm import token_files as H
from shotlake.llm.tokens import ByteLevel, tokenizer_file


def tree_cost(counts):
    heap, cost = sorted(int(c) for c in counts if c), 0
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(2)
    for n in (2, 3, 50, 700):
        counts = rng.integers(1, 60, n)
        lengths = H.code_lengths(counts)
        assert (counts * lengths).sum() == tree_cost(counts) and sum(2.0 ** -lengths.astype(float)) == 1
    steep = np.array([2 ** min(i, 50) for i in range(60)])
    assert H.code_lengths(steep, 8).max() <= 8
    assert H.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_stretches_equal_the_library():
    own, library = ByteLevel("byte_bpe_50k.json"), Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    random.seed(1)
    parts = list("ab 1 \n\t'sé! \x1c\x85\xa0 ,  don't  we'll \r\n x漢　") + ["<|endoftext|>"]
    for _ in range(2000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_files(spark):
    random.seed(4)
    data = [(i, " ".join(random.choice(["the", "cat", "Zürich", "0x7f", "\n"]) for _ in range(random.randint(0, 900)))) for i in range(60)]
    data += [(None, "no id"), (None, None), (7, "same id"), (7, "same id"), (99, "word " * 60_000), (-3, "")]
    random.shuffle(data)
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, start int")
    path = f"{H.folder(spark)}/llm-test-{uuid.uuid4().hex}"
    H.write_tokens(docs, path)
    rows = sorted(H.read_tokens(spark, path).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0
    want = sorted((d is not None, d or 0, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in data)
    got = [(r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows]
    assert [g[:2] for g in got] == [w[:2] for w in want] and sorted(got) == want
    for r in rows:
        assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_empty(spark):
    assert H.token_file_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
