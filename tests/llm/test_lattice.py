"""Sampled segmentations against the exact law of small lattices, and round trips."""

import math
import random
from collections import Counter
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.llm import lattice as L


@pytest.fixture(scope="module")
def tool():
    return L.Sampler("piece_bpe_32k.model")


def all_segmentations(pieces, text):
    """Every segmentation of ' ' + text with its probability."""
    table, out = {p: i for p, i in pieces.ids.items()}, {}
    text = " " + text

    def go(at, path):
        if at == len(text):
            out[tuple(path)] = math.exp(sum(pieces.weight[i] for i in path))
            return
        for b in range(at + 1, len(text) + 1):
            if text[at:b] in table:
                go(b, path + [table[text[at:b]]])
        if text[at] not in table:
            go(at + 1, path + [pieces.bytes[x] for x in text[at].encode()])

    go(0, [])
    total = sum(out.values())
    return {p: w / total for p, w in out.items()}


def test_exact_law(tool):
    """First samples follow the distribution; pairs follow the law of drawing two without replacement."""
    text = "the é tin"
    law, n = all_segmentations(tool.pieces, text), 6000
    assert sum(law.values()) == pytest.approx(1)
    first, second = Counter(), Counter()
    for seed in range(n):
        a, b = tool.sample(text, seed, 2)
        assert tuple(a[0]) != tuple(b[0]) and a[2] > b[2]
        assert a[1] == pytest.approx(math.log(law[tuple(a[0].tolist())]), abs=1e-6)
        first[tuple(a[0].tolist())] += 1
        second[tuple(b[0].tolist())] += 1
    for p, q in sorted(law.items(), key=lambda x: -x[1])[:6]:
        assert first[p] / n == pytest.approx(q, abs=5 * math.sqrt(q / n) + 0.002)
        both = sum(law[o] * q / (1 - law[o]) for o in law if o != p)
        assert second[p] / n == pytest.approx(both, abs=5 * math.sqrt(both / n) + 0.002)


def test_all_segmentations_come_out_once(tool):
    law = all_segmentations(tool.pieces, "tin a")
    got = [tuple(x[0].tolist()) for x in tool.sample("tin a", 5, 10_000)]
    assert len(got) == len(set(got)) == len(law) and set(got) == set(law)
    assert tool.sample("tin a", 5, 10_000)[0][3] == 0.0
    values = [x[2] for x in tool.sample("tin a", 5, 20)]
    assert values == sorted(values, reverse=True)


def test_inclusion_scores(tool):
    """1/q weighting by inclusion scores gives unbiased sums."""
    text = "tin"
    law = all_segmentations(tool.pieces, text)
    total = [sum(math.exp(x[1] - x[3]) for x in tool.sample(text, s, 3)) for s in range(3000)]
    assert np.mean(total) == pytest.approx(sum(law.values()), abs=0.03)


def test_round_trip(tool):
    random.seed(8)
    parts = ["the", " ", "  ", "\n", "é", "漢字", "▁", "\x00", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0x7f", "🙂", "ing", "\t"]
    for seed in range(400):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        rows = tool.sample(text, seed, 3)
        assert all(tool.pieces.decode(ids) == text for ids, *_ in rows)
        assert len({tuple(r[0].tolist()) for r in rows}) == len(rows)
    long = "word" * 30_000
    assert all(tool.pieces.decode(ids) == long for ids, *_ in tool.sample(long, 1, 2))


def test_same_without_tables(tool):
    """Log-probabilities are those of the plain lattice, and tables made in bulk those of one atom at a time."""
    fresh = L.Sampler("piece_bpe_32k.model")
    for seed in range(8):
        for ids, x, *_ in fresh.sample("interesting things", seed, 2):
            want = sum(tool.pieces.weight[i] for i in ids) - sum(L.Atom(tool.pieces, t).log_total for t in (" interesting", " things"))
            assert x == pytest.approx(want, abs=1e-6)
    random.seed(12)
    texts = list({" " * random.randint(0, 1) + "".join(random.choice("thinger") for _ in range(random.randint(1, 14))) for _ in range(300)})
    text, log_p, ids, sizes, whole = L.bulk_best(tool.pieces, texts, 4)
    ends = np.cumsum(sizes)
    for i, x in enumerate(texts):
        best, all_of_it = L.Atom(tool.pieces, x).best(4)
        mine = np.flatnonzero(text == i)
        assert all_of_it == whole[i] and log_p[mine] == pytest.approx([q for q, _ in best], abs=1e-9)
        spelled = [b"".join(tool.pieces.spelled[j] for j in ids[ends[m] - sizes[m]:ends[m]]).decode() for m in mine]
        assert spelled == [x] * len(best)


def test_frame(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "the cat", 3), (5, "the cat sat", 3), (5, "the cat sat", 3)], "doc_id long, text string, sample int")
    rows = L.encode_samples(docs, 2).collect()
    assert all(r.pieces.decoded for r in rows) and len(rows) == 2 + 2 + 4
    same = [r.pieces.ids for r in rows if r.doc_id == 5 and r.pieces.sample == 1]
    assert same[0] == same[1]
    again = L.encode_samples(docs.repartition(3), 2).where("doc_id = 5").collect()
    assert {tuple(r.pieces.ids) for r in again} == {tuple(r.pieces.ids) for r in rows if r.doc_id == 5}
    back = L.decode_pieces(L.encode_samples(docs, 1).select("doc_id", "text", F.col("pieces.ids").alias("ids"))).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert L.encode_samples(docs.limit(0), 2).count() == 0


def test_forgets_words_met_once(monkeypatch):
    """Full tables keep the words that came again, and samples stay those of tables that hold everything."""
    monkeypatch.setattr(L, "MOST_WORDS", 40)
    small, whole = L.Sampler("piece_bpe_32k.model"), L.Sampler("piece_bpe_32k.model")
    random.seed(3)
    texts = ["the thing " + " ".join("".join(random.choice("thingérs") for _ in range(random.randint(1, 9))) for _ in range(12)) for _ in range(60)]
    most = 0
    for seed, text in enumerate(texts):
        got = small.sample(text, seed, 3)
        most = max(most, len(small.units))
        with monkeypatch.context() as m:
            m.setattr(L, "MOST_WORDS", 1 << 30)
            want = whole.sample(text, seed, 3)
        assert [(tuple(a[0].tolist()), a[1:]) for a in got] == [(tuple(a[0].tolist()), a[1:]) for a in want]
    assert most <= 40 + 14 and len(whole.units) > 400 and {" the", " thing"} <= small.units.keys()


def test_found_in_order(tool):
    """Segmentations that are listed when asked for come as in the list of the likeliest, again and from any place on."""
    random.seed(4)
    for _ in range(200):
        text = "".join(random.choice("thingerés漢 ") for _ in range(random.randint(1, 12)))
        atom, twin = L.Atom(tool.pieces, text), L.Atom(tool.pieces, text)
        assert list(islice(atom.in_order(), 3)) == twin.best(3)[0]
        assert list(islice(atom.in_order(), 64)) == twin.best(64)[0] and atom.likeliest(64) == twin.best(64)


def test_tables_of_a_given_size(spark):
    """Fewer words are held than are met, by tables that know a word and its atoms by numbers; samples stay the same."""
    random.seed(6)
    docs = spark.createDataFrame([(i, " ".join("".join(random.choice("thingérs") for _ in range(random.randint(1, 9))) for _ in range(12)))
                                  for i in range(900)], "doc_id long, text string").coalesce(1)
    few = L.encode_samples(docs, held=500).collect()
    assert few == L.encode_samples(docs, held=100_000).collect() and all(r.pieces.decoded for r in few)


def test_no_ids_spell_the_empty_text():
    pieces = L.Sampler("piece_bpe_32k.model").pieces
    assert pieces.decode(np.array([])) == pieces.decode(np.array([], np.int32)) == ""
