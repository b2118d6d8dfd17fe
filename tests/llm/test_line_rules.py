"""Line rules against literal lines, and counts against plain counting."""

import random
import re

import pytest

from shotlake.llm import line_rules as rules

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i:i + k]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + k)})


def test_repeated_words():
    rng = random.Random(1)
    for size in (0, 1, 7, 8, 9, 30, 200):
        for kinds in (1, 2, 3, 40):
            words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
            words += words[3:17] * rng.randrange(3)
            assert rules.repeated_words(words) == plain_repeats(words)
    assert rules.repeated_words(["a"] * 8) == 0 and rules.repeated_words(["a"] * 9) == 9


PROSE = "The river ran past the old mill, and nobody had worked there in years."


@pytest.mark.parametrize("line,rule", [
    (PROSE, None), ("Chapter one", "punctuation"), ("So it goes.", None), ("Why?", None), ("he said: \"no\"", None), ("Три слова здесь", None),
    ("a### b*** c%%% d&&&", "punctuation"), ("Rate: 5% of $100 in one year & more was asked for it.", None), ("Home", "punctuation"), ("Home About Contact Us", "navigation"),
    ("first • second • third", "navigation"), ("Home » News » Today", "navigation"), ("one > two > three four.", "navigation"), ("one > two > three four five six.", None),
    ("Copyright © 2020 by someone, all of it.", "boilerplate"), ("Tous droits réservés par nous.", "boilerplate"), ("Please read our Privacy Policy.", "boilerplate"),
    (" ".join([PROSE] * 3) + " They wrote a privacy policy.", None)])
def test_lines(line, rule):
    assert rules.failing_rule(line, WORDS.findall(line)) == rule


def test_documents(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) for _ in range(9)) + "."
    clean = "\n".join(sentence() for _ in range(6))
    mixed = clean + "\n\nHome | News | Shop\n" + clean.split("\n")[0] + "\nAll rights reserved."
    lossy = clean.split("\n")[0] + "\n" + "\n".join(f"a{i} | b{i} | c{i}" for i in range(9))
    long = "\n".join(sentence() for _ in range(20_000))
    rows = [(1, clean, 0, "x"), (1, clean, 0, "x"), (2, mixed, 0, "x"), (3, lossy, 0, "x"), (4, None, 0, "x"), (5, "", 0, "x"), (None, clean, 0, "x"), (6, "w " * 500, 0, "x"),
            (7, long, 0, "x"), (8, " \n\t\x0b\n", 0, "x"), (9, "one\xa0two\x1fthree four", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, kept string")
    out = rules.judge_lines(docs).collect()
    assert len(out) == len(rows) and out[0].kept == "x"
    for (doc, text, *_), r in zip(rows, out):
        words, q, seen = WORDS.findall(text or ""), r.quality, set()
        dup = 0
        for line in (text or "").split("\n"):
            dup += bool(WORDS.search(line)) and line in seen
            seen.add(line)
        assert (r.doc_id, q.n_words, q.word_chars, q.n_dup_lines) == (doc, len(words), sum(map(len, words)), dup)
        assert q.n_symbols == len(re.findall("[#*$%&|<>]", text or "")) and q.n_repeat_words == plain_repeats(words)
        assert q.base_failed == (len(words) < 20 or 100 * q.n_repeat_words > 30 * len(words))
    by = {r.doc_id: r.quality for r in out}
    assert [by[k].kept for k in (1, 2, 3, 4, 5, 6, None)] == [True, True, False, False, False, False, True]
    assert by[2].text == clean + "\n" and (by[2].n_repeat_lines, by[2].n_boilerplate_lines) == (1, 1)
    kept = rules.keep_clean(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect())[:2] == ["1", "1"]
    assert rules.judge_lines(docs.limit(0)).count() == 0
