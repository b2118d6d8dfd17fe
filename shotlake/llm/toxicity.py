"""Toxicity by maximum-scoring segments.

Words get the log-odds of toxic against clean documents under an informative
Dirichlet prior. A linear scan over these scores finds every maximal segment of
a text, those beyond what chance gives in a text of that length (the
extreme-value law of such segments) are its toxic passages, and a logistic curve over the
passages' evidence turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
# the model's bounds: labelled rows it learns from, words it keeps
MOST_ROWS, MOST_WORDS = 50_000, 50_000
PRIOR, FLOOR, LEAST_Z = 0.3, 0.35, 3.5
FOLDS = (0, 1, 3)
HELD_OUT = 2
STEMS = (3, 5, 7)
CUT = 0.3


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def parts_of(word: str) -> list[str]:
    """The word and, marked, its beginnings: inflected forms share them."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) >= k)]


# segments -----------------------------------------------------------------------------------------------------

def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) of `scores`, in linear time.

    Runs of one sign are summed first, so the scan itself only meets the positive runs. It keeps
    candidates with the running sums before (l) and after (r) them; a new run joins every candidate back to the
    nearest one that starts lower, unless that one already reached as high.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    sign = scores > 0
    cuts = np.flatnonzero(np.diff(sign)) + 1
    starts = np.concatenate([[0], cuts])
    sums = np.add.reduceat(scores, starts)
    ends = np.concatenate([cuts, [len(scores)]])
    total, kept = 0.0, []  # (start, end, l, r)
    for a, b, x in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if x <= 0:
            total += x
            continue
        now = (a, b, total, total + x)
        total += x
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= now[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= now[3]:
                kept.append((*now, j))
                break
            now = (kept[j][0], now[1], kept[j][2], now[3])
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r, _ in kept]


# the model ----------------------------------------------------------------------------------------------------

def word_scores(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z) of each word or beginning with a prior in proportion to its overall frequency (of PRIOR times the
    smaller side's mass); those that do not stand out by LEAST_Z deviations have z 0."""
    both = toxic + clean + 1e-9
    if not len(both) or not toxic.sum() or not clean.sum():
        return np.zeros(len(both)), np.zeros(len(both))
    size = PRIOR * min(toxic.sum(), clean.sum())
    prior = size * both / both.sum()
    odds = lambda y: np.log((y + prior) / (y.sum() + size - y - prior))
    delta = odds(toxic) - odds(clean)
    z = delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return delta, np.where(np.abs(z) >= LEAST_Z, z, 0.0)


def decay(scores: np.ndarray, weight: np.ndarray) -> float:
    """The lambda of the extreme-value law: the positive root of sum p exp(lambda s) = 1 over clean words."""
    if not len(scores) or scores.max() <= 0 or (scores * weight).sum() >= 0:
        return 1.0
    p, low, high = weight / weight.sum(), 1e-6, 1.0
    total = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum())
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


class Scorer:
    """Word scores, the extreme-value law (lam, log_k), and the curve from evidence to score.

    A word takes the log-odds of whichever of its parts stands out most, less FLOOR; one without a part that
    stands out has -FLOOR, so texts drift down between toxic words.
    """

    def __init__(self, words: list[str], delta: np.ndarray, z: np.ndarray):
        self.known = {w: (abs(x), d) for w, d, x in zip(words, delta.tolist(), z.tolist()) if x}
        self.lam, self.log_k, self.curve = 1.0, 0.0, None
        self.seen: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def of(self, word: str) -> float:
        best = max((self.known[p] for p in parts_of(word) if p in self.known), default=(0.0, 0.0))
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[word] = best[1] - FLOOR
        return best[1] - FLOOR

    def calibrate(self, words: list[str], clean: np.ndarray) -> None:
        whole = [i for i, w in enumerate(words) if w[0] != "^"]
        self.lam = decay(np.array([self.of(words[i]) for i in whole]), clean[whole])

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        found, seen, of = WORD.findall(text.lower()), self.seen, self.of
        return len(found), maximal_segments(np.array([seen[w] if w in seen else of(w) for w in found]))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
        """What the curve sees, and the significant passages: those of which chance gives under 0.05 in n words."""
        far = self.log_k + math.log(max(n, 1))
        bits = [(a, b, self.lam * s - far) for a, b, s in segments]
        good = [x for x in bits if x[2] > 3.0]
        best = max([-10.0, *(x[2] for x in bits)])
        return [min(best, 30.0), math.log1p(sum(x[2] for x in good)), math.log1p(len(good))], good

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        seen, good = self.evidence(*self.segments(text))
        if self.curve is None:
            return 0.0, good
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + float(np.dot(self.curve[1:], seen))))))), good


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(text, toxic, fold) of the labelled rows that are not held out; the `most` of lowest hash if there are more."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder(F.col("_id")) != HELD_OUT).withColumn("fold", remainder(F.col("_id")).cast("int"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    # at most `most` rows of three numbers: bounded whatever the input
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "_id").select("text", "toxic", "fold")


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c00, c01, c10, ...): documents with the word, by fold and label; summed in each task first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            return pd.DataFrame({"word": [k[0] for k in keys], "at": [k[1] for k in keys], "n": [seen[k] for k in keys]})

        for df in batches:
            for text, toxic, fold in zip(df["text"], df["toxic"], df["fold"]):
                at = 2 * FOLDS.index(fold) + toxic
                seen.update((p, at) for p in {p for w in set(WORD.findall(text.lower())) for p in parts_of(w)})
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    at = [F.sum(F.when(F.col("at") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(6)]
    return rows.mapInPandas(count, "word string, at int, n long").groupBy("word").agg(*at)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS) -> Scorer:
    """Learn from labelled rows that are not held out. The curve is fitted on scores that the row's own fold did
    not teach: word scores of the other two folds."""
    rows = train_rows(docs, labels, most_rows)
    toxic, clean = (sum(F.col(f"c{i}") for i in range(b, 6, 2)) for b in (1, 0))
    ranked = count_words(rows).where(toxic + clean >= 3).orderBy(F.desc(toxic / (clean + toxic + 2)), F.desc(toxic), "word").limit(most_words)
    table = ranked.toPandas()
    words, counts = table["word"].tolist(), table[[f"c{i}" for i in range(6)]].to_numpy(float)

    def scorer(folds) -> Scorer:
        y, n = (counts[:, [2 * f + b for f in folds]].sum(axis=1) for b in (1, 0))
        out = Scorer(words, *word_scores(y, n))
        out.calibrate(words, n + 0.01)
        return out

    parts, whole = [scorer([g for g in range(3) if g != f]) for f in range(3)], scorer(range(3))

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for text, y, fold in zip(df["text"], df["toxic"], df["fold"]):
                n, found = parts[FOLDS.index(fold)].segments(text)
                out.append((y, FOLDS.index(fold), n, [float(x) for a, b, s in found for x in (a, b, s)]))
            yield pd.DataFrame(out, columns=["y", "f", "n", "found"])

    seen = rows.mapInPandas(top, "y int, f int, n long, found array<double>").toPandas()  # at most most_rows rows
    segments = [[(x[i], x[i + 1], x[i + 2]) for i in range(0, len(x), 3)] for x in seen["found"]]
    if not len(seen) or not seen["y"].any():
        return whole
    # K from the mean of the largest segment of clean texts, which the law puts at (ln(K n) + 0.577) / lambda
    for f, part in enumerate(parts):
        best = [part.lam * max([0.0, *(s for _, _, s in x)]) - math.log(max(n, 1))
                for x, n, y, g in zip(segments, seen["n"], seen["y"], seen["f"]) if g == f and not y]
        part.log_k = float(np.mean(best)) - 0.5772 if best else 0.0
    whole.log_k = float(np.mean([p.log_k for p in parts]))
    x = np.array([parts[f].evidence(n, s)[0] for f, n, s in zip(seen["f"], seen["n"], segments)])
    whole.curve = logistic(x, seen["y"].to_numpy(float))
    return whole


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """`docs` (doc_id, text, any others) with a column `toxicity` (held_out, score, predicted, passages).

    passages are the significant ones, by word position from 0, end exclusive, with their evidence. NULL and empty
    texts are scored as texts without words; rows without doc_id are scored but teach nothing; repeated
    rows get equal scores; without any toxic label all scores are 0. `toxicity` replaces a column of that name.
    """
    model = fit(docs, labels, **bounds)

    def score(texts: pd.Series) -> pd.DataFrame:
        got = [model.score(t or "") for t in texts]
        return pd.DataFrame({"score": [s for s, _ in got],
                             "passages": [[{"start": int(a), "end": int(b), "evidence": e} for a, b, e in p] for _, p in got]})

    scored = F.pandas_udf(score, "score double, passages array<struct<start:int, end:int, evidence:double>>")
    out = docs.withColumn("toxicity", scored(F.col("text").cast("string")))
    return out.withColumn("toxicity", F.struct(
        F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
        F.when(F.col("toxicity.score") >= CUT, 1).otherwise(0).alias("predicted"), F.col("toxicity.passages").alias("passages")))


def reject_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """`docs` without those predicted toxic."""
    return score_toxicity(docs, labels, **bounds).where("toxicity.predicted = 0").select(*docs.columns)
