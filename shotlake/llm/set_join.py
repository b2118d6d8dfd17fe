"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; a signature holds 64 minimum hashes of it, each a token that two sets share with
the probability of their similarity. A run sends every set from the root to buckets of one or two sampled tokens (1 / threshold on
average) and splits a bucket again by tokens sampled for it until it is small, or until its sets are alike on average, as
near copies are. The sets of a bucket are compared with each other, by signature first and then exactly. Runs repeat until a pair at
the threshold is missed in all of them with a probability below 1 - recall, averaged over how many of its 64 minima agree.

A pair that meets in several buckets is counted in the lowest of them alone. A large bucket is cut into blocks that are compared
in pairs; sets that share a lower bucket need no comparison, so blocks hold sets of one lowest bucket where these are many. Equal sets
are one set with a count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlake.llm.common import (NO_ID, Run, components, drop, every_salt, grouped, link_rows, real_key, row_key, with_salt, worker_cache,
                                 written)

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.995
TOKENS, DEPTH, SMALL, BLOCK, BITS, ALIKE = 64, 8, 64, 256, 32, 0.5
# a signature agrees within 5 deviations of the similarity
SLACK = 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def missed(agree: float, depth: int, more: float | None = None) -> float:
    """The chance that a pair shares no bucket after `depth` levels of one run, if its tokens agree with the probability `agree` and a
    second token is taken with the probability `more` (by default as for a threshold of `agree`)."""
    more, q = 1 / agree - 1 if more is None else more, 0.0
    for _ in range(depth):
        one = 1 - agree + agree * q
        q = (1 - more) * one + more * one * one
    return q


def missed_by_all(runs: int, threshold: float, depth: int, tokens: int) -> float:
    """The chance that a pair at the threshold shares no bucket in any run, where all runs sample the same `tokens` minima: as many
    of these agree as a binomial law gives, and the runs are independent only for a given number of them."""
    return sum(math.comb(tokens, k) * threshold ** k * (1 - threshold) ** (tokens - k) * missed(k / tokens, depth, 1 / threshold - 1) ** runs
               for k in range(tokens + 1))


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, tokens: int | None = None) -> int:
    """Runs after which a pair at the threshold is missed with a probability of 1 - recall at most; `tokens`: the minima of a
    signature that all runs share, None if each run has fresh ones."""
    if tokens is None:
        return math.ceil(math.log(1 - recall) / math.log(missed(threshold, depth)))
    if missed_by_all(1 << 20, threshold, depth, tokens) > 1 - recall:
        raise ValueError(f"{tokens} minima can't give a recall of {recall}")
    runs = 1
    while missed_by_all(runs, threshold, depth, tokens) > 1 - recall:
        runs += 1
    return runs


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's runs of `words` words, sorted; words are lower case between white space.
    A text of fewer words is one run of them all, one without words none."""
    found, known = text.lower().split(), worker_cache("words")
    if not found:
        return np.zeros(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    h = np.array([known[w] for w in found], np.uint64)
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            total += mix(h[j:len(h) - k + 1 + j] * ODD[j % 5] + np.uint64(j))
    return np.unique(mix(total))


_RNG = np.random.default_rng(64)
FACTOR = _RNG.integers(1 << 62, 1 << 63, TOKENS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signature(x: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            out = np.minimum(out, ((x[i:i + 2048, None] * FACTOR[None, :]) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def token_path(path: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(path.astype(np.uint64) * ODD[0] + mix(value.astype(np.uint64) * ODD[1] + token.astype(np.uint64) * ODD[2]))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


SETS = "key long, text_hash long, h1 long, h2 long, size long, signature binary"


def sets_of(docs: DataFrame) -> DataFrame:
    """(key, text_hash, h1, h2, size, signature) for each row of `docs` (key, text_hash, text); (h1, h2, size) name the set."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for text in df["text"]:
                x = shingles(text or "")
                with np.errstate(over="ignore"):
                    rows.append((int(as_signed(np.add.reduce(mix(x), keepdims=True))[0]), int(as_signed(np.bitwise_xor.reduce(mix(x + ODD[3]), keepdims=True))[0]),
                                 len(x), signature(x).tobytes()))
            yield pd.concat([df[["key", "text_hash"]].reset_index(drop=True), pd.DataFrame(rows, columns=["h1", "h2", "size", "signature"])], axis=1)

    return docs.mapInPandas(work, SETS)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumn("key", row_key(F.col("doc_id"), text)).withColumn("text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each of BITS tokens, as an integer."""
    return ((sig[:, :BITS] & np.uint32(1)).astype(np.int64) << np.arange(BITS)).sum(axis=1)


def average_similarity() -> Column:
    """Of the sets of a bucket, from the share of ones in each bit of their sketches: two sets agree in a bit with
    the probability (1 + similarity) / 2."""
    each = [F.avg(F.shiftright("bits", t).bitwiseAND(1)) for t in range(BITS)]
    return sum(((2 * m - 1) * (2 * m - 1) for m in each), F.lit(0.0)) / BITS


def matrix(signatures: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), TOKENS)


# buckets ------------------------------------------------------------------------------------------------------

def first_buckets(nodes: DataFrame, runs: int) -> DataFrame:
    """(path, node, bits) of the first split of every run; the runs' tokens differ."""
    extra = max(1, round(1 / (1 / THRESHOLD - 1)))  # every so many runs take a second token
    chosen = [(r, t % TOKENS) for r in range(runs) for t in ((2 * r, 2 * r + 1) if r % extra == 0 else (2 * r,))]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sig = matrix(df["signature"])
            for r, t in chosen:
                path = token_path(np.full(len(df), r, np.uint64), np.full(len(df), t), sig[:, t])
                yield pd.DataFrame({"path": as_signed(path), "node": df["node"], "bits": sketch(sig)})

    return nodes.select("node", "signature").mapInPandas(work, "path long, node long, bits long")


def split_buckets(rows: DataFrame) -> DataFrame:
    """(path, node, bits) of the next split of `rows` (path, node, signature)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sig, path = matrix(df["signature"]), df["path"].to_numpy().view(np.uint64)
            draw = mix(path + ODD[4])
            for k in range(2):
                # one token for every bucket, a second one for a quarter of them at a threshold of 0.8
                use = np.ones(len(df), bool) if k == 0 else (draw >> np.uint64(40)).astype(float) / (1 << 24) < 1 / THRESHOLD - 1
                token = ((draw >> np.uint64(8 * k)) % np.uint64(TOKENS)).astype(int)
                if k:
                    token = np.where(token == (draw % np.uint64(TOKENS)).astype(int), (token + 1) % TOKENS, token)
                at = np.flatnonzero(use)
                new = token_path(path[at], token[at], sig[at, token[at]])
                yield pd.DataFrame({"path": as_signed(new), "node": df["node"].to_numpy()[at], "bits": sketch(sig[at])})

    return rows.mapInPandas(work, "path long, node long, bits long")


def final_buckets(nodes: DataFrame, runs: int) -> DataFrame:
    """(path, node) of the buckets to compare, of at least two sets each."""
    rows = written(first_buckets(nodes, runs), "paths")
    ends = []
    for level in range(1, DEPTH + 1):
        counts = rows.groupBy("path").agg(F.count("*").alias("n"), average_similarity().alias("alike")).where("n > 1")
        met = with_salt(rows, "node").join(every_salt(counts), ["path", "_salt"]).drop("_salt")
        met = met.withColumn("ends", (F.col("n") <= SMALL) | (F.col("alike") >= ALIKE) | F.lit(level == DEPTH))
        met = written(met, "buckets")
        drop(rows)
        ends.append(met.where("ends").select("path", "node"))
        large = met.where("NOT ends")
        if level == DEPTH or large.isEmpty():
            break
        rows = written(split_buckets(large.select("path", "node").join(nodes.select("node", "signature"), "node")), "paths")
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def block_pairs(buckets: DataFrame) -> DataFrame:
    """(path, a, b, node, own, paths): each set in every pair (a <= b) of blocks of its bucket that its own block
    is in. `paths` are all its buckets in ascending order."""
    lists = buckets.groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("paths"))  # some of each run
    rows = buckets.join(lists, "node").withColumn("low", F.element_at("paths", 1))
    rows = written(rows, "members")
    groups = rows.groupBy("path", "low").agg(F.count("*").alias("m"))
    sizes = groups.groupBy("path").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("m") < BLOCK, F.col("m")).otherwise(0)).alias("mixed"))
    small = sizes.where(F.col("n") <= 2 * BLOCK).select("path")
    zero = F.lit(0).cast("long")
    one = with_salt(rows, "node").join(every_salt(small), ["path", "_salt"]).select(
        "path", zero.alias("a"), zero.alias("b"), "node", zero.alias("own"), "paths")
    # larger buckets: blocks of one lowest bucket, or of the sets whose lowest bucket has few of them
    large = sizes.where(F.col("n") > 2 * BLOCK)
    pure = groups.where(F.col("m") >= BLOCK).join(large.select("path"), "path").select("path", "low", F.ceil(F.col("m") / BLOCK).alias("parts"))
    mixed = large.where("mixed > 0").select("path", F.lit(None).cast("long").alias("low"), F.ceil(F.col("mixed") / BLOCK).alias("parts"))
    parts = pure.union(mixed).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    parts = written(parts.withColumn("block", F.xxhash64("low", "part", F.col("low").isNull())), "blocks")
    left = parts.select("path", F.col("block").alias("a"), F.col("low").alias("low_a"))
    right = parts.select("path", F.col("block").alias("b"), F.col("low").alias("low_b"))
    met_below = F.coalesce((F.col("low_a") == F.col("low_b")) & (F.col("low_a") < F.col("path")), F.lit(False))
    pairs = left.join(right, "path").where((F.col("a") <= F.col("b")) & ~met_below).select("path", "a", "b")
    own = parts.select("path", F.coalesce("low", F.lit(0)).alias("_low"), F.col("low").isNull().alias("_mixed"), "parts").distinct()
    big = with_salt(rows, "node").join(every_salt(large.select("path")), ["path", "_salt"]).drop("_salt")
    big = with_salt(big, "node").join(every_salt(groups), ["path", "low", "_salt"]).drop("_salt")
    big = big.withColumn("_mixed", F.col("m") < BLOCK).withColumn("_low", F.when(F.col("m") < BLOCK, 0).otherwise(F.col("low")))
    big = with_salt(big, "node").join(every_salt(own), ["path", "_low", "_mixed", "_salt"]).drop("_salt")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    low = F.when(~F.col("_mixed"), F.col("low"))
    big = big.withColumn("own", F.xxhash64(low, part, F.col("_mixed")))
    sides = pairs.select("path", "a", "b", F.col("a").alias("own")).union(pairs.where("a <> b").select("path", "a", "b", F.col("b").alias("own")))
    return one.union(big.select("path", "own", "node", "paths").join(sides, ["path", "own"]).select("path", "a", "b", "node", "own", "paths"))


def lowest_shared(run: Run, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of `left` and `right` whether no bucket below this one holds both."""
    path, paths = run["path"][0], run["paths"]
    below = [p[: np.searchsorted(p, path)] for p in paths]
    out = np.ones((len(left), len(right)), bool)
    width = max(map(len, below))
    if width:
        table = np.full((len(below), width), 0, np.int64)
        for i, p in enumerate(below):
            table[i, : len(p)] = p
            table[i, len(p):] = -i - 1  # shared with none
        names, codes = np.unique(table, return_inverse=True)
        codes = codes.reshape(table.shape)
        seen = np.zeros((len(below), len(names)), np.float32)
        seen[np.arange(len(below))[:, None], codes] = 1
        out = seen[left] @ seen[right].T == 0
    return out


def sides(run: Run) -> tuple[np.ndarray, np.ndarray, bool]:
    a, b = run["a"][0], run["b"][0]
    return np.flatnonzero(run["own"] == a), np.flatnonzero(run["own"] == b), a == b


def plausible(run: Run) -> dict | None:
    """The sets that have a partner by signature in this pair of blocks."""
    left, right, same = sides(run)
    sig, size = matrix(run["signature"]), run["size"]
    agree = np.zeros((len(left), len(right)), np.uint8)
    for t in range(TOKENS):
        agree += sig[left, t][:, None] == sig[right, t][None, :]
    ok = (agree >= (THRESHOLD - SLACK) * TOKENS) & (size[left][:, None] * 1.0 >= THRESHOLD * size[right][None, :]) & (size[right][None, :] >= THRESHOLD * size[left][:, None])
    if same:
        ok &= left[:, None] < right[None, :]
    if ok.any():
        ok &= lowest_shared(run, left, right)
    keep = np.zeros(len(size), bool)
    keep[left[ok.any(axis=1)]] = True
    keep[right[ok.any(axis=0)]] = True
    if not keep.any():
        return None
    return {c: run[c][keep] for c in ("path", "a", "b", "node", "own", "paths")}


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by products of 0/1 matrices over the members found twice."""
    sizes = np.array(list(map(len, sets)))
    names, codes, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, twice = np.repeat(np.arange(len(sets)), sizes), n > 1
    rank = np.cumsum(twice) - 1
    use = twice[codes]
    row, column = row[use], rank[codes[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 14
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(twice.sum()), width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((len(sets), min(width, int(twice.sum()) - a)), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def exact(run: Run) -> dict | None:
    """The links of this pair of blocks, by true similarity."""
    left, right, same = sides(run)
    if not len(left) or not len(right):
        return None
    sets = [np.frombuffer(x, np.uint64) for x in run["members"]]
    size = run["size"].astype(float)
    shared = shared_counts(sets)[np.ix_(left, right)]
    # shared / (x + y - shared) >= threshold, without rounding: 10 s >= 8 (x + y - s)
    ok = shared * (1 + THRESHOLD) >= THRESHOLD * (size[left][:, None] + size[right][None, :]) - 1e-6
    if same:
        ok &= left[:, None] < right[None, :]
    if ok.any():
        ok &= lowest_shared(run, left, right)
    i, j = np.nonzero(ok)
    return link_rows(run["node"], run["copies"], left[i], right[j])


# the join -----------------------------------------------------------------------------------------------------

def near_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, text_hash, class_id, n_links) for each row of `docs` (doc_id, text): the documents whose shingle
    sets are similar to its own by THRESHOLD or more, and the smallest doc_id reachable over such links.

    NULL and empty texts, and texts of white space, link with nothing; a text of fewer than five words is one shingle. Rows
    without doc_id take part and have a NULL class_id if their class has no id. Repeated rows link with each other. An empty table
    gives an empty one. Other columns play no part.
    """
    docs = keyed(docs.select("doc_id", "text"))
    sets = written(sets_of(docs.select("key", "text_hash", F.col("text").cast("string").alias("text"))), "sets")
    name = ["h1", "h2", "size"]
    nodes = written(sets.where("size > 0").groupBy(*name).agg(
        F.min(F.struct("key", "text_hash")).alias("least"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
        .select(*name, F.col("least.key").alias("node"), F.col("least.text_hash").alias("text_hash"), "copies", "signature"), "nodes")
    # two sets of one doc_id can't share a name: the second takes its own, and `id` stays the least doc_id of both
    twin = nodes.groupBy("node").agg(F.count("*").alias("m"), F.min("h1").alias("h")).where("m > 1").select("node", "h")
    twins = not twin.isEmpty()
    if twins:
        own = F.when(F.col("h").isNotNull() & (F.col("h1") != F.col("h")), F.lit(NO_ID) + F.pmod(F.xxhash64(*name), F.lit(1 << 61))).otherwise(F.col("node"))
        nodes = written(nodes.join(twin, "node", "left").withColumn("own", own).withColumn("id", F.col("node")).drop("node", "h").withColumnRenamed("own", "node"), "nodes")
    else:
        nodes = nodes.withColumn("id", F.col("node"))
    buckets = final_buckets(nodes, runs_needed(recall=recall, tokens=TOKENS))
    pairs = block_pairs(buckets)
    close = grouped(pairs.join(nodes.select("node", "size", "signature"), "node"), ["path", "a", "b"], plausible,
                    "path long, a long, b long, node long, own long, paths array<long>")
    close = written(close, "close")
    wanted = close.select("node").distinct().join(nodes, "node").select("node", "size", "copies", F.col("id").alias("key"), "text_hash")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.drop(columns="text").assign(members=[shingles(t or "").tobytes() for t in df["text"]])

    texts = docs.join(wanted, ["key", "text_hash"]).select("node", "size", "copies", F.col("text").cast("string").alias("text"))
    payload = texts.mapInPandas(members, "node long, size long, copies long, members binary").dropDuplicates(["node"])
    links = written(grouped(close.join(payload, "node"), ["path", "a", "b"], exact, "node long, n long, root long"), "links")
    found = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    table = (nodes.join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(found, "node", "left")
             .select(*name, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"),
                     "node", "id", F.col("text_hash").alias("least_hash")))
    if twins:
        # a made node is no doc_id and sorts after all of them: a component is led by its least (id, text_hash)
        table = written(table, "named")
        leads = table.groupBy("component").agg(F.min(F.struct("id", "least_hash")).alias("lead"))
        table = with_salt(table, "node").join(every_salt(leads), ["component", "_salt"]).drop("_salt")
        table = table.withColumn("class", F.col("lead.id")).withColumn("leads", F.struct("id", "least_hash") == F.col("lead")).drop("lead")
    else:
        table = table.withColumn("class", F.col("component")).withColumn("leads", F.col("node") == F.col("component"))
    rows = with_salt(sets.drop("signature"), "key", "text_hash").join(every_salt(table), [*name, "_salt"], "left")
    keeps = (F.col("size") == 0) | (F.col("leads") & (F.col("key") == F.col("id")) & (F.col("text_hash") == F.col("least_hash")))
    return rows.select(real_key(F.col("key")).alias("doc_id"), "key", "text_hash", real_key(F.coalesce("class", "key")).alias("class_id"),
                       F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), keeps.alias("keeps"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each class: that of the smallest doc_id, and of several of it that of the smallest hash.
    Texts without words all stay, and so does each text of a repeated doc_id that links with nothing."""
    rows = written(near_classes(docs, **how), "classes")
    out = rows.where("NOT keeps").select("key", "text_hash").distinct()
    taken = ["_llm_key", "_llm_hash"]
    text = F.col("text").cast("string")
    named = docs.withColumn(taken[0], row_key(F.col("doc_id"), text)).withColumn(taken[1], F.xxhash64(F.coalesce(text, F.lit(""))))
    named = named.join(out.toDF(*taken), taken, "left_anti")
    again = rows.where("keeps AND n_links > 0").groupBy("key", "text_hash").count().where("count > 1").select("key", "text_hash")
    if again.isEmpty():
        return named.select(*docs.columns)
    again = written(again.toDF(*taken), "again")
    single = named.join(again, taken, "left_semi").dropDuplicates(taken)
    return named.join(again, taken, "left_anti").union(single).select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS c, count(*) AS copies, s, len(s) AS n FROM s GROUP BY s),
u AS MATERIALIZED (SELECT c, n, unnest(s) AS x FROM c),
m AS (SELECT a.c AS a, b.c AS b FROM u a JOIN u b ON a.x = b.x AND a.c <> b.c AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8
      GROUP BY a.c, b.c, a.n, b.n HAVING count(*) * 18 >= 8 * (a.n + b.n)),
r AS (SELECT a AS x, b AS y FROM m UNION SELECT r.x, m.b FROM r JOIN m ON r.y = m.a),
k AS (SELECT c.c, c.s, copies - 1 + coalesce((SELECT sum(o.copies) FROM m JOIN c o ON o.c = m.b WHERE m.a = c.c), 0) AS n_links,
             least(c.c, coalesce((SELECT min(y) FROM r WHERE r.x = c.c), c.c)) AS class_id FROM c)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN k ON k.s = s.s
"""
