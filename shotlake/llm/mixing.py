"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

The share of a source in all tokens, raised to an exponent between 0 and 1 and
normalised, is its weight. The exponent is bisected: the largest that still has
the target entropy, raised as far as the limit on repetitions asks. Each
source then streams its documents in a seeded permutation, epoch after epoch,
until its budget of tokens is used; equal fractions of all streams make a
block, so every block holds the sources in their target proportions, and the
rows of a block are permuted again.

Only DataFrame functions run; the driver sees a few sums for each exponent tried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.llm.common import written

# fixed value: a word, spelled so that Java and RE2 read it alike
WORD = r"[^ \t\n\r]+"
LEVELS, AT_ONCE = 40, 5
CHUNK, SUPER = 256, 1024
TARGET_ENTROPY, MOST_REPEATS, BLOCK_TOKENS, SEED = 0.9, 4.0, 131_072, "7"


def n_tokens(text: Column) -> Column:
    """Words of the text and one end mark; an empty or NULL text has the mark alone."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long") + 1


def _key(source: Column) -> Column:
    """A source of its own for NULL."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def source_totals(docs: DataFrame) -> DataFrame:
    """A row (key, docs, tokens) for each source."""
    return docs.groupBy(_key(F.col("source")).alias("key")).agg(F.count("*").alias("docs"), F.sum(n_tokens(F.col("text"))).alias("tokens"))


def find_exponent(totals: DataFrame, target_entropy: float, most_repeats: float) -> float:
    """Bisect the exponent on a grid of 2**-LEVELS; AT_ONCE halvings to a job.

    An exponent is too flat if the entropy of its weights is above `target_entropy`
    (a fraction of that of equal weights) or if the smallest source repeats more
    than `most_repeats` times as often as the largest. Both fall as it rises; the
    result is the end of the flat range, 1 if all of it is flat, as for equal sources.
    """
    k, total, least, most = totals.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not k:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, step = 0.0, 1.0
    for _ in range(LEVELS // AT_ONCE):
        step /= 1 << AT_ONCE
        tries = [low + step * j for j in range(1, 1 << AT_ONCE)]
        power = F.pow(share, F.col("a"))
        sums = (totals.withColumn("a", F.explode(F.array(*map(F.lit, tries))))
                .groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("s")).collect())
        flat = [a for a, z, s in sums
                if math.log(z) - a * s / z > target_entropy * math.log(k) or (most / least) ** (1 - a) > most_repeats]
        low = max([low, *flat])
    return low + step


def plan(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS,
         budget_tokens: float | None = None) -> DataFrame:
    """A row (key, docs, tokens, weight, budget) for each source. Without `budget_tokens` the
    total is the least that gives every source one whole epoch, so no document is left out."""
    a = find_exponent(totals, target_entropy, most_repeats)
    total, z, most = totals.agg(F.sum("tokens"), F.lit(0), F.max("tokens")).first()
    if total:
        share = F.col("tokens") / F.lit(float(total))
        z = totals.agg(F.sum(F.pow(share, F.lit(a)))).first()[0]
        weight = F.pow(share, F.lit(a)) / F.lit(z)
        whole = budget_tokens is None
        budget = most / ((most / total) ** a / z) if whole else float(budget_tokens)
        rows = totals.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(budget) + 0.5))
        return rows.withColumn("budget", F.greatest("budget", "tokens")) if whole else rows
    return totals.withColumn("weight", F.lit(None).cast("double")).withColumn("budget", F.lit(0).cast("long"))


def place(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS,
          budget_tokens: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """`docs` (doc_id, text, source, any others) with a row for each copy taken, and the columns
    mix_epoch (from 0), mix_start (tokens of the source's stream before it), mix_tokens, mix_block.

    A copy is taken if it starts before its source's budget ends. NULL source is a
    source of its own, NULL and empty texts count one token, repeated rows are rows of
    their own, ties of the permutation fall to doc_id and then to the text; an empty
    table gives an empty one. Columns that start with `mix_` are replaced.
    """
    keep = [c for c in docs.columns if not c.startswith("mix_")]
    rows = docs.select(*keep, _key(F.col("source")).alias("mix_key"), n_tokens(F.col("text")).alias("mix_tokens"),
                       F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mix_text"))
    # a row for each source, read by every step of the bisection
    table = written(plan(written(source_totals(docs), "sources"), target_entropy, most_repeats, budget_tokens), "plan")
    blocks = math.ceil((table.agg(F.sum("budget")).first()[0] or 0) / block_tokens)
    table = table.select(F.col("key").alias("mix_key"), F.col("tokens").alias("mix_all"), F.col("budget").alias("mix_budget"),
                         F.ceil(F.col("docs") / CHUNK).alias("mix_chunks"))
    # one key may hold a third of the rows: the few rows of the plan are given to every salt
    salt = F.pmod(F.xxhash64("mix_text", "doc_id"), F.lit(64))
    rows = rows.withColumn("mix_salt", salt).join(table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))),
                                                  ["mix_key", "mix_salt"]).drop("mix_salt")
    last = F.floor((F.col("mix_budget") + F.col("mix_all") - 1) / F.col("mix_all")) - 1
    rows = rows.where("mix_budget > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("mix_epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    at = F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("mix_chunk", F.floor(at * F.col("mix_chunks")))
    stream = ["mix_key", "mix_epoch"]
    # tokens before a chunk: sums of chunks, added up within and over runs of chunks
    sums = rows.groupBy(*stream, "mix_chunk").agg(F.sum("mix_tokens").alias("n")).withColumn("run", F.floor(F.col("mix_chunk") / SUPER))
    runs = sums.groupBy(*stream, "run").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    runs = runs.select(*stream, "run", F.coalesce(F.sum("n").over(W.partitionBy(*stream).orderBy("run").rowsBetween(W.unboundedPreceding, -1)), zero).alias("far"))
    sums = sums.join(runs, [*stream, "run"])
    inner = W.partitionBy(*stream, "run").orderBy("mix_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*stream, "mix_chunk", (F.col("far") + F.coalesce(F.sum("n").over(inner), zero)).alias("mix_before"))
    own = W.partitionBy(*stream, "mix_chunk").orderBy("mix_order", F.col("doc_id").asc_nulls_first(), "mix_text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(sums, [*stream, "mix_chunk"])
    start = F.col("mix_epoch") * F.col("mix_all") + F.col("mix_before") + F.coalesce(F.sum("mix_tokens").over(own), zero)
    rows = rows.withColumn("mix_start", start).where("mix_start < mix_budget")
    block = F.floor(F.col("mix_start") / F.col("mix_budget") * F.lit(float(blocks)))
    return rows.select(*keep, "mix_epoch", "mix_start", "mix_tokens", block.alias("mix_block"), "mix_text")


def permute_blocks(placed: DataFrame, seed: str = SEED) -> DataFrame:
    """Add mix_position: the place of a copy in its block's permutation, from 0. A block holds
    at most a block's tokens, so one window holds it."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), F.col("mix_epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    w = W.partitionBy("mix_block").orderBy(order, F.col("doc_id").asc_nulls_first(), "mix_epoch", "mix_text")
    return placed.withColumn("mix_position", (F.row_number().over(w) - 1).cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The copies taken, as rows of `docs`; see `place`."""
    return place(docs, **how).select(*[c for c in docs.columns if not c.startswith("mix_")])


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key, md5(coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) + 1 AS n FROM documents),
t AS (SELECT key, sum(n)::BIGINT AS tokens FROM d GROUP BY key),
g AS (SELECT count(*) AS k, sum(tokens)::DOUBLE AS total, max(tokens)::DOUBLE AS most, min(tokens)::DOUBLE AS least,
             list(tokens::DOUBLE) AS l FROM t),
s(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
           ln(list_sum(list_transform(l, lambda x: pow(x / total, (lo + hi) / 2))))
           - (lo + hi) / 2 * list_sum(list_transform(l, lambda x: pow(x / total, (lo + hi) / 2) * ln(x / total)))
             / list_sum(list_transform(l, lambda x: pow(x / total, (lo + hi) / 2))) > {TARGET_ENTROPY} * ln(k)
           OR pow(most / least, 1 - (lo + hi) / 2) > {MOST_REPEATS} AS flat
    FROM s, g WHERE i < {LEVELS})),
e AS (SELECT hi AS a, list_sum(list_transform(l, lambda x: pow(x / total, hi))) AS z, total, most FROM s, g WHERE i = {LEVELS}),
p AS (SELECT key, tokens, greatest(tokens, floor(pow(tokens / total, a) / z * (most / (pow(most / total, a) / z)) + 0.5)::BIGINT) AS budget FROM t, e),
b AS (SELECT ceil(sum(budget) / {BLOCK_TOKENS}.0) AS blocks FROM p),
c AS (SELECT d.*, p.tokens, p.budget, unnest(range((p.budget + p.tokens - 1) // p.tokens)) AS epoch FROM d JOIN p USING (key)),
o AS (SELECT *, epoch * tokens + coalesce(sum(n) OVER (PARTITION BY key, epoch
        ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '-')), doc_id NULLS FIRST, h
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c)
SELECT doc_id, source, epoch, start, n AS n_tokens, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('{SEED}:block:' || epoch || ':' || coalesce(doc_id::VARCHAR, '-')),
                          doc_id NULLS FIRST, epoch, h) - 1 AS position
FROM (SELECT *, floor(start / budget * blocks)::BIGINT AS block FROM o, b WHERE start < budget)
"""
