"""Shot merging in rounds: what one heap over a title does step by step, done for all places that can't influence each
other at once. Runs of up to GROUP shots go through the heap; longer ones only come here.

Shots of a run are given as (_id, s0, s1), `_id` naming the run, and lie end to end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlake.plans import ordered_scan, settle

GROUP = 1 << 16
# frames to a chunk: no more shots than these, as a shot has a frame
FRAMES = 1 << 16


def large_runs(shots: DataFrame, largest: int | None = None) -> DataFrame:
    """The runs of over `largest` (GROUP) shots."""
    return shots.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (GROUP if largest is None else largest)).select("_id")


# --- short shots: all of one length in a round -----------------------------------------
#
# Shortest first means that all shots of the least length v are merged, left to right, before any other, and a merged
# shot is longer than v. What a shot of length v does depends on its neighbours' lengths, and on the left one's only by
# whether that took up a shot of length v itself. So a round is one automaton with three states before each shot:
FREE, GROWN, TAKEN = 0, 1, 2  # nothing happened on the left; the left neighbour took up v; the shot itself is taken up


def _moves(sizes: Sequence[int], left: int, right: int, v: int, state: int) -> Iterator[tuple[int, bool]]:
    """For each shot the state after it and whether it joins the shot before; a neighbour of length -1 is none."""
    for i, size in enumerate(sizes):
        if state == TAKEN:
            state = GROWN
            yield state, True
            continue
        joined = False
        if size == v:
            before = left if i == 0 else sizes[i - 1]
            after = sizes[i + 1] if i + 1 < len(sizes) else right
            if before >= 0 and (after < 0 or before + (v if state == GROWN else 0) <= after):
                state, joined = FREE, True
            else:
                state = TAKEN if after >= 0 else FREE
        else:
            state = FREE
        yield state, joined


def _after(sizes: Sequence[int], left: int, right: int, v: int) -> list[int]:
    """The state after all shots, for each state before them. Paths soon meet."""
    paths = [_moves(sizes, left, right, v, s) for s in (FREE, GROWN, TAKEN)]
    state, told = [FREE, GROWN, TAKEN], 0
    for told in range(1, len(sizes) + 1):
        state = [next(p)[0] for p in paths]
        if state[0] == state[1] == state[2]:
            break
    if told < len(sizes):
        for s, _ in paths[0]:
            state = [s] * 3
    return state


def level_round(runs: DataFrame, v: int, chunk: int | None = None) -> DataFrame:
    """Merge all shots of the least length v."""
    width = FRAMES if chunk is None else chunk
    part = F.floor(F.col("s0") / F.lit(width)).cast("long")
    # at most `width` shots
    packed = settle(runs.groupBy("_id", part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct("s0", "s1"))).alias("_run")).select(
        "_id", "_part", F.transform("_run", lambda r: r["s0"]).alias("starts"), F.transform("_run", lambda r: r["s1"]).alias("ends")))
    line = Window.partitionBy("_id").orderBy("_part")
    edge = packed.select("_id", "_part", F.element_at("starts", 1).alias("a0"), F.element_at("ends", 1).alias("a1"),
                         F.element_at("starts", -1).alias("z0"), F.element_at("ends", -1).alias("z1"))
    edge = edge.select("_id", "_part", F.coalesce(F.lag(F.expr("z1 - z0")).over(line), F.lit(-1)).alias("left"),
                       F.coalesce(F.lead(F.expr("a1 - a0")).over(line), F.lit(-1)).alias("right"))
    rows = settle(packed.join(edge, ["_id", "_part"]))

    @F.pandas_udf("array<int>")
    def moved(starts: pd.Series, ends: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_after((b - a).tolist(), x, y, v) for a, b, x, y in zip(starts, ends, left.tolist(), right.tolist())])

    # a row for each chunk of a run
    chain = rows.select("_id", "_part", moved("starts", "ends", "left", "right").alias("to")).groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("_part", "to"))).alias("chain"))
    begin = F.struct(F.lit(FREE).alias("state"), F.array().cast("array<int>").alias("seen"))
    seen = F.aggregate("chain", begin, lambda acc, c: F.struct(
        F.element_at(c["to"], acc["state"] + 1).alias("state"), F.array_append(acc["seen"], acc["state"]).alias("seen")))["seen"]
    entries = chain.select("_id", F.inline(F.zip_with("chain", seen, lambda c, s: F.struct(c["_part"].alias("_part"), s.alias("state")))))

    @F.pandas_udf("array<struct<s0:long,s1:long,joins:boolean>>")
    def replay(starts: pd.Series, ends: pd.Series, left: pd.Series, right: pd.Series, state: pd.Series) -> pd.Series:
        out = []
        for a, b, x, y, s in zip(starts, ends, left.tolist(), right.tolist(), state.tolist()):
            told: list[dict] = []
            for s0, s1, (_, joins) in zip(a.tolist(), b.tolist(), _moves((b - a).tolist(), x, y, v, s)):
                if joins and told:
                    told[-1]["s1"] = s1
                else:
                    told.append({"s0": s0, "s1": s1, "joins": joins})
            out.append(told)
        return pd.Series(out)

    after = settle(rows.join(entries, ["_id", "_part"]).select("_id", F.inline(replay("starts", "ends", "left", "right", "state"))))
    # what joins the last shot of the chunk before
    whole = ordered_scan(after.withColumn("_own", F.when(~F.col("joins"), F.col("s0"))), ["_id"], ["s0"], width=width, running={"_start": ("last", "_own")})
    return settle(whole.groupBy("_id", F.col("_start").alias("s0")).agg(F.max("s1").alias("s1")))


def merge_levels(runs: DataFrame, bound: int, chunk: int | None = None, largest: int | None = None) -> DataFrame:
    """Runs merged from the shortest length up, until no run of over `largest` shots holds a short one. At most `bound`
    rounds, whatever the runs hold: a round leaves no shot of its length."""
    while True:
        busy = runs.join(large_runs(runs, largest), "_id", "left_semi")
        v = busy.agg(F.min(F.expr("s1 - s0"))).first()[0]
        # shots that end before they start are left to the heap
        if v is None or v >= bound or v < 0:
            return runs
        runs = level_round(runs, v, chunk) if v > 0 else level_round(_without_empty(runs, chunk), v, chunk)


def _without_empty(runs: DataFrame, chunk: int | None) -> DataFrame:
    """Empty shots that follow each other as one."""
    width = FRAMES if chunk is None else chunk
    return settle(runs.groupBy("_id", "s0", "s1").agg(F.lit(width).alias("_w"))).drop("_w")


# --- pairs up to a limit ---------------------------------------------------------------

def pair_rounds(runs: DataFrame, chunk: int | None = None, largest: int | None = None, worth: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Merges of neighbouring pairs in runs (_id, _limit, s0, _size) of over `largest` shots, until none is left so long
    or a round merges under `worth` of the shots. Returns the runs as they then are and the merges (_id, total, at, gone).

    A pair that is smaller than the pairs beside it is merged before they change, and they only grow: all such pairs are
    merged in one round. Of equal pairs in a row, smaller than what lies beside the row, every other one is, from the left.
    """
    width, done = FRAMES if chunk is None else chunk, None
    while True:
        large = settle(large_runs(runs, largest))
        if large.isEmpty():
            return runs, done
        busy = runs.join(large, "_id", "left_semi")
        rest = runs.join(large, "_id", "left_anti")
        pairs = settle(ordered_scan(busy, ["_id"], ["s0"], width=width, lead={"_gone": "s0", "_after": "_size"}).withColumn("total", F.col("_size") + F.col("_after")))
        beside = settle(ordered_scan(pairs.withColumn("_one", F.lit(1).cast("long")), ["_id"], ["s0"], width=width,
                                     lag={"_low": "total"}, lead={"_high": "total"}, running={"_at": ("sum", "_one")}))
        opens = F.col("_low").isNull() | (F.col("_low") != F.col("total"))
        closes = F.col("_high").isNull() | (F.col("_high") != F.col("total"))
        beside = beside.withColumns({
            "_open": F.when(opens, F.struct("_at", (F.col("_low").isNull() | (F.col("_low") > F.col("total"))).alias("ok"))),
            "_close": F.when(closes, F.col("_high").isNull() | (F.col("_high") > F.col("total")))})
        row = ordered_scan(beside, ["_id"], ["s0"], width=width, running={"_from": ("last", "_open")}, following={"_to": ("first", "_close")})
        acts = (F.col("total") <= F.col("_limit")) & F.col("_from.ok") & F.col("_to") & ((F.col("_at") - F.col("_from._at")) % 2 == 0)
        acting = settle(row.withColumn("_acts", F.coalesce(acts, F.lit(False))).select("_id", "_limit", "s0", "_size", "total", "_gone", "_acts"))
        merges = settle(acting.filter("_acts").select("_id", "total", F.col("s0").alias("at"), F.col("_gone").alias("gone")))
        done = merges if done is None else done.unionByName(merges)
        left = acting.join(merges.select("_id", F.col("gone").alias("s0")), ["_id", "s0"], "left_anti").select(
            "_id", "_limit", "s0", F.when(F.col("_acts"), F.col("total")).otherwise(F.col("_size")).alias("_size"))
        n, m = acting.count(), merges.count()
        # a pair over the limit is never merged: runs fall apart there
        runs = settle(rest.unionByName(_parted(settle(left), width)))
        if m < worth * n:
            return runs, done


def _parted(runs: DataFrame, width: int) -> DataFrame:
    near = settle(ordered_scan(runs, ["_id"], ["s0"], width=width, lag={"_prev": "_size"}))
    apart = F.col("_prev").isNull() | (F.col("_prev") + F.col("_size") > F.col("_limit"))
    cut = ordered_scan(near.withColumn("_opens", F.when(apart, F.col("s0"))), ["_id"], ["s0"], width=width, running={"_group": ("last", "_opens")})
    return cut.select(F.struct("_id._t", F.col("_group").alias("_g")).alias("_id"), "_limit", "s0", "_size")
