"""Folds that look sequential, cut into chunks.

A chunk is reduced to its transfer function (where does each possible incoming
state leave it?), the functions are applied along the key, and only then are
the rows decided. No key is ever collected whole: the arrays built here hold
at most one chunk, or one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.plans.lineage import settle
from shotlake.plans.ordered import position
from shotlake.plans.rank import ranked


def greedy_spacing(df: DataFrame, keys: Sequence[str], at: str, gap: int, chunk: int = 1 << 14) -> DataFrame:
    """Keep rows at least `gap` apart, first come first kept; a row that is
    dropped does not start a gap. `at` is an integer, unique within a key.
    Returns the keys and `at` of the kept rows.

    What matters of the past of a chunk is the next free position, one of `gap`
    values. Mostly the chunk forgets it (two of its rows lie `gap` apart, or its
    start is empty), and the next chunk knows its entry at once; only chunks after
    one that does not forget are passed through one by one.
    """
    keys = list(keys)
    gap = max(1, int(gap))
    chunk = max(int(chunk), 2 * gap)
    part = [*keys, "_part"]
    # at most `chunk` integers: `at` is unique and lies inside one chunk
    packed = df.groupBy(*keys, F.floor(F.col(at) / F.lit(chunk)).cast("long").alias("_part")).agg(
        F.sort_array(F.collect_list(F.col(at).cast("long"))).alias("_at"))
    base = F.col("_part") * chunk

    def walk(free: Column) -> Column:
        """Next free position after the chunk, when positions from `free` on are free."""
        return F.aggregate("_at", free, lambda acc, x: F.when(x >= acc, x + gap).otherwise(acc))

    apart = F.exists(F.zip_with(F.slice("_at", 2, F.size("_at")), F.slice("_at", 1, F.size("_at") - 1),
                                lambda b, a: b - a >= gap), lambda wide: wide)
    forgets = apart | (F.element_at("_at", 1) >= base + (gap - 1))
    each = F.transform(F.sequence(F.lit(0), F.lit(gap - 1)), lambda d: walk(base + d))
    moved = packed.select(*part, F.when(forgets, F.array(walk(base))).otherwise(each).alias("_out"))
    line = Window.partitionBy(*keys).orderBy("_part")
    seen = moved.withColumn("_prev", F.lag(F.struct("_part", "_out")).over(line))
    fresh = F.col("_prev").isNull() | (F.col("_prev._part") < F.col("_part") - 1)
    told = F.size("_prev._out") == 1
    seen = seen.withColumn("_free", F.when(fresh, base).when(told, F.greatest(base, F.col("_prev._out")[0])))
    seen = seen.withColumn("_from", F.last(F.when(F.col("_free").isNotNull(), F.col("_part")), ignorenulls=True).over(line))
    seen = seen.withColumn("_more", F.lead(F.col("_free").isNull(), 1, False).over(line))
    known = seen.filter("_free IS NOT NULL").select(*part, "_free")
    kinds = {c: df.schema[c].dataType.simpleString() for c in keys}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "_part long", "_free long"])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry of each chunk behind one that does not forget: one step per chunk."""
        pdf = pdf.sort_values("_part")
        free, entry = int(pdf["_free"].iloc[0]), []
        for p, out in zip(pdf["_part"], pdf["_out"]):
            free = max(free, int(p) * chunk)
            entry.append(free)
            free = int(out[0] if len(out) == 1 else out[free - int(p) * chunk])
        return pdf.assign(_free=entry)[part].assign(_free=entry).iloc[1:]

    chained = (seen.filter("_free IS NULL OR _more").select(*part, "_from", "_free", "_out")
               .groupBy(*keys, "_from").applyInPandas(enter, schema))
    entered = packed.join(known.unionByName(chained), part)
    kept = F.aggregate(
        "_at", F.struct(F.col("_free").alias("free"), F.array().cast("array<long>").alias("kept")),
        lambda acc, x: F.when(x >= acc["free"], F.struct(
            (x + gap).alias("free"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))["kept"]
    return entered.select(*keys, F.explode(kept).alias(at))


def finite_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: Column,
                table: Sequence[Sequence[int]], start: int, width: float, chunk: int = 2048) -> DataFrame:
    """Run a finite automaton over each key: `table[state][symbol]` is the next
    state. Returns one row per key with its last `state` and the event count."""
    keys = list(keys)
    n_symbols = len(table[0])
    flat = F.array(*[F.lit(int(s)) for row in table for s in row])
    rows = position(df.withColumn("_sym", symbol.cast("int")), keys, order, width, "_pos")
    rows = rows.withColumn("_part", F.floor(F.col("_pos") / F.lit(chunk)))
    packed = rows.groupBy(*keys, "_part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_sym"))), lambda e: e["_sym"]).alias("_syms"),
        F.count(F.lit(1)).alias("_n")).withColumn("_table", flat)
    states = F.sequence(F.lit(0), F.lit(len(table) - 1))
    moved = packed.select(
        *keys, "_part", "_n",
        F.transform(states, lambda s: F.aggregate(
            "_syms", s, lambda acc, e: F.element_at(F.col("_table"), acc * n_symbols + e + 1))).alias("_to"))
    chain = F.sort_array(F.collect_list(F.struct("_part", "_to")))
    return moved.groupBy(*keys).agg(chain.alias("_chain"), F.sum("_n").alias("n_events")).select(
        *keys, "n_events",
        F.aggregate("_chain", F.lit(start), lambda s, c: F.element_at(c["_to"], s + 1)).alias("state"))


def finite_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: Column, table: Sequence[Sequence[int]],
                start: int = 0, chunk: int = 2048, before: str = "state_before", after: str = "state_after", place: str = "place") -> DataFrame:
    """The automaton of `finite_fold` at every row: its place in the key, the state before it and after it. Chunks are cut by rows, so a key may
    hold any share of them and any number at one value of `order`."""
    keys, flat = list(keys), [list(map(int, r)) for r in table]
    rows = ranked(df.withColumn("_sym", symbol.cast("int")), keys, order, "_pos")
    rows = rows.withColumn("_part", F.floor(F.col("_pos") / F.lit(chunk)).cast("long"))
    rest = F.struct(*[c for c in rows.columns if c not in (*keys, "_sym", "_pos", "_part")])
    # at most `chunk` rows
    packed = settle(rows.groupBy(F.struct(*keys).alias("_k"), "_part").agg(F.sort_array(F.collect_list(F.struct("_pos", "_sym", rest.alias("row")))).alias("_run")).select(
        "_k", "_part", F.transform("_run", lambda r: r["_sym"]).alias("_syms"), F.transform("_run", lambda r: F.struct(r["row"].alias("row"), r["_pos"].alias("p"))).alias("_rows")))

    @F.pandas_udf("array<int>")
    def leaves(syms: pd.Series) -> pd.Series:
        out = []
        for run in syms:
            states = list(range(len(flat)))
            for s in run.tolist():
                states = [flat[x][s] for x in states]
            out.append(states)
        return pd.Series(out)

    # one entry for each chunk of the key
    chain = packed.select("_k", "_part", leaves("_syms").alias("_to")).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_part", "_to"))).alias("_chain"))
    begin = F.struct(F.lit(start).alias("state"), F.array().cast("array<int>").alias("seen"))
    seen = F.aggregate("_chain", begin, lambda acc, c: F.struct(
        F.element_at(c["_to"], acc["state"] + 1).alias("state"), F.array_append(acc["seen"], acc["state"]).alias("seen")))["seen"]
    entries = chain.select("_k", F.inline(F.zip_with("_chain", seen, lambda c, s: F.struct(c["_part"].alias("_part"), s.alias("_enter")))))

    @F.pandas_udf("array<int>")
    def replay(syms: pd.Series, enter: pd.Series) -> pd.Series:
        out = []
        for run, state in zip(syms, enter.tolist()):
            states = [state]
            for s in run.tolist():
                states.append(flat[states[-1]][s])
            out.append(states)
        return pd.Series(out)

    told = packed.join(entries, ["_k", "_part"]).withColumn("_states", replay("_syms", "_enter"))
    steps = F.transform("_rows", lambda r, i: F.struct(r.alias("r"), F.get("_states", i).alias("b"), F.get("_states", i + 1).alias("a")))
    return told.select("_k", F.inline(steps)).select("_k.*", "r.row.*", F.col("r.p").alias(place), F.col("b").alias(before), F.col("a").alias(after))
