"""Ordered scans (lag, lead, running and following aggregates) over keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here a key
is cut into chunks along its order column, each chunk is reduced to one summary
row (a partial aggregate, so it combines map-side), the carry between chunks is
computed over the summaries only, and the rows see a window partitioned by
(key, chunk). A key holding a third of the data is then spread over as many
tasks as it has chunks, and results stay exact.

Keys are counted first. One of up to `most` rows stays whole: its rows are
shuffled once and carry nothing, and without larger keys that is the whole plan.

``width=None`` gives the plain window, for groups with a known small bound
(probe points of one curve, brightness bins of one shot).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlake.plans.lineage import settle

NO_ORDER = -(1 << 63)
# rows a key may have to be handled by one task
WHOLE = 1 << 16
# rows a task gets of a table that is dealt by rows, as long as the table fills no more than DIRECT tasks: shuffles into
# so many are written without sorting the rows in memory. Past that a task gets up to 8 times as many
ROWS, DIRECT = 1 << 20, 200
_REDUCE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
# two partial counts combine by adding them
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def chunk_of(df: DataFrame, order: str, width: float) -> Column:
    """The chunk a row falls into along `order` (numbers, dates or timestamps;
    the width of the last two is in seconds)."""
    kind = df.schema[order].dataType
    value = F.col(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = value.cast("timestamp").cast("double")
    return F.floor(value / F.lit(width)).cast("long")


def large_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """Keys of over `most` rows as structs `_key`, or None when there are none; never more than a row for `most` of `df`."""
    return counted_keys(df, keys, most)[0]


def counted_keys(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame | None, int]:
    """The keys of `large_keys`, and the rows of `df`."""
    seen = Observation()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).observe(seen, F.sum("_rows").alias("rows"))
    large = settle(sizes.filter(F.col("_rows") > most).select((F.struct(*keys) if keys else F.lit(0)).alias("_key")))
    return None if large.isEmpty() else large, seen.get["rows"] or 0


def dealt(df: DataFrame, part: Sequence[str], rows: int, each: int = ROWS) -> DataFrame:
    """`df` by `part` in tasks of about `each` rows. Adaptive execution fills tasks by compressed bytes, and rows that
    compress to a few bytes (log lines, few values) would fill one's memory."""
    tasks = max(min(-(-rows // each), DIRECT), -(-rows // (8 * each)))
    return df.repartition(tasks, *part) if part and rows > 8 * each else df


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    width: float | None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, tuple[str, str]] | None = None,
    before: Mapping[str, tuple[str, str]] | None = None,
    following: Mapping[str, tuple[str, str]] | None = None,
    totals: Mapping[str, tuple[str, str]] | None = None,
    most: int = WHOLE,
    each: int = ROWS,
) -> DataFrame:
    """Add columns computed over each key in `order` (which must be unique within a key).

    lag / lead     {new: column}: the neighbouring row's value
    running        {new: (how, column)} over the rows up to and with this one
    before         the same over the rows strictly before
    following      the same over this row and the rows after
    totals         the same over the whole key
    `how` is sum, min, max, count, or last / first (the nearest non-null value
    looking back / ahead). Tasks get about `each` rows.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    running, before = dict(running or {}), dict(before or {})
    following, totals = dict(following or {}), dict(totals or {})
    keys, order = list(keys), list(order)
    sort = [F.col(c) for c in order]
    large, rows = counted_keys(df, keys, most) if width is not None else (None, 0)
    chunked = large is not None
    data = df
    if chunked:
        # a struct keeps rows whose key is NULL in the joins; rows without an order value come first, as in a window
        marked = F.broadcast(large.withColumn("_large", F.lit(True)))
        data = df.withColumn("_key", F.struct(*keys) if keys else F.lit(0)).join(marked, "_key", "left").drop("_key")
        chunk = F.coalesce(chunk_of(df, order[0], width), F.lit(NO_ORDER))
        data = data.withColumn("_chunk", F.when(F.col("_large"), chunk)).withColumn("_k", F.struct(*keys, "_chunk"))
    part = ["_k"] if chunked else keys
    data = dealt(data, part, rows, each)

    local = Window.partitionBy(*part).orderBy(*sort)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strictly = local.rowsBetween(Window.unboundedPreceding, -1)
    # looking back over the reversed order: frames that end unbounded take a pass for each row
    ahead = Window.partitionBy(*part).orderBy(*[c.desc() for c in sort]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)

    if chunked:
        data = _with_carry(data, keys, order, lag, lead, running, before, following, totals)

    out: dict[str, Column] = {}
    first, last = F.row_number().over(local) == 1, F.lead(F.lit(1)).over(local).isNull()
    for name, col in lag.items():
        here = F.lag(col).over(local)
        out[name] = F.when(first, F.col("_carry.lag_" + name)).otherwise(here) if chunked else here
    for name, col in lead.items():
        here = F.lead(col).over(local)
        out[name] = F.when(last, F.col("_carry.lead_" + name)).otherwise(here) if chunked else here
    for prefix, specs, frame in (("run_", running, upto), ("bef_", before, strictly), ("fol_", following, ahead)):
        for name, (how, col) in specs.items():
            carry = F.col("_carry." + prefix + name) if chunked else None
            nearest = "last" if prefix == "fol_" and how == "first" else how
            out[name] = _combine(how, _over(nearest, F.col(col), frame), carry)
    for name, (how, col) in totals.items():
        here = _REDUCE[how](col).over(whole)
        out[name] = F.coalesce(F.col("_carry.tot_" + name), here) if chunked else here
    result = data.withColumns(out)
    return result.drop("_chunk", "_k", "_large", "_carry") if chunked else result


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None,
             name: str = "pos") -> DataFrame:
    """0-based rank of each row within its key, by `order`."""
    seen = ordered_scan(df.withColumn("_one", F.lit(1).cast("long")), keys, order, width=width,
                        running={"_place": ("sum", "_one")})
    return seen.withColumn(name, F.col("_place") - 1).drop("_place", "_one")


def _over(how: str, col: Column, frame) -> Column:
    if how == "last":
        return F.last(col, ignorenulls=True).over(frame)
    if how == "first":
        return F.first(col, ignorenulls=True).over(frame)
    return _REDUCE[how](col).over(frame)


def _combine(how: str, here: Column, carry: Column | None) -> Column:
    if carry is None:
        return here
    if how in ("last", "first"):
        return F.coalesce(here, carry)
    if how == "min":
        return F.least(here, carry)
    if how == "max":
        return F.greatest(here, carry)
    # sum / count: NULL only when both sides have seen nothing
    return F.coalesce(here + carry, here, carry)


def _with_carry(data, keys, order, lag, lead, running, before, following, totals) -> DataFrame:
    """Join each row with what the other chunks of its key contribute."""
    # plain values keep the partial aggregate a hash aggregate; a struct would sort the rows for it
    at = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    aggs: list[Column] = []
    for name, col in lag.items():
        aggs.append(F.when(F.max(at).isNull(), F.first(col)).otherwise(F.max_by(col, at)).alias("lag_" + name))
    for name, col in lead.items():
        aggs.append(F.when(F.min(at).isNull(), F.first(col)).otherwise(F.min_by(col, at)).alias("lead_" + name))
    for prefix, specs in (("run_", running), ("bef_", before), ("fol_", following), ("tot_", totals)):
        for name, (how, col) in specs.items():
            value = F.col(col)
            if how == "last":
                agg = F.coalesce(F.max_by(value, F.when(value.isNotNull(), at)), F.last(value, ignorenulls=True))
            elif how == "first":
                agg = F.coalesce(F.min_by(value, F.when(value.isNotNull(), at)), F.first(value, ignorenulls=True))
            else:
                agg = _REDUCE[how](value)
            aggs.append(agg.alias(prefix + name))
    chunks = data.filter("_large").groupBy(*keys, "_chunk").agg(*aggs)

    line = Window.partitionBy(*keys).orderBy("_chunk")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    future = line.rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy(*keys)
    fields: list[Column] = []
    for name in lag:
        fields.append(F.lag("lag_" + name).over(line).alias("lag_" + name))
    for name in lead:
        fields.append(F.lead("lead_" + name).over(line).alias("lead_" + name))
    for prefix, specs, frame in (("run_", running, past), ("bef_", before, past), ("fol_", following, future)):
        for name, (how, _) in specs.items():
            col = F.col(prefix + name)
            if how in ("last", "first"):
                fields.append(_over(how, col, frame).alias(prefix + name))
            else:
                fields.append(_MERGE[how](col).over(frame).alias(prefix + name))
    for name, (how, _) in totals.items():
        fields.append(_MERGE[how]("tot_" + name).over(everything).alias("tot_" + name))
    # one window pass first, then pack: a struct of window expressions is not foldable into one exchange
    flat = chunks.select(*keys, "_chunk", *fields)
    names = [c for c in flat.columns if c not in keys and c != "_chunk"]
    carry = flat.select(F.struct(*keys, "_chunk").alias("_k"), F.struct(*names).alias("_carry"))
    # the windows need the rows by _k in any case; chunks of few rows are many, so they are never collected for a broadcast
    return data.join(carry.hint("merge"), "_k", "left")
