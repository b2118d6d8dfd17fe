"""Medians of pairwise slopes, found by counting inversions instead of making the pairs.

With points in (x, y) order, the pairs whose slope is under t are those that the values y - t x put the other way round.
So the number of slopes under any t is an inversion count, and the slope of a rank is found by narrowing t.

A key of up to LOCAL points is fitted where it lies. Larger keys are cut into chunks of LOCAL points and all narrowed
together, fifteen values of t a round: pairs within a chunk are counted by merging it, pairs of different chunks by
dealing each chunk's sorted values to ranges (pairs within a range by merging there, pairs of different ranges from the
number of values of each chunk in each range).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.plans import exact_quantile, settle
from shotlake.plans.ordered import counted_keys, dealt
from shotlake.plans.rank import ranked

LOCAL = 1 << 16
# values of t tried in a round, and evenly spaced values of a chunk that place the borders of ranges
TRIED, MARKS = 15, 32
# points of keys that are fitted many at a time, with all their pairs, and cells of their arrays at a time
SMALL, CELLS = 64, 1 << 21


def inversions(order: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For each place the (weight of) places it is out of order with, `order` being the places sorted by value. Halves
    of growing blocks are merged, all blocks of a size at once."""
    n = len(order)
    w = np.ones(n, np.int64) if weight is None else weight
    met, width = np.zeros(n, np.int64), 1
    while width < n:
        block = order // (2 * width)
        merged = order[np.argsort(block, kind="stable")]
        right = (merged // width) & 1
        late = np.cumsum(w[merged] * right)
        early = np.cumsum(w[merged] * (1 - right))
        first = np.arange(0, n, 2 * width)
        # right places met before the block, and left ones up to its end
        sizes = np.minimum(2 * width, n - first)
        past = np.repeat(np.concatenate([[0], late])[first], sizes)
        upto = np.repeat(np.concatenate([early[first[1:] - 1], early[-1:]]), sizes)
        met[merged] += np.where(right == 1, upto - early, late - past)
        width *= 2
    return met


def changed_pairs(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places that two orders of them put different ways round; work grows with their number."""
    rank = np.empty(len(after), np.int64)
    rank[after] = np.arange(len(after))
    seen: list[int] = []
    a, b = [], []
    for place, r in zip(before.tolist(), rank[before].tolist()):
        at = bisect_right(seen, r)
        over = seen[at:]
        if over:
            a.append(after[over])
            b.append(np.full(len(over), place))
        seen.insert(at, r)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def as_bits(t: float) -> int:
    """Doubles as integers in the same order."""
    i = int(np.float64(t).view(np.int64))
    return i if i >= 0 else -(i & ((1 << 63) - 1))


def from_bits(i: int) -> float:
    return float(np.int64(i).view(np.float64)) if i >= 0 else -float(np.int64(-i).view(np.float64))


def slope_ranks(x: np.ndarray, y: np.ndarray, left_out: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The slopes of 0-based ranks `wanted` among the pairs without the point `left_out` (-1: none). Points are in (x, y)
    order. Intervals of t that hold wanted ranks are halved until they hold few pairs, which are then listed; one that
    can't be halved holds a single slope."""
    n = len(x)
    rng = np.random.default_rng(n)
    i, j = rng.integers(0, n, (2, 512))
    some = x[i] != x[j]
    sampled = np.sort((y[i] - y[j])[some] / (x[i] - x[j])[some])
    ends = np.argsort(-x, kind="stable")
    out = np.full(len(wanted), np.nan)

    def under(counts: np.ndarray, total: int, who: np.ndarray) -> np.ndarray:
        return total - np.where(left_out[who] >= 0, counts[left_out[who]], 0)

    zero = np.zeros(n, np.int64)
    full = inversions(ends)
    work = [(-np.inf, np.arange(n), zero, 0, np.inf, ends, full, int(full.sum()) // 2, np.arange(len(wanted)))]
    while work:
        lo, order_lo, counts_lo, total_lo, hi, order_hi, counts_hi, total_hi, who = work.pop()
        if not len(who):
            continue
        if total_hi - total_lo <= 4 * n + 1024:
            a, b = changed_pairs(order_lo, order_hi)
            with np.errstate(divide="ignore", invalid="ignore"):
                slopes = (y[a] - y[b]) / (x[a] - x[b])
            order = np.argsort(slopes, kind="stable")
            slopes, a, b = slopes[order], a[order], b[order]
            place = np.argsort(np.concatenate([a, b]), kind="stable")
            of = np.concatenate([a, b])[place]
            at = place % max(1, len(a))
            rest = wanted[who] - under(counts_lo, total_lo, who)
            for w, k, q in zip(who.tolist(), left_out[who].tolist(), rest.tolist()):
                if k >= 0:
                    own = np.sort(at[np.searchsorted(of, k):np.searchsorted(of, k, "right")])
                    q += int(np.searchsorted(own - np.arange(len(own)), q, "right"))
                out[w] = slopes[min(max(q, 0), len(slopes) - 1)] if len(slopes) else lo
            continue
        inside = sampled[(sampled > lo) & (sampled < hi)]
        low, high = as_bits(max(lo, -np.finfo(float).max)), as_bits(min(hi, np.finfo(float).max))
        mid = float(inside[len(inside) // 2]) if len(inside) else from_bits((low + high) // 2)
        if not lo < mid < hi:
            out[who] = lo
            continue
        order = np.argsort(y - mid * x, kind="stable")
        counts = inversions(order)
        total = int(counts.sum()) // 2
        left = wanted[who] < under(counts, total, who)
        work += [(lo, order_lo, counts_lo, total_lo, mid, order, counts, total, who[left]),
                 (mid, order, counts, total, hi, order_hi, counts_hi, total_hi, who[~left])]
    return out


def _sorted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.lexsort((y, x))


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Median slope and median intercept; a flat line through the first point if all x are equal."""
    order = _sorted(x, y)
    u, v = x[order], y[order]
    pairs = int(inversions(np.argsort(-u, kind="stable")).sum()) // 2
    if not pairs:
        return 0.0, float(y[0]) if len(y) else 0.0
    a = slope_ranks(u, v, np.array([-1, -1]), np.array([(pairs - 1) // 2, pairs // 2])).mean()
    return float(a), float(np.median(y - a * x))


def left_out_residuals(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point its distance from the line through the others."""
    n = len(x)
    order = _sorted(x, y)
    u, v = x[order], y[order]
    met = inversions(np.argsort(-u, kind="stable"))
    pairs = int(met.sum()) // 2 - met
    some = np.flatnonzero(pairs > 0)
    ranks = np.concatenate([(pairs[some] - 1) // 2, pairs[some] // 2])
    slope = np.zeros(n)
    if len(some):
        slope[some] = slope_ranks(u, v, np.concatenate([some, some]), ranks).reshape(2, -1).mean(0)
    out = np.empty(n)
    # a point whose rest stays on one side of every possible median is only counted
    ends = [v - t * u for t in (slope.min(), slope.max())]
    least, most = np.minimum(*ends), np.maximum(*ends)
    low = np.partition(least, max(0, (n - 2) // 2 - 1))[max(0, (n - 2) // 2 - 1)]
    high = np.partition(most, min(n - 1, (n - 1) // 2 + 1))[min(n - 1, (n - 1) // 2 + 1)]
    below = most < low
    near = np.flatnonzero(~below & (least <= high))
    place = np.full(n, -1)
    by_slope = np.argsort(slope, kind="stable")
    for same in np.split(by_slope, np.flatnonzero(np.diff(slope[by_slope])) + 1):
        t = slope[same[0]]
        rest = v[near] - t * u[near]
        up = np.argsort(rest, kind="stable")
        rest = rest[up]
        place[near[up]] = np.arange(len(near))
        # ranks among the others, as places in `rest`
        at = np.array([[(n - 2) // 2], [(n - 1) // 2]]) - int(below.sum()) + below[same]
        at = at + ((place[same] >= 0) & (at >= place[same]))
        out[same] = v[same] - t * u[same] - (rest[at[0]] + rest[at[1]]) / 2
    back = np.empty(n)
    back[order] = out
    # without a slope the line is flat through the first point left
    for k in order[np.flatnonzero(pairs == 0)].tolist():
        back[k] = y[k] - y[1 if k == 0 else 0]
    return back


def small_fits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`left_out_residuals` and `line` of many keys of the same number of points: a row of finite x and y is a key. All
    pairs of a key are made and sorted once; the ranks without a point skip its own pairs."""
    m, n = x.shape
    i, j = np.triu_indices(n, 1)
    some = x[:, i] != x[:, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        slopes = np.where(some, (y[:, j] - y[:, i]) / (x[:, j] - x[:, i]), np.inf)
    order = np.argsort(slopes, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(i))[None, :], 1)
    slopes = np.take_along_axis(slopes, order, 1)
    pairs = some.sum(1)
    # the pairs of each point
    of = np.array([np.flatnonzero((i == k) | (j == k)) for k in range(n)])
    left = pairs[:, None] - some[:, of].sum(2)
    own = np.sort(place[:, of], axis=2) - np.arange(n - 1)

    def middle(rank: np.ndarray) -> np.ndarray:
        at = rank + (own <= rank[:, :, None]).sum(2)
        return np.take_along_axis(slopes, np.clip(at, 0, len(i) - 1), 1)

    a = np.where(left > 0, (middle((left - 1) // 2) + middle(left // 2)) / 2, 0.0)
    rest = y[:, None, :] - a[:, :, None] * x[:, None, :]
    rest[:, np.arange(n), np.arange(n)] = np.inf
    ranks = (n - 2) // 2, (n - 1) // 2
    rest = np.partition(rest, ranks, axis=2)
    out = y - a * x - (rest[:, :, ranks[0]] + rest[:, :, ranks[1]]) / 2
    # without a slope the line is flat through the first point left
    first = np.repeat(y[:, :1], n, axis=1)
    first[:, 0] = y[:, 1]
    out = np.where(left > 0, out, y - first)
    rows = np.arange(m)
    whole = np.where(pairs > 0, (slopes[rows, np.maximum(pairs - 1, 0) // 2] + slopes[rows, np.minimum(pairs // 2, len(i) - 1)]) / 2, 0.0)
    b = np.where(pairs > 0, np.median(y - whole[:, None] * x, axis=1), y[:, 0])
    return out, whole, b


def gated_lines(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray], need: int) -> np.ndarray:
    """For each key of at least `need` points the deviation of its left-out residuals and its line (a, b); NaN for others."""
    told = np.full((len(xs), 3), np.nan)
    n = np.array([len(x) for x in xs], np.int64)
    need = max(2, need)
    for size in np.unique(n[n >= need]).tolist():
        same = np.flatnonzero(n == size)
        if size > SMALL or size < 3:
            for k in same.tolist():
                told[k] = np.std(left_out_residuals(xs[k], ys[k]), ddof=1), *line(xs[k], ys[k])
            continue
        step = max(1, CELLS // (size * size))
        for some in (same[f:f + step] for f in range(0, len(same), step)):
            x, y = np.stack([xs[k] for k in some]).astype(float), np.stack([ys[k] for k in some]).astype(float)
            finite = np.isfinite(x).all(1) & np.isfinite(y).all(1)
            if finite.any():
                out, a, b = small_fits(x[finite], y[finite])
                told[some[finite]] = np.column_stack([np.std(out, axis=1, ddof=1), a, b])
            for k in some[~finite].tolist():
                told[k] = np.std(left_out_residuals(xs[k], ys[k]), ddof=1), *line(xs[k], ys[k])
    return told


# --- keys of many chunks ----------------------------------------------------------

def large_medians(points: DataFrame, key: Sequence[str], chunk: int = LOCAL) -> DataFrame:
    """Median slope `a` of each key of `points` (key..., q, y) and its number of points `n`, for keys too large for one
    task; keys whose q are all equal have a = NULL."""
    key = list(key)
    rows = ranked(points.select(*key, "q", "y"), key, ["q", "y"], "_pos")
    packed = F.sort_array(F.collect_list(F.struct("_pos", "q", "y")))
    chunks = settle(rows.groupBy(*key, F.floor(F.col("_pos") / F.lit(chunk)).cast("long").alias("part")).agg(packed.alias("p")).select(
        F.struct(*key).alias("_k"), "part", F.transform("p", lambda r: r["q"]).alias("x"), F.transform("p", lambda r: r["y"]).alias("y")))
    equal = rows.groupBy(F.struct(*key).alias("_k"), "q").agg(F.count(F.lit(1)).alias("g"))
    sizes = equal.groupBy("_k").agg(F.sum("g").alias("n"), F.sum(F.expr("g * (g - 1) div 2")).alias("_same"))
    pairs = F.expr("n * (n - 1) div 2") - F.col("_same")
    told = settle(sizes.select("_k", "n", pairs.alias("pairs")))
    top = as_bits(np.finfo(float).max)
    # both middle ranks; lo is the largest t known to have no more than `rank` slopes under it
    brackets = settle(told.filter("pairs > 0").select("_k", F.inline(F.array(*[
        F.struct(F.lit(w).alias("which"), F.expr(f"(pairs - {1 - w}) div 2").alias("rank")) for w in (0, 1)])),
        F.lit(-top).alias("lo"), F.lit(top).alias("hi")))
    while brackets.filter("hi > lo + 1").limit(1).count():
        brackets = settle(_narrowed(chunks, brackets))
    bits = brackets.groupBy("_k").agg(F.min(F.when(F.col("which") == 0, F.col("lo"))).alias("l"), F.min(F.when(F.col("which") == 1, F.col("lo"))).alias("h"))

    @F.pandas_udf("double")
    def mean(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(from_bits(i) + from_bits(j)) / 2 for i, j in zip(a, b)], dtype=float)

    return told.join(bits, "_k", "left").select("_k.*", "n", F.when(F.col("l").isNotNull(), mean(F.coalesce("l", F.lit(0)), F.coalesce("h", F.lit(0)))).alias("a"))


def _narrowed(chunks: DataFrame, brackets: DataFrame) -> DataFrame:
    """One round: the brackets between neighbouring values of the TRIED ones."""
    @F.pandas_udf("array<struct<tid:int,bits:long,t:double>>")
    def values(which: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for w, a, b in zip(which.tolist(), lo.tolist(), hi.tolist()):
            bits = sorted({a + (b - a) * i // (TRIED + 1) for i in range(1, TRIED + 1)} - {a, b})
            out.append([{"tid": w * TRIED + i, "bits": v, "t": from_bits(v)} for i, v in enumerate(bits)])
        return pd.Series(out)

    tried = settle(brackets.select("_k", "which", F.inline(values("which", "lo", "hi"))))
    ts = tried.groupBy("_k").agg(F.collect_list(F.struct("tid", "t")).alias("ts"))

    @F.pandas_udf("array<struct<tid:int,inner:long,marks:array<double>>>")
    def within(xs: pd.Series, ys: pd.Series, ts: pd.Series) -> pd.Series:
        out = []
        for x, y, tt in zip(xs, ys, ts):
            told = []
            for t in tt:
                r = y - t["t"] * x
                order = np.argsort(r, kind="stable")
                told.append({"tid": t["tid"], "inner": int(inversions(order).sum()) // 2, "marks": r[order[np.arange(MARKS) * len(r) // MARKS]].tolist()})
            out.append(told)
        return pd.Series(out)

    inner = settle(chunks.join(ts, "_k").select("_k", "part", F.inline(within("x", "y", "ts"))))
    marks = F.sort_array(F.flatten(F.collect_list("marks")))
    # MARKS values for each chunk of a key
    cuts = inner.groupBy("_k", "tid").agg(F.sum("inner").alias("inner"), marks.alias("m")).withColumn(
        "cuts", F.filter("m", lambda _, i: (i > 0) & (i % MARKS == 0)))
    cuts = settle(cuts.select("_k", "tid", "inner", F.array_distinct("cuts").alias("cuts")))
    both = cuts.join(tried, ["_k", "tid"]).groupBy("_k").agg(F.collect_list(F.struct("tid", "t", "cuts")).alias("ts"))

    @F.pandas_udf("array<struct<tid:int,bucket:int,size:long,v:array<double>,w:array<long>>>")
    def dealt(xs: pd.Series, ys: pd.Series, ts: pd.Series) -> pd.Series:
        out = []
        for x, y, tt in zip(xs, ys, ts):
            told = []
            for t in tt:
                # equal values travel as one with their number
                v, w = np.unique(y - t["t"] * x, return_counts=True)
                edges = [0, *np.searchsorted(v, np.asarray(t["cuts"], float)).tolist(), len(v)]
                told += [{"tid": t["tid"], "bucket": b, "size": int(w[i:j].sum()), "v": v[i:j].tolist(), "w": w[i:j].tolist()}
                         for b, (i, j) in enumerate(zip(edges, edges[1:]))]
            out.append(told)
        return pd.Series(out)

    pieces = settle(chunks.join(both, "_k").select("_k", "part", F.inline(dealt("x", "y", "ts"))))

    @F.pandas_udf("long")
    def across(vs: pd.Series, ws: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(vs, ws):
            v, w = (np.concatenate([np.asarray(c, float) for c in v]), np.concatenate([np.asarray(c, np.int64) for c in w]))
            out.append(int((inversions(np.argsort(v, kind="stable"), w) * w).sum()) // 2)
        return pd.Series(out, dtype="int64")

    run = F.sort_array(F.collect_list(F.struct("part", "v", "w")))
    inside = pieces.filter("size > 0").groupBy("_k", "tid", "bucket").agg(run.alias("p")).select(
        "_k", "tid", across(F.transform("p", lambda r: r["v"]), F.transform("p", lambda r: r["w"])).alias("pairs"))
    past = Window.partitionBy("_k", "tid", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_k", "tid", "part").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    grid = pieces.select("_k", "tid", "part", "bucket", "size").withColumn("_past", F.sum("size").over(past))
    grid = grid.withColumn("pairs", F.col("size") * F.coalesce(F.sum("_past").over(over), F.lit(0)))
    counted = inside.union(grid.select("_k", "tid", "pairs")).union(cuts.select("_k", "tid", F.col("inner").alias("pairs"))).groupBy("_k", "tid").agg(F.sum("pairs").alias("under"))
    seen = tried.join(counted, ["_k", "tid"]).select("_k", "which", "bits", "under")
    told = brackets.join(seen, ["_k", "which"], "left").groupBy("_k", "which", "rank", "lo", "hi").agg(
        F.max(F.when(F.col("under") <= F.col("rank"), F.col("bits"))).alias("up"), F.min(F.when(F.col("under") > F.col("rank"), F.col("bits"))).alias("down"))
    return told.select("_k", "which", "rank", F.coalesce("up", "lo").alias("lo"), F.coalesce("down", "hi").alias("hi"))


def median_lines(points: DataFrame, key: Sequence[str], chunk: int = LOCAL) -> DataFrame:
    """(key..., n, a, b): the median-of-slopes line through the points (key..., seq, q, y) of every key."""
    key = list(key)
    large, n = counted_keys(points, key, chunk)
    small = rows = points.withColumn("_k", F.struct(*key))
    if large is not None:
        large = F.broadcast(large.withColumnRenamed("_key", "_k"))
        small = rows.join(large, "_k", "left_anti")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "q", "y")))
    # `chunk` points at most; rows are shuffled once, before lists are made of them
    packed = dealt(small, ["_k"], n).groupBy("_k").agg(ordered.alias("p"))

    @F.pandas_udf("struct<a:double,b:double>")
    def fitted(q: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line(u, v) for u, v in zip(q, y)], columns=["a", "b"])

    fit = fitted(F.transform("p", lambda r: r["q"]), F.transform("p", lambda r: r["y"]))
    local = packed.select("_k.*", F.size("p").cast("long").alias("n"), fit.alias("f")).select(*key, "n", "f.a", "f.b")
    if large is None:
        return local
    big = settle(rows.join(large, "_k", "left_semi").drop("_k"))
    slopes = settle(large_medians(big, key, chunk)).withColumn("_k", F.struct(*key)).select("_k", "n", F.coalesce("a", F.lit(0.0)).alias("a"), F.col("a").isNull().alias("_flat"))
    left = big.withColumn("_k", F.struct(*key)).join(slopes, "_k").withColumn("_rest", F.col("y") - F.col("a") * F.col("q"))
    middle = exact_quantile(left, ["_k"], "_rest", {"_b": 0.5})
    first = big.groupBy(F.struct(*key).alias("_k")).agg(F.min(F.struct("seq", "q", "y")).alias("_first"))
    told = slopes.join(middle, "_k").join(first, "_k")
    return local.unionByName(told.select("_k.*", "n", "a", F.when(F.col("_flat"), F.col("_first.y")).otherwise(F.col("_b")).alias("b")))
