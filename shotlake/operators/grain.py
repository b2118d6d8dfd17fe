"""Residual noise by brightness bin, and the film-grain tables made from it.

bins      source_id, shot_idx, bin_lo, channel (y, cb, cr), value, n
segments  seg_id, key, vals array<int>
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlake.plans import exact_quantile, ordered_scan

# fixed values: brightness bin edges, channels, the bins k is read from, the bins a flicker shows in
EDGES = [0, 16, 32, 48, 64, 80, 96, 128, 160, 192, 224, 256]
CHANNELS = ["y", "cb", "cr"]
MID_BINS = [32, 48, 64, 80, 96]
FLICKER_BINS = [48, 64, 80, 96, 128, 160]
FLOORS = {"y": 1.0, "cb": 0.3, "cr": 0.3}
MAX_TARGET_Y = 80.0

SHOT = ("source_id", "shot_idx")
TITLE = ("source_id",)


def bin_low(level: Column) -> Column:
    """Lower edge of the brightness bin a level falls into; the last bin is open upwards."""
    out = F.lit(EDGES[0])
    for edge in EDGES[1:-1]:
        out = F.when(level >= edge, F.lit(edge)).otherwise(out)
    return out


def bin_grid(spark: SparkSession, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """The 11 bins of each channel."""
    return spark.createDataFrame([(lo, c) for lo in EDGES[:-1] for c in channels], "bin_lo int, channel string")


def cross_bin_grid(bins: DataFrame, dim: Sequence[str] = SHOT) -> DataFrame:
    """Every (dim, bin, channel), measured or not. The 33 cells are written into
    each distinct dim row and exploded; nothing is joined without a key."""
    cells = F.array(*[F.struct(F.lit(lo).alias("bin_lo"), F.lit(c).alias("channel"))
                      for lo in EDGES[:-1] for c in CHANNELS])
    grid = bins.select(*dim).distinct().select(*dim, F.inline(cells))
    return grid.join(bins, [*dim, "bin_lo", "channel"], "left")


def residual_sums(pixels: DataFrame, key: Sequence[str] = SHOT) -> DataFrame:
    """Exact integer sums per (shot, bin) from pixel rows (key, plane, level, residual).

    At most 11 rows per shot leave each map task, so a long shot costs no more to shuffle than a short one.
    """
    square = F.col("residual").cast("long") * F.col("residual").cast("long")

    def of(plane: str, what: Column) -> Column:
        return F.sum(F.when(F.col("plane") == plane, what))

    one = F.lit(1).cast("long")
    return pixels.groupBy(*key, bin_low(F.col("level")).alias("bin_lo")).agg(
        of("y", square).alias("ssq_y"), of("y", one).alias("n_y"), of("cb", square).alias("ssq_cb"),
        of("cr", square).alias("ssq_cr"), of("cb", one).alias("n_c"))


def residual_sums_tiles(tiles: DataFrame, key: Sequence[str] = SHOT) -> DataFrame:
    """The same sums from tiles: level_y, res_y, level_c, res_cb, res_cr as array<short>.

    Each Arrow batch is reduced to per-(shot, bin) sums before anything is shuffled.
    """
    kinds = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in key)
    names = ["ssq_y", "n_y", "ssq_cb", "ssq_cr", "n_c"]
    inner = np.array(EDGES[1:-1])

    def sums(level, *planes):
        at = np.searchsorted(inner, np.asarray(level), side="right")
        n = np.bincount(at, minlength=len(EDGES) - 1)
        out = []
        for p in planes:
            sq = np.zeros(len(EDGES) - 1, dtype=np.int64)
            np.add.at(sq, at, np.asarray(p, dtype=np.int64) ** 2)
            out.append(sq)
        return n.astype(np.int64), out

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *ids, ly, ry, lc, rb, rr in pdf[[*key, "level_y", "res_y", "level_c", "res_cb", "res_cr"]].itertuples(
                    index=False):
                n_y, (sq_y,) = sums(ly, ry)
                n_c, (sq_b, sq_r) = sums(lc, rb, rr)
                for i in np.flatnonzero(n_y + n_c):
                    rows.append((*ids, EDGES[i], sq_y[i], n_y[i], sq_b[i], sq_r[i], n_c[i]))
            part = pd.DataFrame(rows, columns=[*key, "bin_lo", *names])
            yield part.groupby([*key, "bin_lo"], as_index=False)[names].sum()

    partial = tiles.mapInPandas(reduce, f"{kinds}, bin_lo int, " + ", ".join(f"{n} long" for n in names))
    return partial.groupBy(*key, "bin_lo").agg(*[F.sum(n).alias(n) for n in names])


def residual_by_bin(sums: DataFrame, min_y: int = 4000, min_c: int = 1000, key: Sequence[str] = SHOT) -> DataFrame:
    """RMS residual per (shot, bin, channel), bins with enough luma and chroma pixels only."""
    enough = sums.filter((F.col("n_y") >= min_y) & (F.col("n_c") >= min_c))

    def cell(channel: str, n: str) -> Column:
        return F.struct(F.lit(channel).alias("channel"), F.col(f"ssq_{channel}").alias("sum_sq"), F.col(n).alias("n"),
                        F.round(F.sqrt(F.col(f"ssq_{channel}") / F.col(n)), 3).alias("value"))

    return enough.select(*key, "bin_lo", F.inline(F.array(cell("y", "n_y"), cell("cb", "n_c"), cell("cr", "n_c"))))


def bin_summary(bins: DataFrame, key: Sequence[str] = TITLE, max_y: float = MAX_TARGET_Y) -> DataFrame:
    """Median over shots per (title, bin, channel), NULL where nothing was
    measured; `alarm` when a luma median is too large to be grain."""
    medians = exact_quantile(bins, [*key, "bin_lo", "channel"], "value", {"median": 0.5})
    told = medians.withColumn("median", F.round("median", 2))
    return cross_bin_grid(told, key).withColumn(
        "alarm", F.coalesce((F.col("channel") == "y") & (F.col("median") > max_y), F.lit(False)))


def fresh_curve(pairs: DataFrame, min_px: int = 2000, key: Sequence[str] = TITLE, pair: str = "pair_id") -> DataFrame:
    """Noise per bin from static flat pixels (key, pair, level, d): variance about each
    pair's own mean, pooled over pairs; NULL under `min_px` pixels."""
    per_pair = pairs.groupBy(*key, pair, bin_low(F.col("level")).alias("bin_lo")).agg(
        F.count("d").alias("_n"), (F.var_pop("d") * F.count("d")).alias("_s"))
    pooled = per_pair.groupBy(*key, "bin_lo").agg(F.sum("_n").alias("n"), F.sum("_s").alias("_s"))
    return pooled.select(*key, "bin_lo", "n",
                         F.when(F.col("n") >= min_px, F.round(F.sqrt(F.col("_s") / F.col("n")), 3)).alias("std"))


def fill_nearest(bins: DataFrame, key: Sequence[str], value: str = "value", below_brightest: bool = False) -> DataFrame:
    """Give unmeasured bins the nearest measured one's value (the lower on a tie).

    With `below_brightest` only bins under the brightest measured one are filled,
    the rest become 0. `bins` holds the dense grid: 11 rows per group.
    """
    at = F.array_position(F.array(*[F.lit(e) for e in EDGES[:-1]]), F.col("bin_lo").cast("int"))
    rows = bins.withColumn("_i", at)
    seen = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    rows = rows.withColumn("_seen", seen)
    line = Window.partitionBy(*key).orderBy("_i")
    low = F.last("_seen", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("_seen", ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_low", low).withColumn("_high", high)
    nearer_low = F.col("_high").isNull() | (F.col("_i") - F.col("_low._i") <= F.col("_high._i") - F.col("_i"))
    near = F.when(F.col("_low").isNotNull() & nearer_low, F.col("_low.v")).otherwise(F.col("_high.v"))
    if below_brightest:
        near = F.when(F.col("_high").isNotNull(), near).otherwise(F.lit(0.0))
    return rows.withColumn("filled", near).drop("_i", "_seen", "_low", "_high")


def target_vs_applied(target: DataFrame, applied: DataFrame, key: Sequence[str] = TITLE) -> DataFrame:
    """Correction per (bin, channel): median target over median applied, within
    [0.25, 4]; 1 where either is missing or the applied one is next to nothing."""
    at = [*key, "bin_lo", "channel"]
    t = exact_quantile(target, at, "value", {"_t": 0.5})
    a = exact_quantile(applied, at, "value", {"_a": 0.5})
    ratio = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.try_divide(F.col("_t"), F.col("_a"))))
    usable = F.col("_t").isNotNull() & (F.col("_a") > 0.05)
    return t.join(a, at, "full").select(*at, F.when(usable, ratio).otherwise(1.0).alias("corr"))


def calibration(cal: DataFrame, key: Sequence[str] = TITLE) -> DataFrame:
    """k per channel: applied deviation per scaling unit, from the mid bins of a flat-64 measurement."""
    mid = cal.filter(F.col("bin_lo").isin(MID_BINS))
    return exact_quantile(mid, [*key, "channel"], "value", {"_m": 0.5}).select(
        *key, "channel", (F.col("_m") / 64).alias("k"))


def scaling_curves(target: DataFrame, k: DataFrame, corr: DataFrame | None = None, chroma: float = 1.0,
                   strength: float = 1.0, key: Sequence[str] = SHOT, k_key: Sequence[str] = ()) -> DataFrame:
    """Scaling points (x, y) per (shot, channel): 14 for luma, 10 for chroma.

    `k` has k per channel (and per `k_key`, if given); `corr` a factor per (bin,
    channel) and the same key.
    """
    dense = fill_nearest(cross_bin_grid(target.select(*key, "bin_lo", "channel", "value"), key),
                         [*key, "channel"], below_brightest=True)
    # without a key these are 3 and 33 rows; with one, as many per title
    rows = dense.join(k, [*k_key, "channel"])
    if corr is not None:
        rows = rows.join(corr.select(*k_key, "bin_lo", "channel", "corr"), [*k_key, "bin_lo", "channel"], "left")
    else:
        rows = rows.withColumn("corr", F.lit(1.0))
    luma = F.col("channel") == "y"
    gain = F.when(luma, F.lit(1.0)).otherwise(F.lit(float(chroma))) * F.coalesce("corr", F.lit(1.0))
    floor = F.when(luma, F.lit(FLOORS["y"])).otherwise(F.lit(FLOORS["cb"]))
    y = F.when(F.col("filled") < floor, F.lit(0)).otherwise(
        F.least(F.lit(255), F.bround(gain * F.col("filled") / F.col("k")).cast("int")))
    if strength != 1.0:
        y = F.least(F.lit(255), F.bround(y * F.lit(float(strength))).cast("int"))
    centre = F.element_at(F.create_map(*[F.lit(v) for a, b in zip(EDGES, EDGES[1:]) for v in (a, (a + b) // 2)]),
                          F.col("bin_lo"))
    points = rows.select(*key, "channel", centre.alias("x"), y.alias("y"))
    # 11 points per curve
    curve = points.groupBy(*key, "channel").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_p"))

    def point(x: int, y: Column) -> Column:
        return F.array(F.struct(F.lit(x).alias("x"), y.alias("y")))

    head, tail = F.element_at("_p", 1)["y"], F.element_at("_p", -1)["y"]
    held = F.concat(point(0, head), F.slice("_p", 1, 1), point(16, head), F.slice("_p", 2, 99), point(255, tail))
    cut = F.concat(point(0, head), point(16, head),
                   F.filter("_p", lambda p: (p["x"] >= 40) & (p["x"] <= 176)), point(255, tail))
    return curve.select(*key, "channel", F.inline(F.when(luma, held).otherwise(cut)))


def donor_shape(segments: DataFrame, key: Sequence[str] = ("file",)) -> DataFrame:
    """Element-wise median (half-even) of each coefficient vector over all segments."""
    cells = segments.select(*key, "key", F.posexplode("vals").alias("pos", "v"))
    med = exact_quantile(cells, [*key, "key", "pos"], "v", {"m": 0.5})
    # one entry per coefficient, 25 at most
    packed = F.sort_array(F.collect_list(F.struct("pos", F.bround("m").cast("int").alias("v"))))
    return med.groupBy(*key, "key").agg(F.transform(packed, lambda e: e["v"]).alias("vals"))


def hardest_shots(bins: DataFrame, shots: DataFrame, k: int = 10, step: int = 3, min_frames: int = 24,
                  key: Sequence[str] = TITLE) -> DataFrame:
    """The k shots of each title where flicker would show most: flat mid-bright
    picture per sampled frame times the squared luma grain."""
    sampled = F.greatest(F.floor((F.col("s1") + step - 1) / step) - F.floor((F.col("s0") + step - 1) / step), F.lit(1))
    long = shots.filter(F.col("s1") - F.col("s0") >= min_frames).select(*key, "shot_idx", sampled.alias("_frames"))
    mid = bins.filter((F.col("channel") == "y") & F.col("bin_lo").isin(FLICKER_BINS))
    scored = mid.join(long, [*key, "shot_idx"]).groupBy(*key, "shot_idx").agg(
        F.sum(F.col("n") / F.col("_frames") * F.col("value") * F.col("value") / 1e3).alias("score"))
    top = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("shot_idx"))
    return (scored.filter("score > 0").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k))


def band_swing(series: DataFrame, key: Sequence[str] = SHOT, band: str = "band", variant: str = "variant",
               width: float = 1 << 16) -> DataFrame:
    """Per (shot, band, variant): mean frame-to-frame change over mean energy, for shots with more than five frames."""
    at = [*key, band, variant]
    steps = ordered_scan(series, at, ["frame_no"], width=width, lag={"_prev": "energy"})
    told = steps.groupBy(*at).agg(
        F.count("energy").alias("measured"), F.avg("energy").alias("_mean"),
        F.avg(F.abs(F.col("energy") - F.col("_prev"))).alias("_step"))
    return told.filter(F.col("measured") > 5).select(
        *at, "measured", F.round(F.try_divide(F.col("_step"), F.col("_mean")), 4).alias("swing"),
        F.round("_mean", 3).alias("level"))


def pooled_swing(swings: DataFrame, title: Sequence[str] = TITLE, band: str = "band",
                 variant: str = "variant") -> DataFrame:
    """Swing and level per (title, band, variant), weighted by the frames measured."""
    n = F.col("measured")
    return swings.groupBy(*title, band, variant).agg(
        F.round(F.sum(F.col("swing") * n) / F.sum(n), 4).alias("swing"),
        F.round(F.sum(F.col("level") * n) / F.sum(n), 4).alias("level"))


def swing_ratio(swings: DataFrame, a: str = "auto", b: str = "source", fine: str = "fine",
                key: Sequence[str] = SHOT) -> DataFrame:
    """Fine-band swing of one variant over the other, per shot, largest first."""
    rows = swings.filter(F.col("band") == fine)
    both = rows.groupBy(*key).agg(F.max(F.when(F.col("variant") == a, F.col("swing"))).alias("_a"),
                                  F.max(F.when(F.col("variant") == b, F.col("swing"))).alias("_b"))
    ratio = F.when((F.col("_a") != 0) & (F.col("_b") != 0), F.round(F.col("_a") / F.col("_b"), 3))
    return both.select(*key, ratio.alias("fine_ratio")).orderBy(F.coalesce("fine_ratio", F.lit(0.0)).desc(), *key)


def otsu_threshold(hist: DataFrame, key: Sequence[str], level: str = "level", cnt: str = "cnt") -> DataFrame:
    """Level maximising the between-class variance (the first on a tie), per key.
    A histogram has at most 256 levels."""
    once = hist.groupBy(*key, level).agg(F.sum(cnt).cast("double").alias("_c"))
    line = Window.partitionBy(*key).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*key)
    rows = once.select(*key, level, F.sum("_c").over(line).alias("_w"),
                       F.sum(F.col("_c") * F.col(level)).over(line).alias("_m"),
                       F.sum("_c").over(whole).alias("_t"), F.sum(F.col("_c") * F.col(level)).over(whole).alias("_mt"))
    gap = F.col("_mt") * F.col("_w") - F.col("_m") * F.col("_t")
    spread = F.col("_w") * (F.col("_t") - F.col("_w"))
    sigma = F.when(spread > 0, gap * gap / spread).otherwise(0.0)
    # levels absent from the histogram repeat the variance of the level before them, so they never win
    return rows.withColumn("_s", sigma).groupBy(*key).agg(
        F.min_by(level, F.struct((-F.col("_s")).alias("s"), F.col(level).alias("l"))).alias("threshold"))


def active_box(pixels: DataFrame, black: int = 68, share: float = 0.02, least: int = 64,
               key: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Rows and columns that are ever brighter than bars on more than 2 % of their
    length, on even coordinates; the whole frame when fewer than `least` are left."""
    key = list(key)
    peak = pixels.groupBy(*key, "y", "x").agg((F.max("v") > black).cast("int").alias("_lit"))

    def lines(axis: str) -> DataFrame:
        lit = peak.groupBy(*key, axis).agg(F.avg("_lit").alias("_share"))
        on = F.when(F.col("_share") > share, F.col(axis))
        return lit.groupBy(*key).agg(F.count(on).alias(f"_n{axis}"), F.min(on).alias(f"_a{axis}"),
                                     F.max(on).alias(f"_b{axis}"), (F.max(axis) + 1).alias(f"_s{axis}"))

    both = lines("y").join(lines("x"), key)
    whole = (F.col("_ny") < least) | (F.col("_nx") < least)

    def even(v: Column) -> Column:
        return (F.floor(v / 2) * 2).cast("long")

    def edge(axis: str, lo: bool) -> Column:
        if lo:
            return F.when(whole, F.lit(0)).otherwise(even(F.col(f"_a{axis}"))).cast("long")
        return F.when(whole, F.col(f"_s{axis}")).otherwise(even(F.col(f"_b{axis}") + 1)).cast("long")

    return both.select(*key, edge("y", True).alias("r0"), edge("y", False).alias("r1"),
                       edge("x", True).alias("c0"), edge("x", False).alias("c1"))
