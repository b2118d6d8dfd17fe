"""Noise visibility from contrast histograms.

hist   clip_id, variant, band, n_bin, m_bin, l_bin, cnt
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.functions.display import band_freq, bin_centre, unit_log
from shotlake.plans import exact_quantile, ordered_scan, ranked, settle

# fixed values: (start, step, number of edges) of the noise, masker, luminance and chroma axes, in log10
N_AXIS = (-4.0, 0.2, 23)
M_AXIS = (-3.6, 0.3, 14)
L_AXIS = (-3.0, 1 / 3, 20)
C_AXIS = (-1.5, 0.15, 21)
# fixed values: the fitted model, defaults to be overridden
MODEL = {
    "logk": -4.252757951295194, "q": 8.0, "beta": 1.5910533489884224, "beta_b": 2.0, "alpha": 0.419879245882168,
    "lg0": -2.0, "gn": 0.5, "nu": 0.0, "gm": 0.21077287594344363, "logw": -3.0, "logk_b": -6.0, "q_b": 8.0,
    "link": 1.429797047201972,
}
SCALE = (5860.536267467761, 8372.282002327314)
DISPLAY = {"ppd": 40.0, "Lb": 0.01, "sdr_white": 200.0, "units": "weber", "thresh": False, "csfw": True,
           "width": 3840, "height": 2160}
RULES = {"clean_level": 12.0, "texture_kurtosis": 3.0, "texture_frozen": 0.35}
LUT_LIMIT = 4096
# intervals of a block of cells each way, places of an axis that may be broadcast, rows of an axis ordered by one task
BLOCK, AXIS, PLACES = 4, 1 << 16, 1 << 16

CLIP = ("clip_id",)


@dataclass(frozen=True)
class Lut:
    """A small 2-D table on log-log axes: `values[i][j]` at (rows[i], columns[j])."""

    rows: Sequence[float]
    columns: Sequence[float]
    values: Sequence[Sequence[float]]

    @staticmethod
    def from_table(table: DataFrame, row: str, column: str, value: str) -> Lut:
        """Read a lookup table of at most LUT_LIMIT cells; a larger one is an error."""
        cells = table.select(row, column, value).limit(LUT_LIMIT + 1).collect()
        if len(cells) > LUT_LIMIT:
            raise ValueError(f"a lookup table has at most {LUT_LIMIT} cells")
        at = {(float(c[0]), float(c[1])): float(c[2]) for c in cells}
        rows, columns = sorted({k[0] for k in at}), sorted({k[1] for k in at})
        return Lut(rows, columns, [[at[r, c] for c in columns] for r in rows])


def lut_bilinear(lut: Lut, row: Column, column: Column) -> Column:
    """Bilinear interpolation of a lookup table, held at its edges."""

    def axis(points: Sequence[float], at: Column) -> tuple[Column, Column]:
        held = F.greatest(F.lit(float(points[0])), F.least(F.lit(float(points[-1])), at))
        # count of points under the value, less one: the cell's lower corner
        index = F.lit(0)
        for i, p in enumerate(points[1:-1], 1):
            index = F.when(held > F.lit(float(p)), F.lit(i)).otherwise(index)
        ticks = F.array(*[F.lit(float(p)) for p in points])
        lo, hi = F.element_at(ticks, index + 1), F.element_at(ticks, index + 2)
        return index, (held - lo) / (hi - lo)

    i, tl = axis(lut.rows, row)
    j, tr = axis(lut.columns, column)
    flat = F.array(*[F.lit(float(v)) for line in lut.values for v in line])
    width = len(lut.columns)

    def corner(di: int, dj: int) -> Column:
        return F.element_at(flat, (i + di) * width + j + dj + 1)

    return ((1 - tl) * (1 - tr) * corner(0, 0) + tl * (1 - tr) * corner(1, 0)
            + (1 - tl) * tr * corner(0, 1) + tl * tr * corner(1, 1))


def axis_places(ticks: DataFrame, values: DataFrame) -> DataFrame:
    """Where `values` (at) lie on an axis of `ticks` (at), both distinct and without NULL: at, tick (whether it is one),
    low (0-based lower corner of the interval that holds the value) and into (how far it lies in it, 0 to 1), held at the
    ends; the rows are written. Ticks and values are sorted together, so neither is held whole anywhere."""
    both = ticks.select("at", F.lit(0).alias("_kind")).union(values.select("at", F.lit(1)))
    tick = F.col("_kind") == 0
    both = ranked(both, [], ["at", "_kind"], "_pos").withColumns({"_tick": F.when(tick, F.col("at")), "_one": tick.cast("long")})
    told = ordered_scan(both, [], ["_pos"], width=PLACES, running={"_lo": ("last", "_tick"), "_seen": ("sum", "_one")},
                        following={"_hi": ("first", "_tick")}, totals={"_n": ("sum", "_one")})
    below, past = F.col("_seen") == 0, F.col("_hi").isNull()
    low = F.when(tick, F.col("_seen") - 1).when(past, F.greatest(F.col("_n") - 2, F.lit(0))).when(below, 0).otherwise(F.col("_seen") - 1)
    inside = F.when(below, 0.0).when(past, F.when(F.col("_n") > 1, 1.0).otherwise(0.0)).otherwise(
        F.try_divide(F.col("at") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return settle(told.select("at", tick.alias("tick"), low.cast("long").alias("low"), inside.alias("into")))


def lut_lookup(rows: DataFrame, table: DataFrame, row: Column, column: Column, name: str = "value",
               axes: tuple[str, str] = ("row", "column"), cell: str = "value") -> DataFrame:
    """Add `name`: bilinear interpolation at (row, column) of a full grid `table` (row, column, value) of any size, held
    at its edges; NULL where a coordinate or a corner is NULL.

    The distinct coordinates are placed on each axis by sorting them among its ticks. Cells are packed into blocks of
    BLOCK by BLOCK intervals with the corners these need, and rows are joined with the block they lie in. Nothing is
    brought to the driver but axes of up to AXIS places, for a broadcast.
    """
    points = [F.col(c).cast("double") for c in axes]
    cells = table.select(points[0].alias("_r"), points[1].alias("_c"), F.col(cell).cast("double").alias("_v")).filter("_r IS NOT NULL AND _c IS NOT NULL")
    # as join keys: -0.0 is 0.0
    at = rows.withColumns({"_row": row.cast("double") + 0.0, "_column": column.cast("double") + 0.0})

    def joined(df: DataFrame, places: DataFrame, on: str, how: str, **names: str) -> DataFrame:
        found = places.select(F.col("at").alias(on), *[F.col(c).alias(n) for c, n in names.items()])
        small = found.limit(AXIS + 1).count() <= AXIS
        return df.join(F.broadcast(found) if small else found.hint("merge"), on, how)

    for tick, value, i, into in (("_r", "_row", "_i", "_tr"), ("_c", "_column", "_j", "_tc")):
        distinct = lambda df, c: df.filter(F.col(c).isNotNull()).select(F.col(c).alias("at")).distinct()
        places = axis_places(distinct(cells, tick), distinct(at, value))
        cells = joined(cells, places.filter("tick"), tick, "inner", low=i)
        at = joined(at, places.filter("NOT tick"), value, "left", low=i, into=into)

    def blocks(place: str) -> Column:
        """The block of the interval a tick begins, and the one before if it also closes that one's last interval."""
        return F.array_distinct(F.array(F.floor(F.col(place) / BLOCK), F.floor(F.greatest(F.col(place) - 1, F.lit(0)) / BLOCK)))

    spread = cells.select("_i", "_j", "_v", F.explode(blocks("_i")).alias("_bi")).select("_i", "_j", "_v", "_bi", F.explode(blocks("_j")).alias("_bj"))
    place = (F.col("_i") - F.col("_bi") * BLOCK) * (BLOCK + 1) + F.col("_j") - F.col("_bj") * BLOCK
    corners = spread.withColumn("_p", place).groupBy("_bi", "_bj").agg(
        *[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"_v{p}") for p in range((BLOCK + 1) ** 2)])
    corners = corners.select("_bi", "_bj", F.array(*[f"_v{p}" for p in range((BLOCK + 1) ** 2)]).alias("_vs"))
    at = at.withColumns({"_bi": F.floor(F.col("_i") / BLOCK), "_bj": F.floor(F.col("_j") / BLOCK)})
    told = at.join(corners.hint("merge"), ["_bi", "_bj"], "left")
    first = ((F.col("_i") - F.col("_bi") * BLOCK) * (BLOCK + 1) + F.col("_j") - F.col("_bj") * BLOCK).cast("int")
    # a single line or column of cells has no far corner, and no weight there
    weight = {(0, 0): (1 - F.col("_tr")) * (1 - F.col("_tc")), (1, 0): F.col("_tr") * (1 - F.col("_tc")), (0, 1): (1 - F.col("_tr")) * F.col("_tc"), (1, 1): F.col("_tr") * F.col("_tc")}
    value = sum((F.when(w == 0, F.lit(0.0)).otherwise(w * F.get("_vs", first + di * (BLOCK + 1) + dj)) for (di, dj), w in weight.items()), F.lit(0.0))
    told = told.withColumn(name, F.when(F.col("_i").isNotNull() & F.col("_j").isNotNull(), value))
    return told.select(*rows.columns, *([] if name in rows.columns else [name]))


def axis_bin(value: Column, axis: tuple[float, float, int]) -> Column:
    """Bin of log10(value) (at least 1e-8): the number of edges below it, open at both ends."""
    start, step, n = axis
    x = F.log10(F.greatest(value, F.lit(1e-8)))
    guess = F.ceil((x - F.lit(start)) / F.lit(step))
    # the division may land a hair off an edge
    guess = guess - (x <= F.lit(start) + (guess - 1) * F.lit(step)).cast("long") + (
        x > F.lit(start) + guess * F.lit(step)).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(n), guess)).cast("int")


def contrast_histogram(rows: DataFrame, key: Sequence[str] = ("clip_id", "variant", "band")) -> DataFrame:
    """3-D histogram over noise contrast n, masker contrast m and luminance la."""
    return rows.groupBy(*key, axis_bin(F.col("n"), N_AXIS).alias("n_bin"), axis_bin(F.col("m"), M_AXIS).alias("m_bin"),
                        axis_bin(F.col("la"), L_AXIS).alias("l_bin")).agg(F.count(F.lit(1)).alias("cnt"))


def chroma_histogram(rows: DataFrame, key: Sequence[str] = ("clip_id", "variant", "band")) -> DataFrame:
    """2-D histogram over chroma residual c and luminance la."""
    return rows.groupBy(*key, axis_bin(F.col("c"), C_AXIS).alias("c_bin"), axis_bin(F.col("la"), L_AXIS).alias("l_bin")).agg(
        F.count(F.lit(1)).alias("cnt"))


def merge_histograms(hists: DataFrame, key: Sequence[str] = ("clip_id", "variant", "band")) -> DataFrame:
    """Add histograms cell by cell."""
    return hists.groupBy(*key, "n_bin", "m_bin", "l_bin").agg(F.sum("cnt").alias("cnt"))


def pooled_visibility(hist: DataFrame, clips: DataFrame, params: Mapping[str, float] = MODEL,
                      display: Mapping[str, object] = DISPLAY, lut: Lut | None = None,
                      key: Sequence[str] = ("clip_id", "variant")) -> DataFrame:
    """log10 visibility of each (clip, variant).

    clips: clip_id, trc, width, height, motion. `lut` holds log10 sensitivity
    over (log10 luminance, log10 frequency) and is needed for the `thresh` and
    `csfw` options. A (clip, variant, band) has at most 24 x 15 x 21 cells, so
    the sums are taken relative to the band's maximum over a window.
    """
    th, d = dict(params), {**DISPLAY, **dict(display)}
    units = str(d["units"])
    rows = merge_histograms(hist, [*key, "band"]).join(clips, [*CLIP], "left")
    sdr = ~F.coalesce(F.col("trc"), F.lit("")).isin("smpte2084", "arib-std-b67")
    la = F.pow(F.lit(10.0), bin_centre(F.col("l_bin"), *L_AXIS))
    la = F.when(sdr, la * F.lit(float(d["sdr_white"]) / 200.0)).otherwise(la)
    rows = rows.withColumn("_la", la + F.lit(float(d["Lb"])))
    fade = F.log10((F.col("_la") - F.lit(float(d["Lb"]))) / F.col("_la"))
    unit = unit_log(F.col("_la"), units, th.get("gamma", 0.0))
    rows = rows.withColumns({
        "_ln": bin_centre(F.col("n_bin"), *N_AXIS) + fade + unit,
        "_lm": bin_centre(F.col("m_bin"), *M_AXIS) + fade, "_unit": unit + F.lit(0.0)})
    ln = F.col("_ln")
    if d["thresh"] or d["csfw"]:
        if lut is None:
            raise ValueError("the thresh and csfw options need a sensitivity table")
        fit = F.least(F.lit(float(d["width"])) / F.col("width"), F.lit(float(d["height"])) / F.col("height"))
        rho = band_freq(F.col("band"), F.lit(float(d["ppd"])) / fit)
        rows = rows.withColumn("_ls", lut_bilinear(lut, F.log10("_la"), F.log10(rho)) + F.lit(th.get("sens", 0.0)))
    if d["thresh"]:
        floor = F.log10(F.lit(th.get("tau", 1.0))) + F.col("_unit") - F.col("_ls")
        left = F.pow(F.lit(10.0), 2 * ln) - F.pow(F.lit(10.0), 2 * floor)
        ln = F.when(left > 0, 0.5 * F.log10(F.greatest(left, F.lit(1e-300)))).otherwise(-30.0)
    if d["csfw"]:
        ln = ln + F.lit(th.get("alpha", 1.0)) * (F.col("_ls") - 2.0)
    masked = -F.log10(1 + F.pow(F.lit(10.0), F.lit(th.get("logk", -9.0)) + F.lit(th.get("q", 2.0)) * (F.col("_lm") + 2.0)))
    energy = 2 * ln + F.col("_mask")
    if "lg0" in th:
        gate = F.lit(th.get("gn", 2.0)) * (F.lit(th["lg0"]) - F.log10("_la"))
        energy = energy - 2 * F.log10(1 + F.pow(F.lit(10.0), gate))
    beta = float(th.get("beta", 2.0))
    rows = rows.withColumn("_mask", masked).withColumn("_x", energy * F.lit(0.5 * beta))
    cell = Window.partitionBy(*key, "band")
    rows = rows.withColumn("_max", F.max("_x").over(cell)).withColumn("_w", F.col("cnt") / F.sum("cnt").over(cell))
    ten = F.lit(10.0)
    bands = rows.groupBy(*key, "band").agg(
        F.first("_max").alias("_max"), F.sum(F.col("_w") * F.pow(ten, F.col("_x") - F.col("_max"))).alias("_s"),
        F.sum(F.col("_w") * F.pow(ten, F.col("_mask"))).alias("_cov"), F.first("motion").alias("_motion"))
    p = (F.log10(F.greatest(F.col("_s"), F.lit(1e-300))) + F.col("_max")) / F.lit(beta)
    nu = float(th.get("nu", 0.0))
    if nu:
        p = p - F.lit(nu) * F.log10(F.greatest(F.col("_cov"), F.lit(1e-12))) / F.lit(beta)
    bb = float(th.get("beta_b", 2.0))
    # six bands per clip
    bands = bands.withColumn("_p", p).withColumn("_top", F.max("_p").over(Window.partitionBy(*key)))
    v = (F.log10(F.sum(F.pow(ten, F.lit(bb) * (F.col("_p") - F.col("_top"))))) / F.lit(bb) + F.first("_top"))
    pooled = bands.groupBy(*key).agg(v.alias("v"), F.first("_motion").alias("_motion"))
    gm = float(th.get("gm", 0.0))
    if gm:
        pooled = pooled.withColumn("v", F.col("v") - F.lit(gm) * F.log10(1 + F.coalesce("_motion", F.lit(0.0)) / 10.0))
    return pooled.drop("_motion")


def part_b(params: Mapping[str, float]) -> dict[str, float]:
    """Parameters of the second variant: the ones marked _b over the shared ones."""
    return {**params, **{k[:-2]: v for k, v in params.items() if k.endswith("_b")}}


def combine_visibility(a: DataFrame, b: DataFrame, logw: float = MODEL["logw"], key: Sequence[str] = CLIP) -> DataFrame:
    """log10(10^a + 10^(logw + b)), relative to the larger one."""
    both = a.select(*key, F.col("v").alias("_a")).join(
        b.select(*key, (F.col("v") + F.lit(float(logw))).alias("_b")), [*key])
    top = F.greatest("_a", "_b")
    ten = F.lit(10.0)
    v = top + F.log10(F.pow(ten, F.col("_a") - top) + F.pow(ten, F.col("_b") - top))
    return both.select(*key, v.alias("v"))


def noise_level(visibility: DataFrame, link: float = MODEL["link"], scale: tuple[float, float] = SCALE) -> DataFrame:
    """Visibility on the 1-50 rating scale: `level` as fitted, `level_on_scale` held to the ends."""
    v = F.col("v") if abs(link) < 1e-3 else (F.pow(F.lit(10.0), F.lit(link) * F.col("v")) - 1) / F.lit(link)
    level = F.lit(scale[0]) + F.lit(scale[1]) * v
    return visibility.withColumn("level", level).withColumn(
        "level_on_scale", F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.col("level"))))


def window_spread(levels: DataFrame, key: Sequence[str] = CLIP) -> DataFrame:
    """10th, 50th and 90th percentile of the level over a clip's windows."""
    return exact_quantile(levels, key, "level", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def texture_features(samples: DataFrame, key: Sequence[str] = ("source_id",), pair: str = "pair_id",
                     min_px: int = 20000) -> DataFrame:
    """Per title, the median over frame pairs of: correlation of the two residuals
    x0, x1, excess kurtosis of d, deviation of ry and the share of masked pixels."""
    on = F.col("mask")

    def of(c: str) -> Column:
        return F.when(on, F.col(c))

    per = samples.groupBy(*key, pair).agg(
        F.count_if(on).alias("_n"), F.corr(of("x0"), of("x1")).alias("fresh_corr"),
        F.kurtosis(of("d")).alias("kurtosis"), F.stddev_samp(of("ry")).alias("y_std"),
        F.avg(on.cast("double")).alias("share")).filter(F.col("_n") >= min_px)
    out = per.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs_used"))
    for name in ("fresh_corr", "kurtosis", "y_std", "share"):
        out = out.join(exact_quantile(per, key, name, {name: 0.5}), [*key], "left")
    return out.select(*key, "pairs_used", *[F.round(n, 4).alias(n) for n in ("fresh_corr", "kurtosis", "y_std", "share")])


def decide_noise(levels: DataFrame, features: DataFrame, rules: Mapping[str, float] = RULES,
                 key: Sequence[str] = ("source_id",)) -> DataFrame:
    """clean, texture or grain for each title."""
    both = levels.join(features, [*key], "left")
    texture = (F.coalesce("kurtosis", F.lit(0.0)) > rules["texture_kurtosis"]) | (
        F.coalesce("fresh_corr", F.lit(0.0)) > rules["texture_frozen"])
    kind = (F.when(F.col("level") < rules["clean_level"], "clean")
            .when(F.coalesce("pairs_used", F.lit(0)) == 0, "clean").when(texture, "texture").otherwise("grain"))
    return both.withColumn("class", kind)
