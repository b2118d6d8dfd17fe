"""Cross-encoder mappings and calibration trackers.

pairs   key..., seq, q, log_bpf, x_star
The refit of two features looks at the latest `limit` pairs of its key (200), the
window it is defined on; the median-of-slopes lines look at all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.operators import slopes
from shotlake.operators.curves import CURVE, union_with_precedence
from shotlake.plans import position, settle

JOB = ("job_id",)
FIT_WINDOW = 200
MIN_PAIRS = 12


def recent_rows(pairs: DataFrame, n: int = FIT_WINDOW, order: str = "seq", key: Sequence[str] = JOB) -> DataFrame:
    """The latest n rows of each key (a top-n, limited before the shuffle)."""
    latest = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return pairs.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n).drop("_rank")


def _points(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    whole = pairs.filter("q IS NOT NULL AND x_star IS NOT NULL")
    return whole.select(*key, "seq", F.col("q").cast("double").alias("q"), F.col("x_star").cast("double").alias("y"))


def theil_sen(pairs: DataFrame, key: Sequence[str] = JOB, chunk: int = slopes.LOCAL) -> DataFrame:
    """Median-of-slopes fit x_star = a*q + b through all pairs of each key; a flat line through the first one (by seq)
    when all q are equal. Pairs without q or x_star take no part; a NULL key is a key. Slopes are counted, never made,
    and a key of over `chunk` pairs is spread over tasks."""
    return slopes.median_lines(_points(pairs, key), key, chunk)


def gated_map_fit(pairs: DataFrame, max_residual: float = 2.0, margin: float = 0.0, need: int = 4,
                  key: Sequence[str] = JOB) -> DataFrame:
    """A mapping line per key, or NULL with a reason when it cannot be trusted.

    The test is the deviation of leave-one-out residuals, not the fit's own. Pairs are a job's calibration anchors, so a
    key is one row here (16 bytes for each); all of them are fitted and left out in turn, in about n log n steps.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "q", "y")))
    packed = _points(pairs, key).groupBy(*key).agg(ordered.alias("pts"))
    columns = {"sd": "double", "a": "double", "b": "double"}

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in columns.items()))
    def fitted(q: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(slopes.gated_lines(q.tolist(), y.tolist(), need), columns=list(columns))

    qs = F.transform("pts", lambda p: p["q"])
    n = F.size("pts")
    told = packed.select(*key, n.cast("long").alias("n"), qs.alias("_qs"), fitted(qs, F.transform("pts", lambda p: p["y"])).alias("f"))
    refused = F.when(F.col("n") < need, "too few pairs").when(F.col("f.sd") > max_residual, "residual over the limit")
    trusted = refused.isNull()
    return told.select(
        *key, "n", F.when(F.col("n") >= need, F.col("f.sd")).alias("sd"), refused.alias("refused"),
        F.when(trusted, F.col("f.a")).alias("a"), F.when(trusted, F.col("f.b")).alias("b"),
        F.when(trusted, F.array_min("_qs") - margin).alias("q_lo"), F.when(trusted, F.array_max("_qs") + margin).alias("q_hi"))


def ols_trimmed(pairs: DataFrame, limit: int = FIT_WINDOW, min_pairs: int = MIN_PAIRS,
                key: Sequence[str] = JOB) -> DataFrame:
    """x_star ~ 1 + q + log_bpf on the latest pairs, refitted once without
    points beyond three deviations (if enough remain). `sd` is the leave-one-out
    deviation, from the leverages instead of n refits. A direction without
    spread gets coefficient 0.

    Everything is a window over one key's recent rows, so one shuffle serves all passes.
    """
    key = list(key)
    recent = recent_rows(pairs.filter("q IS NOT NULL AND log_bpf IS NOT NULL AND x_star IS NOT NULL"), limit, key=key)
    rows = recent.select(*key, F.col("q").cast("double"), F.col("log_bpf").cast("double").alias("l"),
                         F.col("x_star").cast("double").alias("y")).withColumn("_w", F.lit(1.0))
    whole = Window.partitionBy(*key)

    def fitted(df: DataFrame) -> DataFrame:
        """Weighted means, centred sums, coefficients, residual and leverage of every row."""
        w = F.col("_w")
        df = df.withColumn("_n", F.sum(w).over(whole))
        for c in ("q", "l", "y"):
            df = df.withColumn("_m" + c, F.sum(w * F.col(c)).over(whole) / F.col("_n"))
            df = df.withColumn("_d" + c, F.col(c) - F.col("_m" + c))
        for a, b in (("q", "q"), ("l", "l"), ("q", "l"), ("q", "y"), ("l", "y")):
            df = df.withColumn(f"_s{a}{b}", F.sum(w * F.col("_d" + a) * F.col("_d" + b)).over(whole))
        det = F.col("_sqq") * F.col("_sll") - F.col("_sql") * F.col("_sql")
        df = df.withColumn("_det", det).withColumn("_full", det > F.lit(1e-10) * F.col("_sqq") * F.col("_sll"))
        only_q = ~F.col("_full") & (F.col("_sqq") > 1e-12)
        only_l = ~F.col("_full") & ~(F.col("_sqq") > 1e-12) & (F.col("_sll") > 1e-12)
        bq = F.when(F.col("_full"), (F.col("_sqy") * F.col("_sll") - F.col("_sly") * F.col("_sql")) / F.col("_det")).when(
            only_q, F.col("_sqy") / F.col("_sqq")).otherwise(0.0)
        bl = F.when(F.col("_full"), (F.col("_sly") * F.col("_sqq") - F.col("_sqy") * F.col("_sql")) / F.col("_det")).when(
            only_l, F.col("_sly") / F.col("_sll")).otherwise(0.0)
        dq, dl = F.col("_dq"), F.col("_dl")
        lever = F.when(F.col("_full"), (F.col("_sll") * dq * dq - 2 * F.col("_sql") * dq * dl + F.col("_sqq") * dl * dl)
                       / F.col("_det")).when(only_q, dq * dq / F.col("_sqq")).when(
            only_l, dl * dl / F.col("_sll")).otherwise(0.0)
        df = df.withColumn("bq", bq).withColumn("bl", bl)
        df = df.withColumn("b0", F.col("_my") - F.col("bq") * F.col("_mq") - F.col("bl") * F.col("_ml"))
        df = df.withColumn("_e", F.col("y") - F.col("b0") - F.col("bq") * F.col("q") - F.col("bl") * F.col("l"))
        return df.withColumn("_h", F.lit(1.0) / F.col("_n") + lever)

    first = fitted(rows).withColumn("_sd", F.stddev_samp("_e").over(whole))
    first = first.withColumn("_near", (F.col("_sd") <= 0) | (F.abs("_e") <= 3 * F.col("_sd")))
    first = first.withColumn("_left", F.count_if(F.col("_near")).over(whole))
    keep = (F.col("_left") < min_pairs) | F.coalesce(F.col("_near"), F.lit(True))
    second = fitted(first.select(*key, "q", "l", "y", keep.cast("double").alias("_w")))
    used = F.col("_w") > 0
    loo = F.when(used, F.when(1 - F.col("_h") > 1e-9, F.col("_e") / (1 - F.col("_h"))).otherwise(F.col("_e")))
    told = second.groupBy(*key).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(used).alias("n"), F.first("b0").alias("b0"),
        F.first("bq").alias("bq"), F.first("bl").alias("bl"), F.stddev_samp(loo).alias("sd"))
    return told.filter(F.col("pairs") >= min_pairs).drop("pairs")


def predict_setting(rows: DataFrame, fit: DataFrame, floor: float, ceil: float, key: Sequence[str] = JOB) -> DataFrame:
    """Setting predicted from (q, log_bpf) by each key's plane, within [floor, ceil]."""
    x = F.col("b0") + F.col("bq") * F.col("q") + F.col("bl") * F.col("log_bpf")
    held = F.when(x.isNotNull(), F.least(F.lit(float(ceil)), F.greatest(F.lit(float(floor)), x)))
    return (rows.join(fit.select(*key, "b0", "bq", "bl"), [*key], "left")
            .withColumn("seed", held).drop("b0", "bq", "bl"))


def map_setting(q: Column, a: Column, b: Column, floor: float, ceil: float, offset: float = 0.0) -> Column:
    x = a * q + b + F.lit(float(offset))
    return F.when(x.isNotNull(), F.greatest(F.lit(float(floor)), F.least(x, F.lit(float(ceil)))))


def apply_or_abstain(bulk: DataFrame, fit: DataFrame, floor: float, ceil: float, offset: float = 0.0,
                     job: Sequence[str] = JOB) -> DataFrame:
    """Map q inside the fitted range; everything else (no fit, NULL, outside) is routed to probing."""
    # fits grow with the bulk: they are not collected for a broadcast
    both = bulk.join(fit.select(*job, "a", "b", "q_lo", "q_hi").hint("merge"), [*job], "left")
    inside = F.coalesce((F.col("q") >= F.col("q_lo")) & (F.col("q") <= F.col("q_hi")), F.lit(False))
    x = F.when(inside, map_setting(F.col("q"), F.col("a"), F.col("b"), floor, ceil, offset))
    return (both.withColumn("x", x).withColumn("route", F.when(inside, "mapped").otherwise("probe"))
            .drop("a", "b", "q_lo", "q_hi"))


def finish_mapping(routed: DataFrame, sampled: DataFrame, key: Sequence[str] = CURVE) -> DataFrame:
    """Settings of all shots: the mapped ones over those read off probes."""
    mapped = routed.filter(F.col("route") == "mapped").select(*key, "x")
    return union_with_precedence(sampled.select(*key, "x"), mapped, key)


# --- trackers -----------------------------------------------------------------
# A tracker's state moves by one observation at a time. Per chunk of a key the
# move as a whole is found (a function of the incoming state), then the chunks
# of a key are passed through in order: one step per chunk, not per row.

FLOOR, CAP, EASE, CLEARANCE = 0.30, 3.0, 0.25, 1.05
SAMPLE_CAP, DECAY, APPROACH = 4.0, 0.98, 20.0
RATIO_FLOOR, RATIO_CAP = 0.5, 4.0
CHUNK = 4096


def _chunked(obs: DataFrame, order: Sequence[str], width: float, key: Sequence[str], chunk: int) -> DataFrame:
    rows = position(obs, key, order, width, "_pos")
    return rows.withColumn("_part", F.floor(F.col("_pos") / F.lit(chunk)))


def correction_factor(obs: DataFrame, order: Sequence[str] = ("seq",), width: float = CHUNK,
                      key: Sequence[str] = JOB, chunk: int = CHUNK) -> DataFrame:
    """Memory correction per key from (predicted, observed) in order: an overrun is
    taken at once with 5 % clearance, anything lower eases the factor down by a
    quarter of the gap; kept in [0.3, 3]. Non-positive readings are ignored."""
    key = list(key)
    rows = _chunked(obs.filter("predicted > 0 AND observed > 0"), order, width, key, chunk)
    ratio = F.col("observed") / F.col("predicted")
    # at most `chunk` readings
    parts = rows.groupBy(*key, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("_pos", ratio.alias("s")))).alias("_run"))

    @F.pandas_udf("array<struct<lo:double,a:double,b:double>>")
    def pieces(samples: pd.Series) -> pd.Series:
        return pd.Series([[{"lo": x, "a": y, "b": z} for x, y, z in correction_pieces(s)] for s in samples])

    moved = parts.select(*key, "_part", "_n", pieces(F.transform("_run", lambda r: r["s"])).alias("_move"))
    # one entry per chunk of the key
    chain = F.sort_array(F.collect_list(F.struct("_part", "_move")))

    def through(state: Column, chunk_: Column) -> Column:
        piece = F.element_at(F.filter(chunk_["_move"], lambda p: (p["lo"] <= state) | (p["lo"] <= FLOOR)), -1)
        return piece["a"] * state + piece["b"]

    return moved.groupBy(*key).agg(chain.alias("_chain"), F.sum("_n").alias("samples")).select(
        *key, "samples", F.aggregate("_chain", F.lit(1.0), through).alias("factor"))


def correction_pieces(samples: Iterable[float]) -> list[tuple[float, float, float]]:
    """A chunk's move of the factor as pieces (lo, a, b): factor -> a*factor + b from lo to the next lo.

    A sample splits a piece where its value passes it: under the sample the
    factor jumps (a constant), from there on it eases. Jumps make constants and
    easing draws the rest together, so there are never more than a few pieces.
    """
    pieces = [(FLOOR, 1.0, 0.0)]
    for s in map(float, samples):
        jump, out = min(CAP, max(FLOOR, s * CLEARANCE)), []
        for i, (lo, a, b) in enumerate(pieces):
            hi = pieces[i + 1][0] if i + 1 < len(pieces) else float("inf")
            parts = []
            cut = (s - b) / a if a > 0 else (lo if b >= s else hi)
            if cut > lo:
                parts.append((lo, 0.0, jump))
            if cut < hi:
                start, ea, eb = max(lo, cut), a * (1 - EASE), b * (1 - EASE) + EASE * s
                # the floor holds the lower end of an easing piece
                edge = (FLOOR - eb) / ea if ea > 0 else (start if eb >= FLOOR else hi)
                if edge > start:
                    parts.append((start, 0.0, FLOOR))
                if edge < hi:
                    parts.append((max(start, edge), ea, eb))
            for part in parts:
                if not out or out[-1][1:] != part[1:]:
                    out.append(part)
        pieces = out
    return pieces


def decayed_peak_ratio(obs: DataFrame, order: Sequence[str] = ("seq",), width: float = CHUNK,
                       key: Sequence[str] = JOB, chunk: int = CHUNK) -> DataFrame:
    """Ratio of memory held to memory booked per key, from (measured, booked) in
    order: the worst recent sample (each capped at 4, fading by 2 %) pulls the
    ratio by a twentieth of the gap; kept in [0.5, 4]."""
    key = list(key)
    rows = _chunked(obs.filter("measured > 0 AND booked > 0"), order, width, key, chunk)
    sample = F.least(F.lit(SAMPLE_CAP), F.col("measured") / F.col("booked"))
    rows = settle(rows.select(*key, "_part", "_pos", sample.alias("_s")))
    # worst value leaving a chunk, from its own samples and from what enters
    parts = rows.groupBy(*key, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("_pos", "_s"))).alias("_run"))
    parts = settle(parts.withColumn("_run", F.transform("_run", lambda r: r["_s"])))
    own = F.aggregate("_run", F.lit(0.0), lambda w, s: F.greatest(s, w * DECAY))
    # one entry per chunk of the key
    chain = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_part", "_n", own.alias("w")))).alias("_c"))

    @F.pandas_udf("array<double>")
    def entering(n: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for counts, values in zip(n, own):
            worst, enter = 0.0, []
            for c, w in zip(counts, values):
                enter.append(worst)
                worst = max(w, worst * DECAY ** c)
            out.append(enter)
        return pd.Series(out)

    ins = chain.withColumn("_in", entering(F.transform("_c", lambda c: c["_n"]), F.transform("_c", lambda c: c["w"])))
    enter = ins.select(*key, F.inline(F.zip_with("_c", "_in", lambda c, w: F.struct(
        c["_part"].alias("_part"), w.alias("_in")))))
    keep = 1 - 1 / APPROACH

    def step(m: Column, s: Column) -> Column:
        """ratio -> max(c, a*ratio + b) over the chunk so far, and its worst sample."""
        w = F.greatest(s, m["w"] * DECAY)
        return F.struct((m["a"] * keep).alias("a"), (m["b"] * keep + w / APPROACH).alias("b"),
                        F.greatest(F.lit(RATIO_FLOOR), m["c"] * keep + w / APPROACH).alias("c"), w.alias("w"))

    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.col("_in").alias("w"))
    moved = parts.join(enter, [*key, "_part"]).select(*key, "_part", "_n", F.aggregate("_run", none, step).alias("_m"))
    line = F.sort_array(F.collect_list(F.struct("_part", "_m")))
    return moved.groupBy(*key).agg(
        line.alias("_line"), F.sum("_n").alias("samples"), F.max_by("_m.w", "_part").alias("worst")).select(
        *key, "samples", "worst", F.aggregate("_line", F.lit(1.0), lambda r, m: F.least(
            F.lit(RATIO_CAP), F.greatest(m["_m"]["c"], m["_m"]["a"] * r + m["_m"]["b"]))).alias("ratio"))
