"""Refits while pairs arrive: as keyed state that holds the latest pairs of a job, or as foreachBatch over two written
tables for those who want the pairs kept."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotlake.operators.fits import FIT_WINDOW, MIN_PAIRS, ols_trimmed

REFIT_EVERY, REFIT_EVERY_UNUSABLE = 25, 10
PAIRS = "job_id string, seq long, q double, log_bpf double, x_star double, batch long"
FITS = "job_id string, n long, b0 double, bq double, bl double, sd double, pairs long, batch long"


class OnlineRefit:
    """Pairs of each batch are appended to `pairs`; a job with enough new pairs since
    its last fit is refitted and the fit appended to `fits`.

    Every batch writes its own partition (overwritten if the batch is replayed), so a
    restart neither repeats nor loses pairs. `max_sd` is the residual a fit is worth following at.
    """

    def __init__(self, pairs: str, fits: str, max_sd: float):
        self.pairs, self.fits, self.max_sd = pairs, fits, max_sd

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _replace(batch.select("job_id", "seq", "q", "log_bpf", "x_star"), self.pairs, batch_id)
        every = spark.read.schema(PAIRS).parquet(self.pairs).filter(F.col("batch") <= batch_id)
        totals = every.groupBy("job_id").agg(F.count(F.lit(1)).alias("pairs"))
        last = latest_fits(spark, self.fits, before=batch_id)
        wait = F.when(F.col("sd") <= self.max_sd, REFIT_EVERY).otherwise(REFIT_EVERY_UNUSABLE)
        due = totals.join(last.select("job_id", F.col("pairs").alias("_at"), "sd"), "job_id", "left").filter(
            (F.col("pairs") >= MIN_PAIRS) & (F.col("pairs") - F.coalesce("_at", F.lit(0)) >= wait)).select("job_id", "pairs")
        _replace(ols_trimmed(every.join(due, "job_id", "left_semi")).join(due, "job_id"), self.fits, batch_id)


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def latest_fits(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest fit of each job."""
    from pyspark.errors import AnalysisException

    try:
        fits = spark.read.schema(FITS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], FITS)
    if before is not None:
        fits = fits.filter(F.col("batch") < before)
    row = F.struct("n", "b0", "bq", "bl", "sd", "pairs", "batch")
    return fits.groupBy("job_id").agg(F.max_by(row, "batch").alias("_f")).select("job_id", "_f.*")


# --- keyed state ------------------------------------------------------------------

def plane(q: np.ndarray, l: np.ndarray, y: np.ndarray, min_pairs: int = MIN_PAIRS) -> tuple[int, float, float, float, float | None]:
    """(n, b0, bq, bl, sd) of one key's pairs: the fit of fits.ols_trimmed."""
    keep = np.ones(len(q), bool)
    for last in (False, True):
        mean = np.array([q[keep].mean(), l[keep].mean()])
        d, e = np.column_stack([q, l]) - mean, y - y[keep].mean()
        s = d[keep].T @ d[keep]
        full = s[0, 0] * s[1, 1] - s[0, 1] ** 2 > 1e-10 * s[0, 0] * s[1, 1]
        # a direction without spread gets no weight
        inverse = np.linalg.inv(s) if full else np.diag([1 / s[0, 0], 0.0] if s[0, 0] > 1e-12 else [0.0, 1 / s[1, 1] if s[1, 1] > 1e-12 else 0.0])
        slopes = inverse @ (d[keep].T @ e[keep])
        rest, lever = e - d @ slopes, 1 / keep.sum() + np.einsum("ij,jk,ik->i", d, inverse, d)
        if not last:
            sd = np.std(rest, ddof=1) if len(rest) > 1 else 0.0
            near = (np.abs(rest) <= 3 * sd) | (sd <= 0)
            keep = near if near.sum() >= min_pairs else keep
    free = 1 - lever[keep] > 1e-9
    loo = np.where(free, rest[keep] / np.where(free, 1 - lever[keep], 1), rest[keep])
    return int(keep.sum()), float(y[keep].mean() - slopes @ mean), *map(float, slopes), float(np.std(loo, ddof=1)) if len(loo) > 1 else None


class Refit(StatefulProcessor):
    """The latest FIT_WINDOW pairs of a job, how many came since its last fit, and how far that can be trusted.

    A pair is taken in order of seq within its batch. After each, the job is refitted if it has MIN_PAIRS and 25 new
    ones, or 10 while it has no fit of a residual up to `max_sd`. Work and state are bounded by the window, whatever came
    before."""

    def __init__(self, max_sd: float):
        self.max_sd = max_sd

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = ", ".join(f"{c} array<double>" for c in ("q", "l", "y"))
        self.state = handle.getValueState("ring", f"{numbers}, pairs long, since int, sd double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        fresh = [b for b in rows if len(b)]
        if not fresh:
            return
        q, l, y, pairs, since, sd = self.state.get() if self.state.exists() else ([], [], [], 0, 0, None)
        ring, out = [list(map(float, v)) for v in (q, l, y)], []
        for r in pd.concat(fresh).dropna(subset=["q", "log_bpf", "x_star"]).sort_values("seq", kind="stable").itertuples(index=False):
            for values, v in zip(ring, (r.q, r.log_bpf, r.x_star)):
                values.append(float(v))
                del values[:-FIT_WINDOW]
            pairs, since = pairs + 1, since + 1
            wait = REFIT_EVERY if sd is not None and sd <= self.max_sd else REFIT_EVERY_UNUSABLE
            if pairs >= MIN_PAIRS and since >= wait:
                fit = plane(*map(np.array, ring))
                since, sd = 0, fit[-1]
                out.append((key[0], *fit, pairs))
        self.state.update((*ring, pairs, since, sd))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "n", "b0", "bq", "bl", "sd", "pairs"])

    def close(self) -> None:
        pass


def stream_refit(pairs: DataFrame, max_sd: float) -> DataFrame:
    """Every refit of each job (job_id, n, b0, bq, bl, sd, pairs) from a stream of pairs (job_id, seq, q, log_bpf, x_star)."""
    return pairs.select("job_id", "seq", "q", "log_bpf", "x_star").groupBy("job_id").transformWithStateInPandas(
        Refit(max_sd), "job_id string, n long, b0 double, bq double, bl double, sd double, pairs long", "Append", "None")
