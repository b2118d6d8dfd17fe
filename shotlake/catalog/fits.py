"""Fits and trackers on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6
from shotlake.catalog import views as v
from shotlake.operators import fits as op
from shotlake.operators.curves import seeds_of

KEY = ["job_id"]
RUN = ["job_id", "run"]
# calibration runs: every pair, 32 to a run
RUNS = v.PAIRS + """,
runs AS MATERIALIZED (SELECT job_id, seq // 32 AS run, seq, q, x_star FROM pairs)"""


def _runs(spark, sf):
    return v.pairs(spark, sf).withColumn("run", F.floor(F.col("seq") / 32))


@query("recent_rows", f"""WITH {v.PAIRS}
SELECT job_id, seq, q, x_star FROM pairs p WHERE seq >= (SELECT max(seq) FROM pairs m WHERE m.job_id = p.job_id) - 199""")
def recent_rows(spark, sf):
    return op.recent_rows(v.pairs(spark, sf)).select("job_id", "seq", "q", "x_star")


@query("theil_sen", f"""WITH {v.PAIRS},
slopes AS MATERIALIZED (SELECT a.job_id, median((b.x_star - a.x_star) / (b.q - a.q)) AS a FROM pairs a JOIN pairs b ON a.job_id = b.job_id AND a.seq < b.seq AND a.q <> b.q GROUP BY a.job_id)
SELECT job_id, count(*) AS n, round(any_value(coalesce(a, 0)), 6) AS a,
       round(CASE WHEN any_value(a) IS NULL THEN arg_min(x_star, seq) ELSE median(x_star - a * q) END, 6) AS b
FROM pairs LEFT JOIN slopes USING (job_id) GROUP BY job_id""")
def theil_sen(spark, sf):
    return op.theil_sen(v.pairs(spark, sf)).select("job_id", "n", r6("a").alias("a"), r6("b").alias("b"))


LIMIT = 25.0
# every pair left out of its run in turn
LEFT_OUT = RUNS + """,
slopes AS MATERIALIZED (SELECT a.job_id, a.run, a.seq AS i, b.seq AS j, (b.x_star - a.x_star) / (b.q - a.q) AS s FROM runs a JOIN runs b ON a.job_id = b.job_id AND a.run = b.run AND a.seq < b.seq AND a.q <> b.q),
loo_a AS MATERIALIZED (SELECT k.job_id, k.run, k.seq, coalesce(median(s), 0) AS a, count(s) AS m FROM runs k LEFT JOIN slopes p ON p.job_id = k.job_id AND p.run = k.run AND p.i <> k.seq AND p.j <> k.seq GROUP BY ALL),
loo_b AS MATERIALIZED (SELECT k.job_id, k.run, k.seq, any_value(k.a) AS a, CASE WHEN any_value(k.m) = 0 THEN arg_min(r.x_star, r.seq) ELSE median(r.x_star - k.a * r.q) END AS b
  FROM loo_a k JOIN runs r ON r.job_id = k.job_id AND r.run = k.run AND r.seq <> k.seq GROUP BY k.job_id, k.run, k.seq),
sd AS MATERIALIZED (SELECT job_id, run, stddev_samp(x_star - (a * q + b)) AS sd FROM loo_b JOIN runs USING (job_id, run, seq) GROUP BY job_id, run),
line AS MATERIALIZED (SELECT job_id, run, median(s) AS a FROM slopes GROUP BY job_id, run),
told AS MATERIALIZED (SELECT job_id, run, count(*) AS n, min(q) AS q_lo, max(q) AS q_hi, coalesce(any_value(a), 0) AS a,
  CASE WHEN any_value(a) IS NULL THEN arg_min(x_star, seq) ELSE median(x_star - a * q) END AS b FROM runs LEFT JOIN line USING (job_id, run) GROUP BY job_id, run)"""


@query("gated_map_fit", f"""WITH {LEFT_OUT}
SELECT job_id, run, n, CASE WHEN n >= 4 THEN round(sd, 6) END AS sd, CASE WHEN n < 4 THEN 'too few pairs' WHEN sd > {LIMIT} THEN 'residual over the limit' END AS refused,
       round(CASE WHEN n >= 4 AND sd <= {LIMIT} THEN a END, 6) AS a, round(CASE WHEN n >= 4 AND sd <= {LIMIT} THEN b END, 6) AS b,
       CASE WHEN n >= 4 AND sd <= {LIMIT} THEN q_lo - 1 END AS q_lo, CASE WHEN n >= 4 AND sd <= {LIMIT} THEN q_hi + 1 END AS q_hi FROM told LEFT JOIN sd USING (job_id, run)""")
def gated_map_fit(spark, sf):
    fit = op.gated_map_fit(_runs(spark, sf), LIMIT, 1.0, key=RUN)
    return fit.select(*RUN, "n", r6("sd").alias("sd"), "refused", r6("a").alias("a"), r6("b").alias("b"), "q_lo", "q_hi")


# two-feature least squares on the latest 200 pairs, refitted without outliers
def _normal(src: str, out: str) -> str:
    return f"""
{out}_m AS (SELECT *, avg(q) OVER w AS mq, avg(l) OVER w AS ml, avg(y) OVER w AS my, count(*) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY job_id)),
{out}_s AS (SELECT job_id, any_value(n) AS n, any_value(mq) AS mq, any_value(ml) AS ml, any_value(my) AS my, sum((q-mq)*(q-mq)) AS sqq, sum((l-ml)*(l-ml)) AS sll,
  sum((q-mq)*(l-ml)) AS sql, sum((q-mq)*(y-my)) AS sqy, sum((l-ml)*(y-my)) AS sly FROM {out}_m GROUP BY job_id),
{out} AS MATERIALIZED (SELECT *, my - bq * mq - bl * ml AS b0 FROM (SELECT *, (sqy*sll - sly*sql) / (sqq*sll - sql*sql) AS bq, (sly*sqq - sqy*sql) / (sqq*sll - sql*sql) AS bl FROM {out}_s))"""


OLS = v.PAIRS + """,
recent AS MATERIALIZED (SELECT job_id, seq, q, log_bpf AS l, x_star AS y FROM (SELECT *, max(seq) OVER (PARTITION BY job_id) AS top FROM pairs) WHERE seq >= top - 199),""" + _normal(
    "recent", "f1") + """,
res AS (SELECT r.*, r.y - (b0 + bq * r.q + bl * r.l) AS e FROM recent r JOIN f1 USING (job_id)),
sds AS (SELECT job_id, stddev_samp(e) AS sd FROM res GROUP BY job_id),
near AS (SELECT res.*, sd <= 0 OR abs(e) <= 3 * sd AS ok, count(*) FILTER (WHERE sd <= 0 OR abs(e) <= 3 * sd) OVER (PARTITION BY job_id) AS left_n FROM res JOIN sds USING (job_id)),
kept AS MATERIALIZED (SELECT job_id, q, l, y FROM near WHERE left_n < 12 OR ok),""" + _normal("kept", "f2") + """,
loo AS (SELECT job_id, f2.n, b0, bq, bl, (k.y - (b0 + bq * k.q + bl * k.l)) / (1 - (1.0 / f2.n + (sll * (k.q-mq) * (k.q-mq) - 2 * sql * (k.q-mq) * (k.l-ml)
  + sqq * (k.l-ml) * (k.l-ml)) / (sqq*sll - sql*sql))) AS e FROM kept k JOIN f2 USING (job_id)),
fit AS MATERIALIZED (SELECT job_id, any_value(n) AS n, any_value(b0) AS b0, any_value(bq) AS bq, any_value(bl) AS bl, stddev_samp(e) AS sd FROM loo GROUP BY job_id)"""


@query("ols_trimmed", f"WITH {OLS} SELECT job_id, n, round(b0, 5) AS b0, round(bq, 5) AS bq, round(bl, 5) AS bl, round(sd, 5) AS sd FROM fit")
def ols_trimmed(spark, sf):
    fit = op.ols_trimmed(v.pairs(spark, sf))
    return fit.select("job_id", "n", *[F.round(c, 5).alias(c) for c in ("b0", "bq", "bl", "sd")])


@query("predict_setting", f"""WITH {OLS}
SELECT job_id, seq, round(greatest(18.0, least(50.0, b0 + bq * q + bl * log_bpf)), 5) AS seed FROM pairs JOIN fit USING (job_id)""")
def predict_setting(spark, sf):
    pairs = v.pairs(spark, sf)
    return op.predict_setting(pairs, op.ols_trimmed(pairs), 18, 50).select("job_id", "seq", F.round("seed", 5).alias("seed"))


SEED_GRID = range(0, 121)


@query("seed_steps", f"""WITH {OLS}
SELECT job_id, seq, round(greatest(18.0, least(50.0, b0 + bq * q + bl * log_bpf)), 5) AS seed,
       CAST(least(8, greatest(2, round_even(1.5 * sd, 0))) AS INTEGER) AS step FROM pairs JOIN fit USING (job_id) WHERE sd <= 20""")
def seed_steps(spark, sf):
    pairs = v.pairs(spark, sf)
    fits = op.ols_trimmed(pairs)
    return seeds_of(op.predict_setting(pairs, fits, 18, 50), fits, SEED_GRID).select("job_id", "seq", F.round("seed", 5).alias("seed"), "step")


@query("apply_or_abstain", f"""WITH {LEFT_OUT},
routed AS (SELECT job_id, run, seq, q, coalesce(n >= 4 AND sd <= {LIMIT} AND q >= q_lo AND q <= q_hi, false) AS inside, a, b FROM runs JOIN told USING (job_id, run) LEFT JOIN sd USING (job_id, run))
SELECT job_id, seq, round(CASE WHEN inside THEN greatest(0.0, least(63.0, a * q + b)) END, 6) AS x, CASE WHEN inside THEN 'mapped' ELSE 'probe' END AS route FROM routed""")
def apply_or_abstain(spark, sf):
    runs = _runs(spark, sf)
    fit = op.gated_map_fit(runs, LIMIT, key=RUN).filter("refused IS NULL")
    return op.apply_or_abstain(runs, fit, 0, 63, job=RUN).select("job_id", "seq", r6("x").alias("x"), "route")


@query("correction_factor", f"""WITH RECURSIVE {v.OBS},
good AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i, observed / predicted AS s FROM obs WHERE observed > 0 AND predicted > 0),
fold AS (
  SELECT DISTINCT job_id, 0 AS i, CAST(1.0 AS DOUBLE) AS factor FROM good
  UNION ALL
  SELECT f.job_id, f.i + 1, greatest(0.3, least(3.0, CASE WHEN g.s > f.factor THEN g.s * 1.05 ELSE f.factor + 0.25 * (g.s - f.factor) END))
  FROM fold f JOIN good g ON g.job_id = f.job_id AND g.i = f.i + 1)
SELECT job_id, max(i) AS samples, round(arg_max(factor, i), 6) AS factor FROM fold GROUP BY job_id""")
def correction_factor(spark, sf):
    return op.correction_factor(v.obs(spark, sf), chunk=32).withColumn("factor", r6("factor"))


@query("decayed_peak_ratio", f"""WITH RECURSIVE {v.OBS},
good AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i, least(4.0, observed / predicted) AS s FROM obs WHERE observed > 0 AND predicted > 0),
fold AS (
  SELECT DISTINCT job_id, 0 AS i, CAST(0.0 AS DOUBLE) AS worst, CAST(1.0 AS DOUBLE) AS ratio FROM good
  UNION ALL
  SELECT f.job_id, f.i + 1, greatest(g.s, f.worst * 0.98), least(4.0, greatest(0.5, f.ratio + (greatest(g.s, f.worst * 0.98) - f.ratio) / 20))
  FROM fold f JOIN good g ON g.job_id = f.job_id AND g.i = f.i + 1)
SELECT job_id, max(i) AS samples, round(arg_max(worst, i), 6) AS worst, round(arg_max(ratio, i), 6) AS ratio FROM fold GROUP BY job_id""")
def decayed_peak_ratio(spark, sf):
    rows = v.obs(spark, sf).select("job_id", "seq", F.col("observed").alias("measured"), F.col("predicted").alias("booked"))
    return op.decayed_peak_ratio(rows, chunk=32).select("job_id", "samples", r6("worst").alias("worst"), r6("ratio").alias("ratio"))
