"""Timeline operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6, table
from shotlake.catalog import views as v
from shotlake.operators import timeline as op

THRESHOLD, GAP, SETTLE = 60.0, 5, 0.6

CUTS = v.FRAMES + f""",
ahead AS (
  SELECT source_id, frame_no, mafd, scd_score, max(mafd) OVER (
    PARTITION BY source_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS following FROM frames),
candidates AS (
  SELECT source_id, frame_no FROM ahead WHERE frame_no > 0 AND scd_score >= {THRESHOLD}
  AND (following IS NULL OR following <= {SETTLE} * mafd)),
cuts AS (
  SELECT source_id, min(frame_no) AS cut FROM candidates GROUP BY source_id
  UNION ALL
  SELECT c.source_id, (SELECT min(f.frame_no) FROM candidates f WHERE f.source_id = c.source_id AND f.frame_no >= c.cut + {GAP})
  FROM cuts c WHERE c.cut IS NOT NULL)"""

CUT_SHOTS = CUTS + """,
n AS (SELECT source_id, count(*) AS n_frames FROM frames GROUP BY source_id),
bounds AS (SELECT source_id, cut AS s0 FROM cuts WHERE cut IS NOT NULL UNION SELECT source_id, 0 FROM n),
cut_shots AS (
  SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY s0) - 1 AS shot_idx, s0,
         coalesce(lead(s0) OVER (PARTITION BY source_id ORDER BY s0), n_frames) AS s1 FROM bounds JOIN n USING (source_id))"""


def _shots(spark, sf):
    frames = v.frames(spark, sf)
    return op.cuts_to_shots(op.detect_cuts(frames, THRESHOLD, GAP, SETTLE), op.frame_counts(frames))


@query("detect_cuts", f"WITH RECURSIVE {CUTS} SELECT source_id, cut FROM cuts WHERE cut IS NOT NULL")
def detect_cuts(spark, sf):
    return op.detect_cuts(v.frames(spark, sf), THRESHOLD, GAP, SETTLE)


@query("cuts_to_shots", f"WITH RECURSIVE {CUT_SHOTS} SELECT * FROM cut_shots")
def cuts_to_shots(spark, sf):
    return _shots(spark, sf)


@query("frames_to_shots", f"""WITH RECURSIVE {CUT_SHOTS}
SELECT f.source_id, f.frame_no, s.shot_idx, s.s0, s.s1 FROM frames f JOIN cut_shots s
ON f.source_id = s.source_id AND f.frame_no >= s.s0 AND f.frame_no < s.s1""")
def frames_to_shots(spark, sf):
    return op.frames_to_shots(v.frames(spark, sf), _shots(spark, sf)).select("source_id", "frame_no", "shot_idx", "s0", "s1")


@query("shot_scores", f"""WITH RECURSIVE {CUT_SHOTS}
SELECT f.source_id, s.shot_idx, s.s0, s.s1, count(*) AS frames, round(avg(f.scd_score), 6) AS mean_score,
       max(f.scd_score) AS peak_score
FROM frames f JOIN cut_shots s ON f.source_id = s.source_id AND f.frame_no >= s.s0 AND f.frame_no < s.s1 GROUP BY ALL""")
def shot_scores(spark, sf):
    return op.shot_scores(v.frames(spark, sf), _shots(spark, sf)).withColumn("mean_score", r6("mean_score"))


@query("check_timeline", f"""WITH {v.STAMPED},
steps AS (SELECT *, pts - lag(pts) OVER (PARTITION BY source_id ORDER BY frame_no) AS d FROM stamped),
told AS (
  SELECT source_id, count(*) AS n, count(*) FILTER (WHERE d < 0.5 / 25) AS n_short, min(frame_no) FILTER (WHERE d < 0.5 / 25) AS first_short,
         count(*) FILTER (WHERE d > 1.5 / 25) AS n_gaps, min(frame_no) FILTER (WHERE d > 1.5 / 25) AS first_gap,
         arg_max(pts, frame_no) - arg_min(pts, frame_no) AS span FROM steps GROUP BY source_id),
judged AS (
  SELECT *, CASE WHEN span > 0 THEN (n - 1) / span ELSE 0 END AS fps FROM told)
SELECT source_id, n, round(fps, 6) AS measured_fps, n_short, first_short, n_gaps, first_gap, verdict,
       verdict IN ('duplicate', 'variable', 'rate') AS refused
FROM (SELECT *, CASE WHEN n < 3 THEN 'unknown' WHEN n_short > 0 THEN 'duplicate' WHEN n_gaps > (n - 1) * 0.005 THEN 'variable'
  WHEN abs(fps - 25) / 25 > 0.005 THEN 'rate' WHEN n_gaps > 0 THEN 'gaps' ELSE 'ok' END AS verdict FROM judged)""")
def check_timeline(spark, sf):
    return op.check_timeline(v.stamped(spark, sf), F.lit(25.0)).withColumn("measured_fps", r6("measured_fps"))


@query("timeline_slots", f"""WITH {v.STAMPED}
SELECT source_id, frame_no, CAST(round_even((pts - first_value(pts) OVER (PARTITION BY source_id ORDER BY frame_no)) * 25, 0) AS BIGINT) AS slot
FROM stamped""")
def timeline_slots(spark, sf):
    return op.timeline_slots(v.stamped(spark, sf), F.lit(25.0)).select("source_id", "frame_no", "slot")


@query("shot_spans", f"""WITH RECURSIVE {CUT_SHOTS}, stamped AS (
  SELECT source_id, frame_no, (frame_no + count(*) FILTER (WHERE mafd >= 250) OVER (
    PARTITION BY source_id ORDER BY frame_no)) / 25.0 AS pts FROM frames),
slots AS (SELECT source_id, frame_no, round_even((pts - first_value(pts) OVER (PARTITION BY source_id ORDER BY frame_no)) * 25, 0) AS slot FROM stamped),
last AS (SELECT source_id, max(frame_no) AS lf, arg_max(slot, frame_no) AS ls FROM slots GROUP BY source_id)
SELECT s.source_id, s.shot_idx, round((coalesce(b.slot, ls + s.s1 - lf) - coalesce(a.slot, ls + s.s0 - lf)) / 25.0, 6) AS seconds
FROM cut_shots s JOIN last l USING (source_id)
LEFT JOIN slots a ON a.source_id = s.source_id AND a.frame_no = s.s0 LEFT JOIN slots b ON b.source_id = s.source_id AND b.frame_no = s.s1""")
def shot_spans(spark, sf):
    slots = op.timeline_slots(v.stamped(spark, sf), F.lit(25.0))
    return op.shot_spans(_shots(spark, sf), slots, 25.0).withColumn("seconds", r6("seconds"))


@query("validate_intervals", f"""WITH {v.SHOTS},
broken AS (
  SELECT source_id, shot_idx, s0 + CASE WHEN o_orderkey % 1501 = 0 THEN 1 WHEN o_orderkey % 1999 = 0 THEN -1 ELSE 0 END AS s0, s1 FROM shots),
steps AS (SELECT *, lag(s1) OVER (PARTITION BY source_id ORDER BY shot_idx) AS e FROM broken),
told AS (
  SELECT source_id, count(*) AS n_shots, max(s0) FILTER (WHERE e IS NULL) AS start, min(shot_idx) FILTER (WHERE s1 <= s0) AS hollow,
         min(shot_idx) FILTER (WHERE s0 > e) AS gap, min(shot_idx) FILTER (WHERE s0 < e) AS lap, arg_max(s1, shot_idx) AS covered
  FROM steps GROUP BY source_id),
judged AS (
  SELECT c_custkey AS source_id, coalesce(n_shots, 0) AS n_shots, covered, c_custkey AS n_frames,
         CASE WHEN n_shots IS NULL THEN 'empty list' WHEN start <> 0 THEN 'late start' WHEN hollow IS NOT NULL THEN 'empty interval'
         WHEN gap IS NOT NULL AND (lap IS NULL OR gap < lap) THEN 'gap' WHEN lap IS NOT NULL THEN 'overlap' END AS error
  FROM customer LEFT JOIN told ON source_id = c_custkey)
SELECT source_id, n_shots, error, covered, error IS NULL AND covered <> n_frames AS estimate_off FROM judged""")
def validate_intervals(spark, sf):
    k = F.col("o_orderkey")
    shots = v.shots(spark, sf).withColumn("s0", F.col("s0") + F.when(k % 1501 == 0, 1).when(k % 1999 == 0, -1).otherwise(0))
    titles = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("n_frames"))
    return op.validate_intervals(shots, titles)


# one merge a step and title: a title is the list of its shots' ends
def _merged(step: str, done: str) -> str:
    return f"""WITH RECURSIVE {v.SHOTS},
fold AS (
  SELECT source_id, list(s1 ORDER BY s0) AS e FROM shots GROUP BY source_id
  UNION ALL
  SELECT source_id, e[:d - 1] || e[d + 1:] AS e FROM (SELECT source_id, e, {step} AS d FROM (
    SELECT source_id, e, list_transform(range(1, len(e) + 1), lambda i: e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) AS z FROM fold) WHERE NOT ({done}))),
last AS (SELECT source_id, e FROM (SELECT source_id, e, list_transform(range(1, len(e) + 1), lambda i: e[i] - CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END) AS z FROM fold) WHERE {done})
SELECT source_id, i - 1 AS shot_idx, CASE WHEN i = 1 THEN 0 ELSE e[i - 1] END AS s0, e[i] AS s1 FROM (SELECT source_id, e, unnest(range(1, len(e) + 1)) AS i FROM last)"""


SHORTEST = "list_position(z, list_min(z))"


@query("merge_short", _merged(f"CASE WHEN {SHORTEST} = 1 OR ({SHORTEST} < len(z) AND z[{SHORTEST} - 1] > z[{SHORTEST} + 1]) THEN {SHORTEST} ELSE {SHORTEST} - 1 END",
                              "len(z) = 1 OR list_min(z) >= 24"))
def merge_short(spark, sf):
    return op.merge_short(v.shots(spark, sf), 24)


PAIR_SIZES = "list_transform(range(1, len(z)), lambda i: z[i] + z[i + 1])"


@query("merge_to_max", _merged(f"list_position({PAIR_SIZES}, list_min({PAIR_SIZES}))", "len(z) <= 8"))
def merge_to_max(spark, sf):
    return op.merge_to_max(v.shots(spark, sf), 8)


@query("probe_window", f"""WITH {v.SHOTS}
SELECT source_id, shot_idx, CASE WHEN s1 - s0 <= 40 THEN s0 ELSE s0 + (s1 - s0 - 40) // 2 END AS w0,
       CASE WHEN s1 - s0 <= 40 THEN s1 ELSE s0 + (s1 - s0 - 40) // 2 + 40 END AS w1 FROM shots""")
def probe_window(spark, sf):
    w0, w1 = op.probe_window(F.col("s0"), F.col("s1"), 20, 2)
    return v.shots(spark, sf).select("source_id", "shot_idx", w0.alias("w0"), w1.alias("w1"))


SPREAD = """SELECT source_id, shot_idx FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {order}) - 1 AS pos,
  count(*) OVER (PARTITION BY source_id) AS n FROM shots)
WHERE CASE WHEN least({k}, n) = 1 THEN pos = n // 2 ELSE list_contains(list_transform(range(0, least({k}, n)),
  lambda j: CAST(round_even(j * (n - 1) / (least({k}, n) - 1.0), 0) AS BIGINT)), pos) END"""


@query("spread_sample", f"WITH {v.SHOTS} " + SPREAD.format(order="shot_idx", k=5))
def spread_sample(spark, sf):
    return op.spread_sample(v.shots(spark, sf), 5, ["shot_idx"]).select("source_id", "shot_idx")


@query("anchor_sample", f"WITH {v.SHOTS} " + SPREAD.format(order="s1 - s0, shot_idx", k=6))
def anchor_sample(spark, sf):
    return op.anchor_sample(v.shots(spark, sf), 6).select("source_id", "shot_idx")


@query("seed_points", f"""WITH {v.PROBES}
SELECT job_id, shot_idx, x FROM (SELECT job_id, shot_idx, x, row_number() OVER (PARTITION BY job_id, shot_idx ORDER BY x) - 1 AS pos,
  count(*) OVER (PARTITION BY job_id, shot_idx) AS n FROM probes) WHERE pos IN (0, round_even((n - 1) / 2.0, 0), n - 1)""")
def seed_points(spark, sf):
    return op.seed_points(v.probes(spark, sf), 3, key=["job_id", "shot_idx"])


@query("running_bounds", f"WITH {v.SHOTS} SELECT source_id, shot_idx, frames, s0 AS f0, s1 AS f1 FROM shots")
def running_bounds(spark, sf):
    return op.running_bounds(v.shot_lengths(spark, sf)).select("source_id", "shot_idx", "frames", "f0", "f1")


@query("scaled_read_count", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity ELSE greatest(1,
  ceil((l_quantity + l_linenumber + l_discount) / (1 + l_linenumber % 3) - 0.55)) END AS BIGINT) AS frames FROM lineitem""")
def scaled_read_count(spark, sf):
    n = F.col("l_linenumber")
    frames = op.scaled_read_count(F.col("l_quantity"), F.col("l_quantity") + n, F.col("l_discount"), 1 + n % 3)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", frames.alias("frames"))


@query("sample_frames", f"""WITH {v.FRAMES}
SELECT source_id, frame_no FROM frames f WHERE frame_no % 3 = 0 OR EXISTS (
  SELECT 1 FROM frames r WHERE r.source_id = f.source_id AND r.mafd >= 150 AND f.frame_no >= r.frame_no AND f.frame_no < r.frame_no + 4)""")
def sample_frames(spark, sf):
    frames = v.frames(spark, sf)
    ranges = frames.filter("mafd >= 150").select("source_id", F.col("frame_no").alias("r0"), (F.col("frame_no") + 4).alias("r1"))
    return op.sample_frames(frames, 3, ranges).select("source_id", "frame_no")


# a conversation's turns as checksums; the other side drops its first turn, changes one, or is equal
SEQS = """a AS (SELECT conv_id AS source_id, turn AS pos, md5(text) AS checksum, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT source_id, pos - CASE WHEN source_id % 3 = 1 THEN 1 ELSE 0 END AS pos,
  CASE WHEN source_id % 3 = 2 AND pos = n - 1 THEN 'other' ELSE checksum END AS checksum FROM a WHERE NOT (source_id % 3 = 1 AND pos = 0)
  UNION ALL SELECT source_id, n - 1, 'tail' FROM a WHERE source_id % 3 = 1 AND pos = 0)"""


def _sequences(spark, sf):
    talk = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"),
                                                    F.md5("text").alias("checksum"))
    n = talk.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("source_id") % 3
    both = talk.join(n, "source_id")
    b = both.filter(~((k == 1) & (F.col("pos") == 0))).select(
        "source_id", (F.col("pos") - F.when(k == 1, 1).otherwise(0)).alias("pos"),
        F.when((k == 2) & (F.col("pos") == F.col("n") - 1), "other").otherwise(F.col("checksum")).alias("checksum"))
    tail = both.filter((k == 1) & (F.col("pos") == 0)).select("source_id", (F.col("n") - 1).alias("pos"), F.lit("tail").alias("checksum"))
    return talk, b.unionByName(tail)


@query("align_sequences", f"""WITH {SEQS},
la AS (SELECT source_id, list(checksum ORDER BY pos) AS x FROM a GROUP BY source_id),
lb AS (SELECT source_id, list(checksum ORDER BY pos) AS y FROM b GROUP BY source_id),
k AS (SELECT source_id, min(k) AS shift FROM la JOIN lb USING (source_id), (SELECT unnest(range(1, 64)) AS k)
  WHERE k < least(len(x), len(y)) AND (x[1:len(x) - k] = y[k + 1:len(y)] OR y[1:len(y) - k] = x[k + 1:len(x)]) GROUP BY source_id)
SELECT source_id, CASE WHEN x = y THEN 'same' WHEN shift IS NOT NULL THEN 'shifted' ELSE 'different' END AS verdict,
       CASE WHEN x <> y THEN shift END AS shift FROM la JOIN lb USING (source_id) LEFT JOIN k USING (source_id)""")
def align_sequences(spark, sf):
    a, b = _sequences(spark, sf)
    return op.align_sequences(a, b)


COUNTS = v.SHOTS + """,
actual AS (SELECT source_id, shot_idx, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN frames + 1 ELSE frames END AS actual FROM shots)"""


def _reconciled(spark, sf):
    shots, k = v.shots(spark, sf), F.col("o_orderkey")
    actual = shots.select("source_id", "shot_idx", F.when(k % 11 == 0, None).when(k % 13 == 0, F.col("frames") + 1).otherwise(
        F.col("frames")).alias("actual"))
    return op.reconcile_counts(shots.select("source_id", "shot_idx", F.col("frames").alias("expected")), actual)


@query("reconcile_counts", f"""WITH {COUNTS}
SELECT source_id, shot_idx, frames AS expected, actual, CASE WHEN actual IS NULL THEN 'skipped' WHEN actual <> frames THEN 'error' ELSE 'ok' END AS verdict
FROM shots JOIN actual USING (source_id, shot_idx)""")
def reconcile_counts(spark, sf):
    return _reconciled(spark, sf)


@query("reconcile_totals", f"""WITH {COUNTS},
rolled AS (SELECT source_id, CAST(sum(frames) AS BIGINT) AS expected, count(*) FILTER (WHERE actual <> frames) AS bad_shots, max(s1) AS frames
  FROM shots JOIN actual USING (source_id, shot_idx) GROUP BY source_id)
SELECT source_id, expected, bad_shots, frames, frames + source_id % 3 AS stamps, bad_shots = 0 AND frames = expected AND source_id % 3 <= 1 AS ok FROM rolled""")
def reconcile_totals(spark, sf):
    out = v.shots(spark, sf).groupBy("source_id").agg(F.max("s1").alias("frames")).withColumn(
        "stamps", F.col("frames") + F.col("source_id") % 3)
    return op.reconcile_totals(_reconciled(spark, sf), out)


@query("longest_first", f"WITH {v.SHOTS} SELECT source_id, shot_idx, s1 - s0 AS frames FROM shots ORDER BY frames DESC, source_id, shot_idx")
def longest_first(spark, sf):
    return v.shots(spark, sf).select("source_id", "shot_idx", (F.col("s1") - F.col("s0")).alias("frames")).orderBy(
        F.desc("frames"), "source_id", "shot_idx")
