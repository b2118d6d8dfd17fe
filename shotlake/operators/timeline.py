"""Frame series to shots: cut detection, timeline checks, shot merging, sampling.

frames  source_id, frame_no, pts, scd_score, mafd
shots   source_id, shot_idx, s0, s1      half-open intervals
Every operator takes `key`, the columns that name one title.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.operators import merging
from shotlake.plans import greedy_spacing, ordered_scan, position, settle
from shotlake.plans.rank import ranked

KEY = ("source_id",)
FRAMES = 1 << 16          # frames of one title per chunk
SHOTS = 1 << 14           # shots of one title per chunk
SETTLE_FRAMES = 3


def detect_cuts(frames: DataFrame, threshold: float, min_gap: int, settle: float = 0.0,
                key: Sequence[str] = KEY, chunk: int = FRAMES) -> DataFrame:
    """Cut frames: score at or over the threshold, the following frames calm, and
    at least `min_gap` frames since the previous kept cut.

    Calm means that the largest MAFD of the next three frames is at most
    `settle` times the candidate's own. It is not asked for a title whose MAFD
    series is incomplete, nor where nothing follows.
    """
    key = list(key)
    rows = frames.select(*key, "frame_no", "scd_score", "mafd")
    if settle > 0:
        # each chunk also sees the first frames of the next one
        own = F.floor(F.col("frame_no") / F.lit(chunk)).cast("long")
        spill = (F.pmod("frame_no", F.lit(chunk)) < SETTLE_FRAMES) & (own > 0)
        seen = rows.withColumn("_own", own).withColumn(
            "_chunk", F.explode(F.when(spill, F.array(own, own - 1)).otherwise(F.array(own))))
        ahead = (Window.partitionBy(*key, "_chunk").orderBy("frame_no").rowsBetween(1, SETTLE_FRAMES))
        rows = (seen.withColumn("_next", F.max("mafd").over(ahead))
                .filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk"))
    candidates = rows.filter((F.col("frame_no") > 0) & (F.col("scd_score") >= threshold))
    if settle > 0:
        holed = (frames.filter(F.col("mafd").isNull() != F.col("scd_score").isNull()).select(*key).distinct()
                 .withColumn("_holed", F.lit(True)))
        calm = F.col("_next").isNull() | (F.col("_next") <= F.col("mafd") * settle)
        candidates = candidates.join(holed, key, "left").filter(F.col("_holed").isNotNull() | calm)
    kept = greedy_spacing(candidates.select(*key, "frame_no"), key, "frame_no", min_gap)
    return kept.select(*key, F.col("frame_no").alias("cut"))


def cuts_to_shots(cuts: DataFrame, lengths: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Half-open shots from cut frames; `lengths` gives n_frames of every title."""
    key = list(key)
    starts = cuts.select(*key, F.col("cut").alias("s0")).unionByName(
        lengths.select(*key, F.lit(0).cast("long").alias("s0"))).distinct()
    starts = settle(starts.join(lengths.select(*key, "n_frames"), key).filter(F.col("s0") < F.col("n_frames"))
                    .withColumn("_one", F.lit(1).cast("long")))
    ends = ordered_scan(starts, key, ["s0"], width=FRAMES, lead={"_next": "s0"}, running={"_rank": ("sum", "_one")})
    return ends.select(*key, (F.col("_rank") - 1).alias("shot_idx"), "s0", F.coalesce("_next", "n_frames").alias("s1"))


def frame_counts(frames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return frames.groupBy(*key).agg(F.count(F.lit(1)).alias("n_frames"))


def frames_to_shots(frames: DataFrame, shots: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Each frame with the shot whose [s0, s1) holds it; frames outside every
    shot are left out. The starts are carried down the frame order, so there is
    no range join."""
    key = list(key)
    columns = [c for c in frames.columns if c not in key]
    marks = shots.select(*key, F.col("s0").alias("frame_no"), F.lit(0).alias("_kind"),
                         F.struct("shot_idx", "s0", "s1").alias("_shot"))
    both = frames.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    placed = ordered_scan(both, key, ["frame_no", "_kind"], width=FRAMES, running={"_in": ("last", "_shot")})
    return (placed.filter((F.col("_kind") == 1) & (F.col("frame_no") < F.col("_in.s1")))
            .select(*key, *columns, F.col("_in.shot_idx").alias("shot_idx"),
                    F.col("_in.s0").alias("s0"), F.col("_in.s1").alias("s1")))


def shot_scores(frames: DataFrame, shots: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Frames, mean and peak change score of each shot."""
    placed = frames_to_shots(frames, shots, key)
    return placed.groupBy(*key, "shot_idx", "s0", "s1").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("scd_score").alias("mean_score"), F.max("scd_score").alias("peak_score"))


def check_timeline(frames: DataFrame, fps: Column, key: Sequence[str] = KEY, short: float = 0.5, long: float = 1.5,
                   rate_tolerance: float = 0.005, gap_share: float = 0.005) -> DataFrame:
    """One verdict per title: duplicate (an interval under half a frame), variable
    (too many intervals over one and a half), rate (the average is off), gaps
    (some holes, followed), ok, or unknown with fewer than three stamps."""
    key = list(key)
    stamped = frames.filter(F.col("pts").isNotNull()).withColumn("_fps", fps)
    steps = ordered_scan(stamped.select(*key, "frame_no", "pts", "_fps"), key, ["frame_no"], width=FRAMES,
                         lag={"_prev": "pts"})
    d = F.col("pts") - F.col("_prev")
    is_short = d < F.lit(short) / F.col("_fps")
    is_gap = ~is_short & (d > F.lit(long) / F.col("_fps"))
    told = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.first("_fps").alias("fps"),
        F.count_if(is_short).alias("n_short"), F.count_if(is_gap).alias("n_gaps"),
        F.min(F.when(is_short, F.col("frame_no"))).alias("first_short"),
        F.min(F.when(is_gap, F.col("frame_no"))).alias("first_gap"),
        (F.max_by("pts", "frame_no") - F.min_by("pts", "frame_no")).alias("span"))
    told = told.withColumn("measured_fps", F.when(F.col("span") > 0, (F.col("n") - 1) / F.col("span")).otherwise(0.0))
    verdict = (F.when(F.col("n") < 3, "unknown")
               .when(F.col("n_short") > 0, "duplicate")
               .when(F.col("n_gaps") > (F.col("n") - 1) * gap_share, "variable")
               .when(F.abs(F.col("measured_fps") - F.col("fps")) / F.col("fps") > rate_tolerance, "rate")
               .when(F.col("n_gaps") > 0, "gaps").otherwise("ok"))
    return told.select(*key, "n", "measured_fps", "n_short", "first_short", "n_gaps", "first_gap",
                       verdict.alias("verdict"), verdict.isin("duplicate", "variable", "rate").alias("refused"))


def timeline_slots(frames: DataFrame, fps: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Each frame's slot on the 1/fps grid, counted from the first frame; the
    frame number itself for a title with fewer than two stamps."""
    key = list(key)
    first = frames.groupBy(*key).agg(F.min_by("pts", "frame_no").alias("_p0"), F.count("pts").alias("_stamps"))
    slot = F.bround((F.col("pts") - F.col("_p0")) * fps).cast("long")
    return (frames.join(first, key)
            .withColumn("slot", F.when(F.col("_stamps") >= 2, slot).otherwise(F.col("frame_no")))
            .drop("_p0", "_stamps"))


def slot_at(slots: DataFrame, wanted: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Slot of each (title, frame) asked for; past the last frame it goes on by one per frame."""
    key = list(key)
    last = slots.groupBy(*key).agg(F.max("frame_no").alias("_lf"), F.max_by("slot", "frame_no").alias("_ls"))
    known = slots.select(*key, F.col("frame_no").alias("frame"), F.col("slot").alias("_slot"))
    beyond = F.col("_ls") + (F.col("frame") - F.col("_lf"))
    return (wanted.join(known, [*key, "frame"], "left").join(last, key, "left")
            .withColumn("slot", F.coalesce("_slot", beyond, "frame")).drop("_slot", "_lf", "_ls"))


def shot_spans(shots: DataFrame, slots: DataFrame, fps: float, key: Sequence[str] = KEY) -> DataFrame:
    """Seconds each shot takes on the slot grid: what a joined output gives it."""
    key = list(key)
    ends = shots.select(*key, "shot_idx", F.explode(F.array(
        F.struct(F.lit("a").alias("end"), F.col("s0").alias("frame")),
        F.struct(F.lit("b").alias("end"), F.col("s1").alias("frame")))).alias("e"))
    found = slot_at(slots, ends.select(*key, "shot_idx", "e.end", "e.frame"), key)
    return found.groupBy(*key, "shot_idx").agg(
        ((F.max(F.when(F.col("end") == "b", F.col("slot"))) - F.max(F.when(F.col("end") == "a", F.col("slot"))))
         / F.lit(float(fps))).alias("seconds"))


def validate_intervals(shots: DataFrame, titles: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Whether each title's shots cover it once, in order. `titles` gives
    n_frames, an estimate: missing it is a warning, not an error."""
    key = list(key)
    steps = ordered_scan(shots, key, ["shot_idx"], width=SHOTS, lag={"_end": "s1"})
    first = F.col("_end").isNull()
    told = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_shots"),
        F.max(F.when(first, F.col("s0"))).alias("_start"),
        F.min(F.when(F.col("s1") <= F.col("s0"), F.col("shot_idx"))).alias("_empty"),
        F.min(F.when(F.col("s0") > F.col("_end"), F.col("shot_idx"))).alias("_gap"),
        F.min(F.when(F.col("s0") < F.col("_end"), F.col("shot_idx"))).alias("_overlap"),
        F.max_by("s1", "shot_idx").alias("covered"))
    no_gap = F.col("_gap").isNull()
    gap_first = ~no_gap & (F.col("_overlap").isNull() | (F.col("_gap") < F.col("_overlap")))
    error = (F.when(F.col("n_shots").isNull(), "empty list")
             .when(F.col("_start") != 0, "late start")
             .when(F.col("_empty").isNotNull(), "empty interval")
             .when(gap_first, "gap").when(F.col("_overlap").isNotNull(), "overlap"))
    return titles.select(*key, "n_frames").join(told, key, "left").select(
        *key, F.coalesce("n_shots", F.lit(0)).alias("n_shots"), error.alias("error"), "covered",
        (error.isNull() & (F.col("covered") != F.col("n_frames"))).alias("estimate_off"))


def merge_short(shots: DataFrame, min_frames: int, key: Sequence[str] = KEY, chunk: int = FRAMES) -> DataFrame:
    """Fold shots under `min_frames` into their shorter neighbour, shortest first.

    Two neighbouring shots that are both long enough never influence each
    other's surroundings, so a title falls apart there into independent
    groups; only groups holding a short shot are folded. A group of over
    merging.GROUP shots is merged length by length first, `chunk` frames to a task.
    """
    key = list(key)
    if min_frames <= 0:
        return shots.select(*key, "shot_idx", "s0", "s1")
    sized = shots.select(*key, "s0", "s1").withColumn("_short", F.col("s1") - F.col("s0") < min_frames)
    near = ordered_scan(sized, key, ["s0"], width=FRAMES, lag={"_before": "_short"}, lead={"_after": "_short"})
    near = settle(near).withColumn("_busy", F.col("_short") | F.coalesce("_before", F.lit(False))
                           | F.coalesce("_after", F.lit(False)))
    calm = near.filter(~F.col("_busy")).select(*key, "s0", "s1")
    # the group starts at a long shot whose predecessor is long (or absent)
    opens = F.when(~F.coalesce("_before", F.lit(False)) & (~F.col("_short") | F.col("_before").isNull()), F.col("s0"))
    busy = ordered_scan(near.filter("_busy").withColumn("_opens", opens), key, ["s0"], width=FRAMES,
                        running={"_group": ("last", "_opens")})
    runs = settle(busy.select(F.struct(F.struct(*key).alias("_t"), F.col("_group").alias("_g")).alias("_id"), "s0", "s1"))
    runs = merging.merge_levels(runs, min_frames, chunk)
    # up to GROUP shots, or none of them short
    packed = runs.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("s0", "s1"))).alias("_run"))
    packed = packed.join(merging.large_runs(runs), "_id", "left_anti")
    starts, ends = F.transform("_run", lambda r: r["s0"]), F.transform("_run", lambda r: r["s1"])

    @F.pandas_udf("array<struct<s0:long,s1:long>>")
    def fold(s0: pd.Series, s1: pd.Series) -> pd.Series:
        return pd.Series([_merge_shortest(a.tolist(), b.tolist(), min_frames) for a, b in zip(s0, s1)])

    folded = packed.select("_id._t.*", F.inline(fold(starts, ends)))
    long = runs.join(merging.large_runs(runs), "_id", "left_semi").select("_id._t.*", "s0", "s1")
    every = calm.unionByName(folded).unionByName(long)
    return position(settle(every), key, ["s0"], FRAMES, "shot_idx").select(*key, "shot_idx", "s0", "s1")


def _merge_shortest(s0: list[int], s1: list[int], bound: int) -> list[dict[str, int]]:
    """Shots left after merging the shortest (leftmost) first."""
    n = len(s0)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size = [b - a for a, b in zip(s0, s1)]
    end, alive = list(s1), [True] * n
    heap = [(size[i], i) for i in range(n) if size[i] < bound]
    heapq.heapify(heap)
    while heap:
        length, i = heapq.heappop(heap)
        if not alive[i] or length != size[i]:
            continue
        a, b = left[i], right[i]
        if a < 0 and b >= n:
            break
        into_left = b >= n or (a >= 0 and size[a] <= size[b])
        lo, hi = (a, i) if into_left else (i, b)
        size[lo] += size[hi]
        end[lo], alive[hi] = end[hi], False
        right[lo] = right[hi]
        if right[hi] < n:
            left[right[hi]] = lo
        if size[lo] < bound:
            heapq.heappush(heap, (size[lo], lo))
    return [{"s0": s0[i], "s1": end[i]} for i in range(n) if alive[i]]


def merge_to_max(shots: DataFrame, max_shots: int, key: Sequence[str] = KEY, chunk: int = FRAMES) -> DataFrame:
    """Merge the adjacent pair with the smallest total until a title has at most `max_shots`.

    Merged totals only grow, so every merge needed has a total of at most
    2 * length / (max_shots - 1): while more shots than allowed are left, some
    pair is that small. A pair larger than this at the start is never merged,
    so titles fall apart there. Each group lists its merges (one of over
    merging.GROUP shots in rounds, `chunk` frames to a task), and a title takes
    the smallest ones (leftmost on a tie) that it needs.
    """
    key = list(key)
    count = shots.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), (F.max("s1") - F.min("s0")).alias("_len"))
    over = count.filter(F.col("_n") > max_shots)
    within = shots.join(over, key, "left_anti").select(*key, "s0", "s1")
    limit = (F.col("_len") * F.lit(2.0) / F.lit(max_shots - 1)) if max_shots > 1 else F.lit(float("inf"))
    busy = shots.select(*key, "s0", "s1").join(over.withColumn("_limit", limit), key)
    busy = settle(busy.withColumn("_size", F.col("s1") - F.col("s0")))
    near = ordered_scan(busy, key, ["s0"], width=FRAMES, lag={"_prev": "_size"})
    apart = F.col("_prev").isNull() | (F.col("_prev") + F.col("_size") > F.col("_limit"))
    near = ordered_scan(settle(near.withColumn("_opens", F.when(apart, F.col("s0")))), key, ["s0"], width=FRAMES,
                        running={"_group": ("last", "_opens")})
    runs = settle(near.select(F.struct(F.struct(*key).alias("_t"), F.col("_group").alias("_g")).alias("_id"), "_limit", "s0", "_size"))
    runs, early = merging.pair_rounds(runs, chunk)
    packed = runs.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("s0", "_size"))).alias("_run"), F.first("_limit").alias("_limit"))
    starts, sizes = F.transform("_run", lambda r: r["s0"]), F.transform("_run", lambda r: r["_size"])

    @F.pandas_udf("array<struct<total:long,at:long,gone:long>>")
    def merges(s0: pd.Series, size: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([_merge_pairs(a.tolist(), b.tolist(), c) for a, b, c in zip(s0, size, bound)])

    steps = packed.select("_id", F.inline(merges(starts, sizes, F.col("_limit"))))
    steps = (steps if early is None else steps.unionByName(early)).select("_id._t.*", "total", "at", "gone")
    placed = ranked(steps, key, ["total", "at"], "_rank").join(over, key)
    gone = placed.filter(F.col("_rank") < F.col("_n") - max_shots).select(*key, F.col("gone").alias("s0"))
    left = ordered_scan(settle(busy.select(*key, "s0", "s1").join(gone, [*key, "s0"], "left_anti")), key, ["s0"],
                        width=FRAMES, lead={"_next": "s0"})
    last = busy.groupBy(*key).agg(F.max("s1").alias("_last"))
    merged = left.join(last, key).select(*key, "s0", F.coalesce("_next", "_last").alias("s1"))
    return position(settle(within.unionByName(merged)), key, ["s0"], FRAMES, "shot_idx").select(*key, "shot_idx", "s0", "s1")


def _merge_pairs(s0: list[int], size: list[int], limit: float) -> list[dict[str, int]]:
    """Every merge up to `limit`, in order: its total, the left start, the removed start."""
    n, steps = len(s0), []
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size, alive = list(size), [True] * n
    heap = [(size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        if not alive[i] or not alive[j] or right[i] != j or size[i] + size[j] != total:
            continue
        steps.append({"total": total, "at": s0[i], "gone": s0[j]})
        size[i], alive[j], right[i] = total, False, right[j]
        if right[j] < n:
            left[right[j]] = i
            heapq.heappush(heap, (total + size[right[j]], i, right[j]))
        if left[i] >= 0:
            heapq.heappush(heap, (size[left[i]] + total, left[i], i))
    return steps


def probe_window(s0: Column, s1: Column, max_frames: int, rate: int = 1) -> tuple[Column, Column]:
    """The centred run of at most max_frames * rate frames that is probed."""
    want = max(1, max_frames) * max(1, rate)
    n = F.greatest(F.lit(1), s1 - s0)
    start = F.when(n <= want, s0).otherwise(s0 + F.floor((n - want) / 2).cast("long"))
    return start, F.when(n <= want, s1).otherwise(start + want)


def scaled_read_count(frames: Column, slots: Column, delta: Column, rate: Column) -> Column:
    """Frames a read of a window emits at a probing rate; `delta` is where the
    seek landed, in frames."""
    periods = F.ceil((slots + delta) / rate - 0.55).cast("long")
    return F.when(rate <= 1, frames.cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), periods))


def _spread(pos: Column, n: Column, k: int) -> Column:
    """Whether a position is one of k evenly spaced ones, both ends included (half-even)."""
    want = F.least(F.lit(k), n)
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(want - 1, F.lit(1)).cast("long"))
    picks = F.transform(steps, lambda j: F.bround(j * (n - 1) / F.greatest(want - 1, F.lit(1)).cast("double")).cast("long"))
    return F.when(want <= 1, pos == F.floor(n / 2)).otherwise(F.array_contains(picks, pos))


def spread_sample(df: DataFrame, k: int, order: Sequence[str], key: Sequence[str] = KEY,
                  width: float = SHOTS) -> DataFrame:
    """k evenly spaced rows of each title, both ends included; k = 1 takes the middle one."""
    key = list(key)
    if k <= 0:
        return df.limit(0)
    rows = ordered_scan(df.withColumn("_one", F.lit(1).cast("long")), key, order, width=width,
                        running={"_rank": ("sum", "_one")}, totals={"_n": ("sum", "_one")})
    return rows.filter(_spread(F.col("_rank") - 1, F.col("_n"), k)).drop("_one", "_rank", "_n")


def seed_points(grid: DataFrame, k: int, x: str = "x", key: Sequence[str] = KEY) -> DataFrame:
    """The settings an adaptive search starts from: at least both ends of each grid."""
    key = list(key)
    return spread_sample(grid.select(*key, x).distinct(), max(2, k), [x], key, width=None)


def anchor_sample(shots: DataFrame, k: int = 16, key: Sequence[str] = KEY) -> DataFrame:
    """Shots evenly spaced by length rank (at least four), so that short and long ones are both measured."""
    key = list(key)
    # by rank, so a title whose shots are all of one length is spread as well
    placed = ranked(shots.withColumn("_size", F.col("s1") - F.col("s0")), key, ["_size", "shot_idx"], "_rank").withColumn("_id", F.struct(*key))
    sizes = placed.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, "_id").filter(_spread(F.col("_rank"), F.col("_n"), max(4, k))).drop("_id", "_size", "_rank", "_n")


def running_bounds(lengths: DataFrame, order: str = "shot_idx", frames: str = "frames",
                   key: Sequence[str] = KEY) -> DataFrame:
    """Frame offsets [f0, f1) of each shot from per-shot lengths."""
    summed = ordered_scan(lengths, key, [order], width=SHOTS, running={"f1": ("sum", frames)})
    return summed.withColumn("f0", F.col("f1") - F.col(frames))


def sample_frames(frames: DataFrame, step: int, ranges: DataFrame | None = None,
                  key: Sequence[str] = KEY) -> DataFrame:
    """Every step-th frame and every frame of the given [r0, r1) ranges (a few per title)."""
    key = list(key)
    kept = F.pmod("frame_no", F.lit(step)) == 0 if step > 0 else F.lit(False)
    if ranges is None:
        return frames.filter(kept)
    # the ranges carried down the frame order: the furthest end opened so far
    marks = ranges.select(*key, F.col("r0").alias("frame_no"), F.lit(0).alias("_kind"), F.col("r1").alias("_r1"))
    marks = marks.groupBy(*key, "frame_no", "_kind").agg(F.max("_r1").alias("_r1"))
    both = frames.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    held = ordered_scan(both, key, ["frame_no", "_kind"], width=FRAMES, running={"_until": ("max", "_r1")})
    inside = F.coalesce(F.col("frame_no") < F.col("_until"), F.lit(False))
    return held.filter((F.col("_kind") == 1) & (kept | inside)).select(*frames.columns)


# modulus and two bases of the rolling hashes below
_PRIME = 2147483629
_BASES = (911382323, 972663749)
_DIGIT = 1024


def _power(base: int, exponent: Column) -> Column:
    """base ** exponent mod the prime, from three tables of 1024 entries (exponents under 2**30)."""
    def table(step: int) -> Column:
        unit, value, out = pow(base, step, _PRIME), 1, []
        for _ in range(_DIGIT):
            out.append(value)
            value = value * unit % _PRIME
        return F.from_json(F.lit(str(out)), "array<bigint>")

    low, mid, high = exponent % _DIGIT, F.floor(exponent / _DIGIT) % _DIGIT, F.floor(exponent / _DIGIT**2)
    parts = [F.element_at(table(s), d.cast("int") + 1) for s, d in ((1, low), (_DIGIT, mid), (_DIGIT**2, high))]
    return (parts[0] * parts[1] % _PRIME) * parts[2] % _PRIME


def align_sequences(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY, chunk: int = FRAMES) -> DataFrame:
    """Compare two checksum sequences (key, pos, checksum): same, shifted by k
    (one without its last k equals the other without its first k), or different.

    Matching a prefix of one side with a suffix of the other goes through
    rolling hashes, one row per position, so repeated checksums (black frames)
    do not multiply into pairs; the shift found is then checked value by value.
    """
    key = list(key)

    def hashed(df: DataFrame) -> DataFrame:
        # the digit of a checksum in each of two rolling hashes
        digit = [F.pmod(F.xxhash64(F.lit(i), "checksum"), F.lit(_PRIME)) for i in range(2)]
        rows = df.select(*key, "pos", "checksum", F.lit(1).cast("long").alias("_one"), *[
            (digit[i] * _power(_BASES[i], F.col("pos")) % _PRIME).alias(f"_t{i}") for i in range(2)])
        return settle(ordered_scan(
            rows, key, ["pos"], width=chunk, before={f"_p{i}": ("sum", f"_t{i}") for i in range(2)},
            totals={"_n": ("sum", "_one"), **{f"_s{i}": ("sum", f"_t{i}") for i in range(2)}}))

    ha, hb = hashed(a), hashed(b)
    counts = (a.groupBy(*key).agg(F.count(F.lit(1)).alias("n_a"))
              .join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("n_b")), key, "full"))

    def shifts(short: DataFrame, long: DataFrame) -> DataFrame:
        """k where short[:-k] equals long[k:]."""
        pre = [F.coalesce(F.col(f"_p{i}"), F.lit(0)) % _PRIME for i in range(2)]
        heads = short.select(*key, (F.col("_n") - F.col("pos")).alias("k"), F.col("_n").alias("_na"), *[
            (pre[i] * _power(_BASES[i], F.col("_n") - F.col("pos")) % _PRIME).alias(f"_h{i}") for i in range(2)])
        tails = long.select(*key, F.col("pos").alias("k"), F.col("_n").alias("_nb"), *[
            F.pmod(F.col(f"_s{i}") - F.coalesce(F.col(f"_p{i}"), F.lit(0)), F.lit(_PRIME)).alias(f"_g{i}")
            for i in range(2)])
        met = heads.filter("k >= 1 AND k < _na").join(tails, [*key, "k"])
        return met.filter("_na = _nb AND _h0 = _g0 AND _h1 = _g1").select(*key, "k")

    best = shifts(ha, hb).withColumn("_dir", F.lit(1)).unionByName(
        shifts(hb, ha).withColumn("_dir", F.lit(-1))).groupBy(*key).agg(
        F.min(F.struct(F.col("k"), (-F.col("_dir")).alias("o"))).alias("_best"))
    best = best.select(*key, F.col("_best.k").alias("k"), (-F.col("_best.o")).alias("_dir"))

    def differing(shift: DataFrame | None) -> DataFrame:
        """Positions of the overlap whose checksums differ, per title."""
        moved = a.select(*key, "pos", F.col("checksum").alias("_ca"))
        if shift is not None:
            moved = moved.join(shift, key).withColumn("pos", F.col("pos") + F.col("k") * F.col("_dir"))
        met = moved.join(b.select(*key, "pos", F.col("checksum").alias("_cb")), [*key, "pos"])
        return met.groupBy(*key).agg(F.count_if(~F.col("_ca").eqNullSafe(F.col("_cb"))).alias("_bad"))

    same = differing(None).withColumnRenamed("_bad", "_bad0")
    sure = differing(best).withColumnRenamed("_bad", "_bad1")
    told = counts.join(same, key, "left").join(best, key, "left").join(sure, key, "left")
    equal = (F.col("n_a") == F.col("n_b")) & (F.col("_bad0") == 0)
    shifted = F.col("k").isNotNull() & (F.col("_bad1") == 0)
    return told.select(*key, F.when(equal, "same").when(shifted, "shifted").otherwise("different").alias("verdict"),
                       F.when(~F.coalesce(equal, F.lit(False)) & shifted, F.col("k")).alias("shift"))


def reconcile_counts(expected: DataFrame, actual: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Frames written against frames spanned, per shot: ok, error, or skipped when
    the count could not be read."""
    key = list(key)
    both = expected.select(*key, "shot_idx", "expected").join(
        actual.select(*key, "shot_idx", "actual"), [*key, "shot_idx"], "left")
    verdict = (F.when(F.col("actual").isNull(), "skipped")
               .when(F.col("actual") != F.col("expected"), "error").otherwise("ok"))
    return both.withColumn("verdict", verdict)


def reconcile_totals(reconciled: DataFrame, outputs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Roll-up of reconcile_counts against the finished file: its frames must be the
    sum over shots, and its timestamps may number the frames or one more."""
    key = list(key)
    rolled = reconciled.groupBy(*key).agg(
        F.sum("expected").alias("expected"), F.count_if(F.col("verdict") == "error").alias("bad_shots"))
    frames_ok = F.col("frames").isNull() | (F.col("frames") == F.col("expected"))
    stamps_ok = F.col("stamps").isNull() | F.col("stamps").isin(F.col("expected"), F.col("expected") + 1)
    return (rolled.join(outputs.select(*key, "frames", "stamps"), key, "left")
            .withColumn("ok", (F.col("bad_shots") == 0) & frames_ok & stamps_ok))
