"""Jobs, listings and devices: the archive's bookkeeping over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlake.plans import finite_fold, finite_scan, ordered_scan, position, ranked, settle

STATUSES = ["pending", "analyzing", "running", "done", "failed", "skipped", "cancelled"]
ACTIVE = ["pending", "analyzing", "running"]
FINISHED = ["done", "failed", "skipped", "cancelled"]
DAY = 86400.0


# --- listings ------------------------------------------------------------------

def new_files(listing: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files no job was ever made for."""
    return listing.join(jobs.select(F.col("source").alias("path")).distinct(), "path", "left_anti")


def active_jobs(listing: DataFrame, jobs: DataFrame) -> DataFrame:
    """The earliest active job of each listed file (exact path)."""
    first = (jobs.filter(F.col("status").isin(ACTIVE)).groupBy(F.col("source").alias("path"))
             .agg(F.min_by("id", F.struct("created_at", "id")).alias("job_id"), F.min("created_at").alias("created_at")))
    return first.join(listing.select("path").distinct(), "path", "left_semi")


def settled_files(listing: DataFrame, stable_s: float, min_bytes: int = 0, chunk: int = 1 << 16) -> DataFrame:
    """Files that are done being written: large enough, unchanged for `stable_s`
    seconds, and seen twice in a row with the same size and time. Once per file.
    A path listed any number of times is cut into chunks of `chunk` observations."""
    large = listing.filter(F.col("size") >= min_bytes).withColumn("_print", F.struct("size", "mtime"))
    seen = ordered_scan(ranked(large, ["path"], ["scan_ts"], "_place"), ["path"], ["_place"], width=chunk, lag={"_last": "_print"})
    age = F.col("scan_ts").cast("double") - F.col("mtime").cast("double")
    ok = (age >= stable_s) & F.col("_last").eqNullSafe(F.col("_print"))
    return seen.filter(ok).groupBy("path").agg(
        F.min("scan_ts").alias("accepted_at"), F.min_by("size", "scan_ts").alias("size"))


# fixed values: what a player takes as an external subtitle, subtitle folders, video suffixes
SUBTITLE_EXTS = ["srt", "ass", "ssa", "vtt", "sub", "idx", "sup", "smi"]
SUBTITLE_DIRS = ["subs", "subtitles", "sub"]
VIDEO_EXTS = ["mkv", "mp4", "m4v", "avi", "mov", "ts", "m2ts", "webm", "wmv"]


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def pair_sidecars(videos: DataFrame, sidecars: DataFrame, video_exts: Sequence[str] = VIDEO_EXTS,
                  sidecar_exts: Sequence[str] = SUBTITLE_EXTS) -> DataFrame:
    """Subtitle files with the video they belong to: named like it plus a dot, in its
    folder or a subtitle folder beside it; the longest matching stem of the folder wins.

    Every dotted prefix of a sidecar's name is looked up by equality, so there is no prefix join.
    """
    named = videos.filter(_suffix(F.col("name")).isin(list(video_exts))).select(
        F.col("dir").alias("home"), F.col("name").alias("video"), F.lower(_stem(F.col("name"))).alias("stem"))
    parent = F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)
    folder = F.regexp_extract("dir", r"([^/]*)$", 1)
    homes = F.when(F.lower(folder).isin(SUBTITLE_DIRS), F.array(
        F.struct(F.col("dir").alias("home"), F.lit("").alias("rel")),
        F.struct(parent.alias("home"), folder.alias("rel")))).otherwise(
        F.array(F.struct(F.col("dir").alias("home"), F.lit("").alias("rel"))))
    parts = F.split(F.lower("name"), r"\.", -1)
    # dotted prefixes with at least one character after the dot
    stems = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    keep = F.filter(stems, lambda s: F.length(F.col("name")) > F.length(s) + 1)
    tried = (sidecars.filter(_suffix(F.col("name")).isin(list(sidecar_exts)) & F.col("name").contains("."))
             .select("dir", "name", F.inline(homes)).select("*", F.explode(
                 F.transform(F.sequence(F.lit(1), F.size(keep)), lambda i: F.element_at(keep, i))).alias("stem")))
    # at most one row per dotted prefix and video suffix
    longest = Window.partitionBy("dir", "name", "home").orderBy(F.length("stem").desc())
    return (tried.join(named, ["home", "stem"]).withColumn("_rank", F.rank().over(longest)).filter("_rank = 1")
            .select("dir", "name", "home", "rel", "video"))


def reconcile_copies(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Each planned copy (source, dest, sha) against what is at dest (path, sha):
    copied, same, or kept when different content is there; `removable` sources have their copy in place."""
    both = planned.join(existing.select(F.col("path").alias("dest"), F.col("sha").alias("_sha")), "dest", "left")
    status = F.when(F.col("_sha").isNull(), "copied").when(F.col("_sha") == F.col("sha"), "same").otherwise("kept")
    return both.withColumn("status", status).withColumn("removable", F.col("status") != "kept").drop("_sha")


def browse_order(entries: DataFrame) -> DataFrame:
    """Directories first, then names without regard to case; dot files are hidden."""
    return entries.filter(~F.col("name").startswith(".")).orderBy(~F.col("is_dir"), F.lower("name"), "name")


# --- job table -----------------------------------------------------------------

def count_by_status(jobs: DataFrame) -> DataFrame:
    """Jobs per status, all seven of them."""
    spark = jobs.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n"))


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int = 500) -> DataFrame:
    """Newest first, at most `limit` (a page)."""
    rows = jobs if status is None else jobs.filter(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def jobs_by_prefix(jobs: DataFrame, prefix: str, limit: int = 2) -> DataFrame:
    """Jobs whose id starts so; two rows mean that the prefix is ambiguous."""
    return jobs.filter(F.col("id").startswith(prefix)).orderBy("id").limit(limit)


def next_pending(jobs: DataFrame, k: int = 1) -> DataFrame:
    return jobs.filter(F.col("status") == "pending").orderBy("created_at", "id").limit(k)


def queue_positions(jobs: DataFrame) -> DataFrame:
    """1-based place of each pending job, oldest first; jobs of one moment are spread like any others."""
    pending = jobs.filter(F.col("status") == "pending").select("id", "created_at")
    return ranked(pending, [], ["created_at", "id"], "_p").select("id", (F.col("_p") + 1).alias("position"))


def order_rank(status: Column) -> Column:
    return F.when(status.isin("analyzing", "running"), 0).when(status == "pending", 1).otherwise(2)


def execution_order(jobs: DataFrame) -> DataFrame:
    """Running jobs by start, pending ones by age, finished ones newest first."""
    rank = order_rank(F.col("status"))
    return jobs.orderBy(
        rank, F.when(rank == 0, F.col("started_at")).asc_nulls_last(),
        F.when(rank == 1, F.col("created_at")).asc_nulls_last(),
        F.when(rank == 2, F.coalesce("finished_at", "created_at")).desc_nulls_last(), "id")


def prune(jobs: DataFrame, statuses: Sequence[str] = FINISHED) -> DataFrame:
    """Jobs left after removing the given finished ones; active jobs always stay."""
    return jobs.filter(~F.col("status").isin([s for s in statuses if s in FINISHED]))


def prune_orphans(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Logs whose job is gone."""
    return logs.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def retention(logs: DataFrame, now: Column, days: float, at: str = "mtime") -> DataFrame:
    """Logs older than `days`, to be deleted."""
    return logs.filter(F.col(at).cast("double") < now.cast("double") - F.lit(days * DAY))


def job_savings(jobs: DataFrame, now: Column) -> DataFrame:
    """Per job: share of the size saved, run time, and time left in the current stage."""
    ends = F.coalesce("finished_at", F.when(F.col("status").isin("analyzing", "running"), now))
    ratio = F.when((F.col("size_before") > 0) & (F.col("size_after") > 0), 1 - F.col("size_after") / F.col("size_before"))
    hidden = F.coalesce("stage", F.lit("")).isin("scenedetect", "probing", "verifying")
    eta = F.when((F.col("progress_total") > 0) & (F.col("progress_fps") > 0) & ~hidden, F.greatest(
        F.lit(0), F.col("progress_total") - F.col("progress_done")) / F.col("progress_fps"))
    ran = ends - F.col("started_at")
    return jobs.withColumns({"saved": ratio, "run_seconds": F.when(ran.isNotNull(), F.greatest(F.lit(0.0), ran)), "eta_seconds": eta})


def library_savings(jobs: DataFrame, by: Sequence[str] = ("preset", "codec"), how: str = "rollup") -> DataFrame:
    """Sizes before and after over finished jobs, rolled up (or cubed)."""
    done = jobs.filter((F.col("status") == "done") & (F.col("size_before") > 0) & (F.col("size_after") > 0))
    grouped = {"rollup": done.rollup, "cube": done.cube, "group": done.groupBy}[how](*by)
    told = grouped.agg(F.count(F.lit(1)).alias("jobs"), F.sum("size_before").alias("size_before"),
                       F.sum("size_after").alias("size_after"))
    return told.withColumn("saved", 1 - F.col("size_after") / F.col("size_before"))


def verify_outputs(source: DataFrame, output: DataFrame, mux: DataFrame | None = None) -> DataFrame:
    """Finished files against their sources: duration within max(1 s, 0.5 %), equal
    audio count, and the subtitle count the mux reported. One row per source with
    `problems` and `ok`."""
    cols = ["duration", "audio_count", "subtitle_count"]
    both = source.select("id", *[F.col(c).alias("s_" + c) for c in cols]).join(
        output.select("id", "video_codec", *[F.col(c).alias("o_" + c) for c in cols], F.lit(True).alias("_there")),
        "id", "left")
    if mux is not None:
        both = both.join(mux.select("id", "dropped", "added"), "id", "left")
    else:
        both = both.withColumns({"dropped": F.lit(0), "added": F.lit(0)})
    drift = F.abs(F.col("o_duration") - F.col("s_duration"))
    limit = F.greatest(F.lit(1.0), F.col("s_duration") * 0.005)
    subs = F.greatest(F.lit(0), F.col("s_subtitle_count") - F.coalesce("dropped", F.lit(0)) + F.coalesce("added", F.lit(0)))
    there = F.coalesce("_there", F.lit(False))
    has_video = F.coalesce(F.col("video_codec") != "", F.lit(False))
    checks = F.array(
        F.when(~there, "no output"), F.when(there & ~has_video, "no video stream"),
        F.when(there & (F.col("s_duration") > 0) & (F.col("o_duration") > 0) & (drift > limit), "duration"),
        F.when(there & (F.col("s_duration") > 0) & ~(F.col("o_duration") > 0), "no duration"),
        F.when(there & (F.col("o_audio_count") != F.col("s_audio_count")), "audio count"),
        F.when(there & (F.col("o_subtitle_count") != subs), "subtitle count"))
    return (both.withColumn("problems", F.array_compact(checks)).withColumn("ok", F.size("problems") == 0)
            .select("id", "s_duration", "o_duration", "problems", "ok"))


def resolve_presets(jobs: DataFrame, presets: DataFrame, default: str, base: Mapping[str, str]) -> DataFrame:
    """Each job's preset parameters: an empty or unknown name takes the default
    preset, "custom" the base parameters. Many jobs share one preset, so the preset
    table (the settings page) is broadcast once its size has been checked, and the
    default preset is a scalar subquery, not a join."""
    asked = F.when(F.coalesce("preset", F.lit("")) == "", F.lit(default)).otherwise(F.col("preset"))
    named = presets.select(F.col("name").alias("_asked"), F.col("params").alias("_params"))
    fallback = presets.filter(F.col("name") == default).agg(F.first("params")).scalar()
    joined = jobs.withColumn("_asked", asked).join(named, "_asked", "left")
    base_map = F.create_map(*[F.lit(v) for kv in base.items() for v in kv]) if base else F.create_map().cast("map<string,string>")
    custom = F.col("_asked") == "custom"
    return (joined.withColumn("preset_name", F.when(custom, "custom").when(
                F.col("_params").isNotNull(), F.col("_asked")).otherwise(default))
            .withColumn("params", F.when(custom, base_map).otherwise(F.coalesce(F.col("_params"), fallback)))
            .drop("_asked", "_params"))


def layer_params(*layers: Column, known: Sequence[str] | None = None) -> Column:
    """Merge parameter maps, the right-most non-empty value winning; unknown keys are dropped."""
    out = None
    for layer in layers:
        clean = F.map_filter(layer, lambda k, v: v.isNotNull() & (v != "")
                             & (k.isin(list(known)) if known is not None else F.lit(True)))
        out = clean if out is None else F.map_zip_with(out, F.coalesce(clean, F.create_map().cast("map<string,string>")),
                                                      lambda k, a, b: F.coalesce(b, a))
    return out


def override_diff(current: Column, base: Column) -> Column:
    """Entries of `current` whose value is not the base's."""
    return F.map_filter(current, lambda k, v: ~F.try_element_at(base, k).eqNullSafe(v))


def heaviest_step(log: DataFrame, weight: Column | None = None) -> DataFrame:
    """Peak memory of each (job, phase) and the command that held it, the last by name of several; `weight` names the
    heaviest command by another measure than its memory."""
    held = F.struct("gb", "command") if weight is None else F.struct(weight.alias("weight"), "gb", "command")
    return log.groupBy("job_id", "phase").agg(F.max("gb").alias("peak_gb"), F.max_by("command", held).alias("command"))


# --- devices -------------------------------------------------------------------

# fixed values: kernel log patterns and times in seconds
WEDGED = r"(?i)wedged"
CARD_ERRORS = (r"(?i)Timedout job|job timed out|reset started|exec queue reset detected|CAT error|"
               r"Fault response|G2H|-ETIME|\bBUG\b|Oops")
BOX_ERRORS = r"rcu_preempt detected (expedited )?stalls"
COOLOFF_S, TEST_HUNG_S, STALE_S = 600.0, 180.0, 15.0


def classify_device_lines(lines: DataFrame, device: str, driver: str = "xe", line: str = "line") -> DataFrame:
    """Kernel lines as wedged, error or NULL for one PCI address; a stall of the whole box counts as an error."""
    text = F.col(line)
    ours = text.contains(device) & text.contains(driver)
    kind = F.when(ours, F.when(text.rlike(WEDGED), "wedged").when(text.rlike(CARD_ERRORS), "error")).when(
        text.rlike(BOX_ERRORS), "error")
    return lines.withColumn("kind", kind)


def dedup_usage(clients: DataFrame, device: str) -> DataFrame:
    """Memory held on one device per host, in MB: a client counts once however many
    handles show it; `size` is text such as "1234 KiB"."""
    from shotlake.functions.units import size_to_mb

    ours = clients.withColumn("_mb", F.when(
        F.col("device").isNull() | (F.col("device") == "") | (F.col("device") == device), size_to_mb(F.col("size"))))
    once = ours.groupBy("host", "client").agg(F.max("_mb").alias("_mb"))
    return once.groupBy("host").agg(F.coalesce(F.sum("_mb"), F.lit(0.0)).alias("used_mb"))


def device_health(events: DataFrame, now: Column, key: Sequence[str] = ("device",)) -> DataFrame:
    """ok, starting, degraded or down per device at `now`, from (ts, kind, started)
    with kinds error, wedged, test_start, test_ok, test_fail and heartbeat.

    Only a passing test that started after the last error clears it. Without any
    heartbeat event the heartbeat is not judged. Plain aggregates: combined map-side.
    """
    kind, ts = F.col("kind"), F.col("ts")

    def latest(value: Column, *kinds: str) -> Column:
        return F.max_by(value, F.when(kind.isin(*kinds), F.struct(ts, kind)))

    told = events.filter(ts <= now).groupBy(*key).agg(
        latest(ts, "error", "wedged").alias("_error"), latest(ts, "wedged").alias("_wedged"),
        latest(F.col("started"), "test_ok").alias("_passed"), latest(kind, "test_ok", "test_fail").alias("_result"),
        latest(kind, "test_start", "test_ok", "test_fail").alias("_test"),
        latest(ts, "test_start").alias("_since"), latest(ts, "heartbeat").alias("_beat"))

    def passed_after(t: Column) -> Column:
        return F.coalesce(F.col("_passed") > t, F.lit(False))

    state = (F.when(now - F.col("_beat") > STALE_S, "down")
             .when((F.col("_test") == "test_start") & (now - F.col("_since") > TEST_HUNG_S), "down")
             .when(F.col("_wedged").isNotNull() & ~passed_after(F.col("_wedged")), "down")
             .when(F.col("_result") == "test_fail", "down")
             .when(F.col("_error").isNotNull() & (
                 (now - F.col("_error") < COOLOFF_S) | ~passed_after(F.col("_error"))), "degraded")
             .when(F.col("_passed").isNull(), "starting").otherwise("ok"))
    return told.select(*key, state.alias("state"), (state == "ok").alias("usable"))


def failure_streaks(outcomes: DataFrame, n: int, key: Sequence[str] = ("job_id", "device"),
                    order: Sequence[str] = ("seq",), width: float = 4096) -> DataFrame:
    """Consecutive failures after each attempt (outcome ok, fail or neutral): a
    success resets, a neutral outcome is passed over; `retired` from the attempt
    on that made it n in a row."""
    judged = outcomes.filter(F.col("outcome").isin("ok", "fail")).withColumn("_one", F.lit(1).cast("long"))
    seen = ordered_scan(judged, key, order, width=width, running={"_n": ("sum", "_one")})
    seen = settle(seen.withColumn("_ok", F.when(F.col("outcome") == "ok", F.col("_n"))))
    runs = ordered_scan(seen, key, order, width=width, running={"_last": ("max", "_ok")})
    runs = runs.withColumn("streak", F.col("_n") - F.coalesce("_last", F.lit(0)))
    runs = settle(runs.withColumn("_hit", (F.col("streak") >= n).cast("int")))
    return ordered_scan(runs, key, order, width=width, running={"_out": ("max", "_hit")}).withColumn(
        "retired", F.col("_out") == 1).drop("_one", "_n", "_ok", "_last", "_hit", "_out")


def retired_devices(streaks: DataFrame, n: int, key: Sequence[str] = ("job_id", "device"), order: str = "seq") -> DataFrame:
    """Per key: failures, longest streak, and the attempt that retired the device."""
    hit = F.when(F.col("streak") >= n, F.col(order))
    return streaks.groupBy(*key).agg(F.count_if(F.col("outcome") == "fail").alias("failures"),
                                     F.max("streak").alias("longest"), F.min(hit).alias("retired_at"))


def bad_windows(outcomes: DataFrame, window: Sequence[str] = ("w0", "w1"), key: Sequence[str] = ("job_id", "device")) -> DataFrame:
    """Windows that failed once, to be passed over by later attempts."""
    return outcomes.filter(F.col("outcome") == "fail").select(*key, *window).distinct()


# --- job state -----------------------------------------------------------------

EVENTS = ["create", "analyze", "skip", "run", "done", "fail", "cancel", "cancel_all", "restart"]
_STATES = ["none", *STATUSES]


def _next_state(state: tuple[str, int, int], event: str, max_retries: int) -> tuple[str, int, int]:
    """(status, flag, retries) after an event. The flag is "retry" on a pending job, "cancelling" on a running one."""
    status, flag, retries = state
    if event == "create" and status == "none":
        return "pending", 0, 0
    if event == "analyze" and status == "pending":
        return "analyzing", 0, retries
    if event == "skip" and status == "analyzing":
        return "skipped", 0, retries
    if event == "run" and status == "analyzing":
        return "running", 0, retries
    if event == "done" and status == "running":
        return ("cancelled" if flag else "done"), 0, retries
    if event == "fail" and status in ("analyzing", "running"):
        if status == "running" and flag:
            return "cancelled", 0, retries
        return ("pending", 1, retries + 1) if retries < max_retries else ("failed", 0, retries)
    if event in ("cancel", "cancel_all") and status in ("pending", "analyzing"):
        return "cancelled", 0, retries
    if event == "cancel" and status == "running":
        return "running", 1, retries
    if event == "restart" and status in ("analyzing", "running"):
        return "pending", 0, retries
    return state


def job_automaton(max_retries: int = 2) -> tuple[list[tuple[str, int, int]], list[list[int]]]:
    """States that can be reached, and the next state for each event."""
    states, table, i = [("none", 0, 0)], [], 0
    while i < len(states):
        row = []
        for event in EVENTS:
            nxt = _next_state(states[i], event, max_retries)
            if nxt not in states:
                states.append(nxt)
            row.append(states.index(nxt))
        table.append(row)
        i += 1
    return states, table


def stage_of(status: Column, flag: Column) -> Column:
    return (F.when((status == "pending") & (flag == 1), "retry").when((status == "running") & (flag == 1), "cancelling")
            .when(status == "running", "encoding").when(status == "skipped", "skipped").otherwise(""))


def job_state(events: DataFrame, max_retries: int = 2, order: Sequence[str] = ("ts",), width: float = DAY,
              key: Sequence[str] = ("job_id",)) -> DataFrame:
    """Latest state of each job from its events in order; events that do not apply in a state are ignored."""
    states, table = job_automaton(max_retries)
    symbol = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("event")) - 1
    known = events.filter(F.col("event").isin(EVENTS))
    folded = finite_fold(known, key, order, symbol, table, 0, width)
    parts = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(f).alias("flag"), F.lit(r).alias("retries"))
                      for s, f, r in states])
    at = F.element_at(parts, F.col("state") + 1)
    status, flag = at["status"], at["flag"]
    return folded.select(*key, "n_events", status.alias("status"), stage_of(status, flag).alias("stage"),
                         at["retries"].cast("long").alias("retries"))


# stages that a change of status writes; the engine's own reports come between
STAGE_OF = {"analyzing": "analyzing", "running": "encoding", "skipped": "skipped", "done": "done", "failed": "failed", "cancelled": "cancelled"}
REPORTS = ("stage", "progress")


def stage_written(before: tuple[str, int, int], after: tuple[str, int, int], event: str) -> str | None:
    """The stage that an event writes by changing the state; None if it writes none."""
    if before == after:
        return None
    status, flag, _ = after
    if status == "pending":
        return "retry" if flag else ""
    return "cancelling" if status == "running" and flag else STAGE_OF[status]


def job_record(events: DataFrame, max_retries: int = 2, order: Sequence[str] = ("ts",), key: Sequence[str] = ("job_id",),
               chunk: int = 2048) -> DataFrame:
    """The row of each job as its events leave it: status, stage, retries, started_at, finished_at and the last progress.

    events  key..., ts (seconds), event, and for reports: stage (text), pct, done, total, fps

    A report of a stage is taken in any state but `cancelling`; progress in any. A retry and a restart clear started_at.
    Events that do not apply are ignored; ties in `order` fall in an order of their own.
    """
    states, table = job_automaton(max_retries)
    names = F.array(*[F.lit(e) for e in EVENTS])
    # reports leave the automaton where it is
    idle = [[*row, i] for i, row in enumerate(table)]
    symbol = F.when(F.col("event").isin(*REPORTS), F.lit(len(EVENTS))).otherwise(F.array_position(names, F.col("event")) - 1)
    steps = finite_scan(events.filter(F.col("event").isin(*EVENTS, *REPORTS)), key, order, symbol, idle, chunk=chunk)
    writes = F.array(*[F.array(*[F.lit(stage_written(states[b], states[table[b][e]], EVENTS[e])) for e in range(len(EVENTS))]) for b in range(len(states))])
    held = F.array(*[F.lit(s == "running" and f == 1) for s, f, _ in states])
    is_event = ~F.col("event").isin(*REPORTS)
    moved = is_event & (F.col("state_before") != F.col("state_after"))
    stage = F.when(is_event, F.get(F.get(writes, F.col("state_before")), (F.array_position(names, F.col("event")) - 1).cast("int"))).when(
        (F.col("event") == "stage") & ~F.get(held, F.col("state_before")), F.col("stage"))
    status = F.array(*[F.lit(s) for s, _, _ in states])
    was, now = F.get(status, F.col("state_before")), F.get(status, F.col("state_after"))
    starts = F.when(moved & (now == "running") & (was != "running"), F.struct(F.col("ts"))).when(moved & (now == "pending"), F.struct(F.lit(None).cast(events.schema["ts"].dataType).alias("ts")))
    ends = moved & now.isin("skipped", "done", "failed", "cancelled")
    rows = steps.withColumns({"_stage": stage, "_start": starts, "_end": F.when(ends, F.col("ts")),
                              "_bar": F.when(F.col("event") == "progress", F.struct("pct", "done", "total", "fps"))})
    # the last value that was written, by place: partial aggregates, one row a job
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in ("_stage", "_start", "_end", "_bar")}
    told = rows.groupBy(*key).agg(F.count_if(is_event).alias("n_events"), F.max_by("state_after", "place").alias("_state"), *last.values())
    parts = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(r).cast("long").alias("retries")) for s, _, r in states])
    at = F.get(parts, F.col("_state"))
    done = F.when(at["status"] == "done", F.lit(100.0))
    return told.select(*key, "n_events", at["status"].alias("status"), F.coalesce("_stage", F.lit("")).alias("stage"), at["retries"].alias("retries"),
                       F.col("_start.ts").alias("started_at"), F.col("_end").alias("finished_at"), F.coalesce(done, F.bround("_bar.pct", 1)).alias("progress"),
                       F.col("_bar.done").alias("progress_done"), F.col("_bar.total").alias("progress_total"), F.col("_bar.fps").alias("progress_fps"))


# --- progress ------------------------------------------------------------------

SILENCE_S = 90.0


def progress_track(lines: DataFrame, key: Sequence[str] = ("job_id",), width: float = 1 << 14) -> DataFrame:
    """Progress bars of each job's log (pos, text, optionally ts), with the stage
    they belong to and whether they are reported: only a higher percentage is,
    and the bar starts over with a new stage or when `done` falls."""
    from shotlake.functions.text import progress_stats

    text = F.col("text")
    marker = (F.when(text.contains("Scene detection"), "scenedetect").when(text.contains("scenecut"), "probing")
              .when(text.contains("Chunking") | text.contains("Queue"), "encoding"))
    rows = lines.withColumn("_mark", marker).withColumn("_bar", progress_stats(text))
    rows = ordered_scan(rows, key, ["pos"], width=width, before={"_was": ("last", "_mark")})
    # a bar with frames while probing means that encoding has begun
    live = F.when(F.col("_bar.fps") > 0, F.lit("encoding"))
    step = F.coalesce("_mark", F.when(F.col("_was") == "probing", live))
    rows = ordered_scan(settle(rows.withColumn("_step", step)), key, ["pos"], width=width, running={"stage": ("last", "_step")})
    rows = settle(rows.withColumn("_done", F.col("_bar.done")))
    rows = ordered_scan(rows, key, ["pos"], width=width, lag={"_stage": "stage"}, before={"_seen": ("last", "_done")})
    fresh = ~F.col("_stage").eqNullSafe(F.col("stage")) | F.coalesce(F.col("_done") < F.col("_seen"), F.lit(False))
    rows = ordered_scan(settle(rows.withColumn("_new", fresh.cast("long"))), key, ["pos"], width=width,
                        running={"_seg": ("sum", "_new")})
    rows = settle(rows.withColumn("_pct", F.col("_bar.pct")))
    rows = ordered_scan(rows, [*key, "_seg"], ["pos"], width=width, before={"_top": ("max", "_pct")})
    return rows.filter(F.col("_bar").isNotNull()).select(
        *key, "pos", "stage", F.col("_bar.pct").alias("pct"), F.col("_bar.done").alias("done"),
        F.col("_bar.total").alias("total"), F.col("_bar.fps").alias("fps"),
        (F.col("_pct") > F.coalesce("_top", F.lit(-1.0))).alias("reported"))


def silences(lines: DataFrame, key: Sequence[str] = ("job_id",), order: Sequence[str] = ("ts",), width: float = DAY,
             limit: float = SILENCE_S) -> DataFrame:
    """Gaps longer than `limit` seconds between a job's lines."""
    steps = ordered_scan(lines, key, order, width=width, lag={"_prev": order[0]})
    gap = F.col(order[0]).cast("double") - F.col("_prev").cast("double")
    return steps.withColumn("silence_s", gap).filter(gap > limit).drop("_prev")


def tail_incremental(lines: DataFrame, since: DataFrame, key: Sequence[str] = ("job_id",)) -> DataFrame:
    """Lines from each reader's position on (since: key, since), and how many had already left the buffer."""
    first = lines.groupBy(*key).agg(F.min("line_no").alias("_first"))
    start = since.join(first, [*key]).withColumn("_from", F.greatest("since", "_first")).withColumn(
        "lost", F.greatest(F.lit(0), F.col("_from") - F.col("since")))
    return lines.join(start.select(*key, "_from", "lost"), [*key]).filter(
        F.col("line_no") >= F.col("_from")).drop("_from")
