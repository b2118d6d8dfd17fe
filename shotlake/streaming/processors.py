"""Keyed state, one processor per operator. The rows of a key reach it in
micro-batches; within a batch they are taken in event order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotlake.operators.fits import APPROACH, DECAY, RATIO_CAP, RATIO_FLOOR, SAMPLE_CAP, correction_pieces
from shotlake.operators.jobs import COOLOFF_S, EVENTS, STALE_S, TEST_HUNG_S, job_automaton, stage_of, stage_written


def _clock(live: bool) -> str:
    """Timers only where the processing clock means something: a replay has none."""
    return "ProcessingTime" if live else "None"


def _rows(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True).sort_values(by, kind="stable") if frames else pd.DataFrame(columns=by)


class _Keyed(StatefulProcessor):
    """A single value of state per key."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def close(self) -> None:
        pass


# --- event order over batches ------------------------------------------------------

class InOrder(StatefulProcessor):
    """Hands rows to another processor in event order, however batches shuffled them.

    Rows wait in a list until the watermark has passed them, when no earlier row can come; an event-time timer on the
    earliest of them wakes the key. What is still waiting when a stream ends stays in the state. `order` names the event
    time in seconds and, for ties, further columns.
    """

    def __init__(self, inner: StatefulProcessor, schema: str, order: tuple[str, ...]):
        self.inner, self.schema, self.order = inner, schema, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inner.init(handle)
        self.waiting = handle.getListState("waiting", self.schema)
        self.names = [c.split()[0] for c in self.schema.split(", ")]
        # batches bring whole numbers beside missing ones as floats
        self.kinds = [{"long": int, "bigint": int, "int": int, "double": float}.get(c.split()[1], str) for c in self.schema.split(", ")]

    def close(self) -> None:
        self.inner.close()

    def _stored(self, rows: pd.DataFrame) -> list[tuple]:
        return [tuple(None if pd.isna(v) else kind(v) for kind, v in zip(self.kinds, r)) for r in rows.itertuples(index=False)]

    def _held(self) -> pd.DataFrame:
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        return pd.DataFrame(rows, columns=self.names)

    def _wake(self, rows: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            self.handle.registerTimer(int(rows[self.order[0]].min() * 1000) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        fresh = [b[self.names] for b in rows if len(b)]
        if fresh:
            new = pd.concat(fresh, ignore_index=True)
            self.waiting.appendList(self._stored(new))
            self._wake(self._held())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._held().sort_values(self.order, kind="stable")
        due = held[self.order[0]] * 1000 < timerValues.getCurrentWatermarkInMs()
        left = held[~due]
        if len(left):
            self.waiting.put(self._stored(left))
        else:
            self.waiting.clear()
        self._wake(left)
        if due.any():
            yield from self.inner.handleInputRows(key, iter([held[due]]), timerValues)


def in_order(rows: DataFrame, key: str, inner: StatefulProcessor, schema: str, out: str, lateness: str, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """`inner` over rows (key, *schema) whose event time `at` is in seconds; rows later than `lateness` are dropped."""
    timed = rows.withColumn("event_time", F.timestamp_seconds(F.col(order[0]))).withWatermark("event_time", lateness)
    # the watermark is on a column of the input; the output has none of its own
    return timed.groupBy(key).transformWithStateInPandas(InOrder(inner, schema, order), out, "Update", "EventTime")


# --- settled files ---------------------------------------------------------------

class SettledFiles(_Keyed):
    """Emits a path once, when two observations in a row agree and it is old enough."""

    schema = "size long, mtime double, sent boolean"

    def __init__(self, stable_s: float, min_bytes: int):
        self.stable_s, self.min_bytes = stable_s, min_bytes

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        size, mtime, sent = self.state.get() if self.state.exists() else (None, None, False)
        for r in _rows(rows, ["scan_at"]).itertuples(index=False):
            if sent or r.size_ < self.min_bytes:
                continue
            if (size, mtime) == (r.size_, r.mtime_at) and r.scan_at - r.mtime_at >= self.stable_s:
                sent = True
                yield pd.DataFrame({"path": [key[0]], "size": [r.size_], "accepted_at": [r.scan_at]})
            size, mtime = int(r.size_), float(r.mtime_at)
        if size is not None:
            self.state.update((size, mtime, sent))


def stream_new_files(observations: DataFrame, stable_s: float, min_bytes: int = 0, lateness: str = "1 hour") -> DataFrame:
    """Settled files from a stream of listing rows (path, size, mtime, scan_ts). The
    same observation delivered twice counts once."""
    seen = observations.withWatermark("scan_ts", lateness).dropDuplicatesWithinWatermark(["path", "scan_ts"])
    rows = seen.select("path", F.col("size").alias("size_"), F.col("mtime").cast("double").alias("mtime_at"),
                       F.col("scan_ts").cast("double").alias("scan_at"))
    return rows.groupBy("path").transformWithStateInPandas(
        SettledFiles(stable_s, min_bytes), "path string, size long, accepted_at double", "Append", "None")


# --- job state -------------------------------------------------------------------

class JobState(_Keyed):
    """The automaton of job_state, one step per event."""

    schema = "state int, events long"

    def __init__(self, max_retries: int):
        self.states, self.table = job_automaton(max_retries)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        state, n = self.state.get() if self.state.exists() else (0, 0)
        last = None
        for r in _rows(rows, ["at"]).itertuples(index=False):
            if r.event in EVENTS:
                state, n, last = self.table[state][EVENTS.index(r.event)], n + 1, r.at
        if last is not None:
            self.state.update((state, n))
            status, flag, retries = self.states[state]
            yield pd.DataFrame({"job_id": [key[0]], "n_events": [n], "status": [status], "flag": [flag],
                                "retries": [retries], "at": [last]})


def stream_job_state(events: DataFrame, max_retries: int = 2, lateness: str | None = None) -> DataFrame:
    """Each job's state after every batch that moved it; the newest row of a job is its state. With `lateness` events
    may come in any order over batches, late by that much at most, and are taken in the order of their time."""
    rows = events.select("job_id", "event", F.col("ts").cast("double").alias("at"))
    told = "job_id string, n_events long, status string, flag int, retries long, at double"
    if lateness:
        out = in_order(rows, "job_id", JobState(max_retries), "event string, at double", told, lateness)
    else:
        out = rows.groupBy("job_id").transformWithStateInPandas(JobState(max_retries), told, "Update", "None")
    return out.withColumn("stage", stage_of(F.col("status"), F.col("flag"))).drop("flag")


class JobRecord(_Keyed):
    """The row of a job, one event at a time; the batch twin is jobs.job_record."""

    schema = ("state int, events long, stage string, started double, finished double, pct double, done long, total long, fps double")

    def __init__(self, max_retries: int):
        self.states, self.table = job_automaton(max_retries)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        state, n, stage, started, finished, *bar = self.state.get() if self.state.exists() else (0, 0, "", None, None, None, None, None, None)
        seen = False
        for r in _rows(rows, ["at"]).itertuples(index=False):
            if r.event == "stage":
                status, flag, _ = self.states[state]
                stage = stage if status == "running" and flag or r.stage is None else r.stage
            elif r.event == "progress":
                bar = [None if pd.isna(v) else v for v in (r.pct, r.done, r.total, r.fps)]
            elif r.event in EVENTS:
                n, after = n + 1, self.table[state][EVENTS.index(r.event)]
                was, now = self.states[state], self.states[after]
                said = stage_written(was, now, r.event)
                stage = stage if said is None else said
                if now[0] == "running" != was[0]:
                    started = r.at
                elif now[0] == "pending" and now != was:
                    started = None
                if now != was and now[0] in ("skipped", "done", "failed", "cancelled"):
                    finished = r.at
                state = after
            else:
                continue
            seen = True
        if seen:
            pct, done, total, fps = bar
            done, total = (None if v is None else int(v) for v in (done, total))
            self.state.update((state, n, stage, started, finished, pct, done, total, fps))
            status, _, retries = self.states[state]
            # as an object frame, so that counts stay whole numbers beside missing ones
            yield pd.DataFrame([(key[0], n, status, stage, retries, started, finished, 100.0 if status == "done" else pct, done, total, fps)],
                               columns=RECORD_COLUMNS, dtype=object).astype({"n_events": int, "retries": int, "started_at": float, "finished_at": float, "progress": float,
                                                                             "progress_done": "Int64", "progress_total": "Int64", "progress_fps": float})


RECORD = ("job_id string, n_events long, status string, stage string, retries long, started_at double, finished_at double, progress double, "
          "progress_done long, progress_total long, progress_fps double")
RECORD_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def stream_job_record(events: DataFrame, max_retries: int = 2, lateness: str = "10 minutes") -> DataFrame:
    """Each job's row after every batch that moved it (the one of the most events counts), from events (job_id, ts, event,
    stage, pct, done, total, fps) that may be late by `lateness` and out of order."""
    fields = "event string, at double, stage string, pct double, done long, total long, fps double"
    rows = events.select("job_id", "event", F.col("ts").cast("double").alias("at"), "stage", F.col("pct").cast("double").alias("pct"),
                         F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), F.col("fps").cast("double").alias("fps"))
    return in_order(rows, "job_id", JobRecord(max_retries), fields, RECORD, lateness)


# --- device health ---------------------------------------------------------------

class DeviceHealth(_Keyed):
    """Error, wedge, test and heartbeat times of a device; a timer looks again when
    time alone can change the verdict."""

    schema = "error double, wedged double, passed double, failed boolean, since double, beat double, told string"

    def verdict(self, s: tuple, now: float) -> str:
        error, wedged, passed, failed, since, beat, _ = s
        # a pass counts from the start of its test
        good_from = -math.inf if passed is None else passed
        stale = beat is not None and now - beat > STALE_S
        hung = since is not None and now - since > TEST_HUNG_S
        stuck = wedged is not None and wedged >= good_from
        if stale or hung or stuck or failed:
            return "down"
        if error is not None and error >= min(good_from, math.nextafter(now - COOLOFF_S, math.inf)):
            return "degraded"
        return "starting" if passed is None else "ok"

    def emit(self, key: Any, s: tuple, now: float) -> Iterator[pd.DataFrame]:
        state = self.verdict(s, now)
        self.state.update((*s[:6], state))
        if state != s[6]:
            yield pd.DataFrame({"device": [key[0]], "at": [now], "state": [state]})
        # what changes by the clock: a stale heartbeat, a hung test, the end of the cool-off
        waits = [t + d for t, d in ((s[5], STALE_S), (s[4], TEST_HUNG_S), (s[0], COOLOFF_S)) if t is not None]
        due = [t for t in waits if t >= now]
        if due and self.live:
            self.handle.registerTimer(int(min(due) * 1000) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        s = self.state.get() if self.state.exists() else (None, None, None, False, None, None, None)
        error, wedged, passed, failed, since, beat, told = s
        last = None
        for r in _rows(rows, ["at"]).itertuples(index=False):
            last = r.at
            if r.kind in ("error", "wedged"):
                error, wedged = r.at, (r.at if r.kind == "wedged" else wedged)
            elif r.kind == "test_start":
                since = r.at
            elif r.kind == "test_ok":
                passed, failed, since = r.started, False, None
            elif r.kind == "test_fail":
                failed, since = True, None
            elif r.kind == "heartbeat":
                beat = r.at
        if last is not None:
            now = max(last, timers.getCurrentProcessingTimeInMs() / 1000) if self.live else last
            yield from self.emit(key, (error, wedged, passed, failed, since, beat, told), now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self.emit(key, self.state.get(), expiredTimerInfo.getExpiryTimeInMs() / 1000)

    def __init__(self, live: bool):
        self.live = live


def stream_device_health(events: DataFrame, live: bool = True, lateness: str | None = None) -> DataFrame:
    """Changes of each device's verdict. With `live` the processing clock is now;
    otherwise (a replay) the latest event is. With `lateness` a replay takes events
    of any order over batches in the order of their time."""
    rows = events.select("device", "kind", F.col("ts").alias("at"), "started")
    if lateness:
        return in_order(rows, "device", DeviceHealth(False), "kind string, at double, started double", "device string, at double, state string", lateness)
    return rows.groupBy("device").transformWithStateInPandas(
        DeviceHealth(live), "device string, at double, state string", "Update", _clock(live))


# --- progress --------------------------------------------------------------------

class Progress(_Keyed):
    """Stage, last reported percentage and last count of a job's progress bar."""

    schema = "stage string, pct double, done long, at double"

    def __init__(self, live: bool):
        self.live = live

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        stage, top, seen, _ = self.state.get() if self.state.exists() else (None, -1.0, None, None)
        out, at = [], None
        for r in _rows(rows, ["at"]).itertuples(index=False):
            at = r.at
            step = r.mark if isinstance(r.mark, str) else None
            has_bar = r.pct == r.pct and r.pct is not None
            if step is None and has_bar and stage == "probing" and r.fps > 0:
                step = "encoding"
            if step is not None and step != stage:
                stage, top, seen = step, -1.0, None
            if has_bar:
                if seen is not None and r.done < seen:
                    top = -1.0
                if r.pct > top:
                    top = float(r.pct)
                    out.append((key[0], r.at, stage, r.pct, int(r.done), int(r.total)))
                seen = int(r.done)
        self.state.update((stage, top, seen, at))
        if at is not None and self.live:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 90_000)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "at", "stage", "pct", "done", "total"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        stage, _, _, at = self.state.get()
        none = pd.array([None], dtype="Int64")
        yield pd.DataFrame({"job_id": [key[0]], "at": [at], "stage": ["silent"], "pct": [float("nan")], "done": none, "total": none})


def stream_progress(lines: DataFrame, live: bool = True, lateness: str | None = None) -> DataFrame:
    """Reported progress of each job (job_id, ts, text); a job silent for 90 s gets a row with stage "silent". With
    `lateness` (a replay) lines of any order over batches are taken in the order of their time."""
    from shotlake.functions.text import progress_stats

    text = F.col("text")
    mark = (F.when(text.contains("Scene detection"), "scenedetect").when(text.contains("scenecut"), "probing")
            .when(text.contains("Chunking") | text.contains("Queue"), "encoding"))
    rows = lines.select("job_id", F.col("ts").cast("double").alias("at"), mark.alias("mark"),
                        progress_stats(text).alias("_b")).select("job_id", "at", "mark", "_b.*")
    rows, told = rows.filter("mark IS NOT NULL OR pct IS NOT NULL"), "job_id string, at double, stage string, pct double, done long, total long"
    if lateness:
        fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "job_id")
        return in_order(rows, "job_id", Progress(False), fields, told, lateness)
    return rows.groupBy("job_id").transformWithStateInPandas(Progress(live), told, "Update", _clock(live))


# --- trackers --------------------------------------------------------------------

class Correction(_Keyed):
    """Memory correction factor: up at once, down by a quarter of the gap."""

    schema = "factor double, samples long"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        factor, n = self.state.get() if self.state.exists() else (1.0, 0)
        run = _rows(rows, ["seq"])
        run = run[(run["predicted"] > 0) & (run["observed"] > 0)]
        if len(run):
            # the whole batch is one move of the factor, as in the batch twin
            moves = correction_pieces(run["observed"] / run["predicted"])
            _, a, b = next(m for m in reversed(moves) if m[0] <= factor or m is moves[0])
            factor, n = a * factor + b, n + len(run)
        self.state.update((float(factor), n))
        yield pd.DataFrame({"job_id": [key[0]], "samples": [n], "factor": [float(factor)]})


class PeakRatio(_Keyed):
    """Ratio of memory held to booked, pulled by the worst recent sample."""

    schema = "worst double, ratio double, samples long"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        worst, ratio, n = self.state.get() if self.state.exists() else (0.0, 1.0, 0)
        for r in _rows(rows, ["seq"]).itertuples(index=False):
            if r.measured > 0 and r.booked > 0:
                worst = max(min(SAMPLE_CAP, r.measured / r.booked), worst * DECAY)
                ratio = min(RATIO_CAP, max(RATIO_FLOOR, ratio + (worst - ratio) / APPROACH))
                n += 1
        self.state.update((float(worst), float(ratio), n))
        yield pd.DataFrame({"job_id": [key[0]], "samples": [n], "worst": [float(worst)], "ratio": [float(ratio)]})


def stream_correction(obs: DataFrame, lateness: str | None = None) -> DataFrame:
    """Each job's factor after every batch. With `lateness`, `seq` is a time in seconds and readings may come in any order."""
    if lateness:
        rows = obs.select("job_id", F.col("seq").cast("double").alias("seq"), F.col("predicted").cast("double").alias("predicted"), F.col("observed").cast("double").alias("observed"))
        return in_order(rows, "job_id", Correction(), "seq double, predicted double, observed double", "job_id string, samples long, factor double", lateness, ("seq",))
    return obs.select("job_id", "seq", "predicted", "observed").groupBy("job_id").transformWithStateInPandas(
        Correction(), "job_id string, samples long, factor double", "Update", "None")


def stream_peak_ratio(obs: DataFrame) -> DataFrame:
    return obs.select("job_id", "seq", "measured", "booked").groupBy("job_id").transformWithStateInPandas(
        PeakRatio(), "job_id string, samples long, worst double, ratio double", "Update", "None")


# --- circuit breaker -------------------------------------------------------------

REARM_S = 300.0


class Breaker(_Keyed):
    """Retires a device after n failures in a row; one retry test after the cool-off
    decides whether it comes back (streak 0) or stays out for the job."""

    schema = "status string, streak int, retired_at double"

    def __init__(self, n: int, live: bool):
        self.n, self.live = n, live

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        status, streak, since = self.state.get() if self.state.exists() else ("in use", 0, None)
        out = []
        for r in _rows(rows, ["at"]).itertuples(index=False):
            was = status
            if status == "in use" and r.outcome in ("ok", "fail"):
                streak = 0 if r.outcome == "ok" else streak + 1
                if streak >= self.n:
                    status, since = "retired", r.at
            elif status in ("retired", "retry due") and r.outcome in ("test_ok", "test_fail") and r.at - since >= REARM_S:
                status, streak = ("in use", 0) if r.outcome == "test_ok" else ("out", streak)
            if status != was:
                out.append((key[0], key[1], r.at, status))
        self.state.update((status, streak, since))
        if status == "retired" and self.live:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(REARM_S * 1000))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "device", "at", "status"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, streak, since = self.state.get()
        if status == "retired":
            self.state.update(("retry due", streak, since))
            yield pd.DataFrame({"job_id": [key[0]], "device": [key[1]], "at": [since + REARM_S], "status": ["retry due"]})


def stream_circuit_breaker(outcomes: DataFrame, n: int = 3, live: bool = True) -> DataFrame:
    """Changes of each (job, device): retired, retry due, in use again, or out."""
    rows = outcomes.select("job_id", "device", F.col("ts").cast("double").alias("at"), "outcome")
    return rows.groupBy("job_id", "device").transformWithStateInPandas(
        Breaker(n, live), "job_id string, device string, at double, status string", "Update", _clock(live))
