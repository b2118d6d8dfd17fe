"""Streams over many batches with shuffled rows end where their batch twins do; files that grow, move and shrink."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from shotlake.operators import fits, jobs
from shotlake.session import ROCKSDB
from shotlake.sources.tail import follow_log
from shotlake.streaming import processors as op
from shotlake.streaming.refit import stream_refit

FAR = 10.0**7


def batches(rows, n, late, seed=1):
    """Rows (time first) in n batches: each is late by up to `late` seconds, and a far row ends the stream."""
    rng = random.Random(seed)
    by_arrival = sorted(rows, key=lambda r: r[0] + rng.uniform(0, late))
    size = -(-len(by_arrival) // n)
    return [by_arrival[i:i + size] for i in range(0, len(by_arrival), size)]


def run_stream(spark, tmp_path, parts, schema, build):
    """Every part is a file and a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "append" if build.__code__.co_names[:1] == ("stream_refit",) else "update"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if not f.name.startswith("part-9"):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
                f.rename(tmp_path / "in" / f"part-9{i:03}.parquet")
    counted = []

    def keep(batch, batch_id):
        counted.append(batch_id)
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch_id}"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = build(stream)
    (out.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep)
     .start().awaitTermination())
    assert len(counted) >= len(parts)
    return spark.read.schema(out.schema.add("batch", "long")).parquet(str(tmp_path / "out"))


EVENT = "ts double, job_id string, event string, stage string, pct double, done long, total long, fps double"


def job_events(n=600, seed=3):
    rng = random.Random(seed)
    names = ["create", "analyze", "run", "done", "fail", "cancel", "restart", "skip", "stage", "stage", "progress", "progress"]
    rows = []
    for i in range(n):
        e = "create" if i < 12 else rng.choice(names)
        bar = (rng.uniform(0, 99), rng.randrange(50), 100, rng.choice((None, 12.5))) if e == "progress" else (None,) * 4
        rows.append((float(i + 1), f"j{i % 12 if i < 12 else rng.randrange(12)}", e, rng.choice(("probing", "scenedetect", "encoding")) if e == "stage" else None, *bar))
    return rows


def plain_record(rows, max_retries=2):
    """One job's events in order, by the rules as they are written down."""
    j = {"n_events": 0, "status": "none", "stage": "", "retries": 0, "started_at": None, "finished_at": None, "progress": None, "progress_done": None,
         "progress_total": None, "progress_fps": None}
    for ts, _, e, stage, pct, done, total, fps in rows:
        live = j["status"] in ("analyzing", "running")
        if e == "progress":
            j |= {"progress": round(pct, 1), "progress_done": done, "progress_total": total, "progress_fps": fps}
            continue
        if e == "stage":
            if j["stage"] != "cancelling":
                j["stage"] = stage
            continue
        j["n_events"] += 1
        stop = lambda s: j.update(status=s, stage=s, finished_at=ts)
        if e == "create" and j["status"] == "none":
            j["status"] = "pending"
        elif e == "analyze" and j["status"] == "pending":
            j.update(status="analyzing", stage="analyzing")
        elif e == "run" and j["status"] == "analyzing":
            j.update(status="running", stage="encoding", started_at=ts)
        elif e == "skip" and j["status"] == "analyzing":
            stop("skipped")
        elif e == "done" and j["status"] == "running":
            stop("cancelled" if j["stage"] == "cancelling" else "done")
        elif e == "fail" and live:
            if j["stage"] == "cancelling":
                stop("cancelled")
            elif j["retries"] < max_retries:
                j.update(status="pending", stage="retry", retries=j["retries"] + 1, started_at=None)
            else:
                stop("failed")
        elif e == "cancel" and j["status"] in ("pending", "analyzing"):
            stop("cancelled")
        elif e == "cancel" and j["status"] == "running":
            j["stage"] = "cancelling"
        elif e == "restart" and live:
            j.update(status="pending", stage="", started_at=None)
    if j["status"] == "done":
        j["progress"] = 100.0
    return j


def want_records(rows):
    return {k: plain_record(sorted(r for r in rows if r[1] == k)) for k in {r[1] for r in rows}}


@pytest.mark.parametrize("chunk", [16, 2048])
def test_job_record(spark, chunk):
    rows = job_events()
    got = {r.job_id: r.asDict() for r in jobs.job_record(spark.createDataFrame(rows, EVENT).repartition(5), chunk=chunk).collect()}
    assert {k: {c: v for c, v in r.items() if c != "job_id"} for k, r in got.items()} == want_records(rows)


def test_job_record_stream(spark, tmp_path):
    rows = job_events(400, 8)
    parts = batches(rows, 6, 60) + [[(FAR, "end", "create", None, None, None, None, None)]]
    out = run_stream(spark, tmp_path, parts, EVENT, lambda s: op.stream_job_record(s, lateness="90 seconds"))
    # a report moves a row without an event: the newest batch counts
    last = out.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("job_id", "batch")]), "batch").alias("s")).select("job_id", "s.*")
    got = {r.job_id: {c: v for c, v in r.asDict().items() if c != "job_id"} for r in last.collect()}
    want = want_records(rows)
    for r in (*got.values(), *want.values()):
        r["progress"] = None if r["progress"] is None else round(r["progress"], 1)
    assert set(got) == set(want)
    assert {k: {c: (got[k][c], v) for c, v in w.items() if got[k][c] != v} for k, w in want.items() if got[k] != w} == {}


def test_job_state_stream_late_rows(spark, tmp_path):
    rows = [r[:3] for r in job_events(300, 5) if r[2] not in ("stage", "progress")]
    schema = "ts double, job_id string, event string"
    want = {r.job_id: (r.n_events, r.status, r.stage, r.retries) for r in jobs.job_state(spark.createDataFrame(rows, schema)).collect()}
    out = run_stream(spark, tmp_path, batches(rows, 5, 50) + [[(FAR, "end", "create")]], schema, lambda s: op.stream_job_state(s, lateness="60 seconds"))
    last = {}
    for r in out.collect():
        if r.n_events >= last.get(r.job_id, (0,))[0]:
            last[r.job_id] = (r.n_events, r.status, r.stage, r.retries)
    assert last == want


def test_correction_stream_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(float(i), f"j{rng.randrange(4)}", 10.0, rng.choice((0.0, 5.0, 12.0, 40.0))) for i in range(300)]
    schema = "seq double, job_id string, predicted double, observed double"
    want = {r.job_id: (r.samples, pytest.approx(r.factor, rel=1e-9)) for r in fits.correction_factor(spark.createDataFrame(rows, schema), chunk=16).collect()}
    out = run_stream(spark, tmp_path, batches(rows, 5, 40) + [[(FAR, "end", 1.0, 1.0)]], schema, lambda s: op.stream_correction(s, lateness="50 seconds"))
    last = {}
    for r in out.filter("job_id <> 'end'").collect():
        if r.samples >= last.get(r.job_id, (0,))[0]:
            last[r.job_id] = (r.samples, r.factor)
    assert last == want


def test_device_stream_late_rows(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["error", "wedged", "test_start", "test_ok", "test_fail", "heartbeat", "test_ok"]
    rows = [(float(i * 7), f"g{rng.randrange(5)}", rng.choice(kinds), float(i * 7 - rng.randrange(40))) for i in range(240)]
    schema = "ts double, device string, kind string, started double"
    out = run_stream(spark, tmp_path, batches(rows, 5, 200) + [[(FAR, "end", "heartbeat", 0.0)]], schema,
                     lambda s: op.stream_device_health(s, lateness="220 seconds"))
    told = {}
    for r in sorted(out.filter("device <> 'end'").collect(), key=lambda r: r.at):
        told[r.device] = r.state
    for device in told:
        mine = [r for r in rows if r[1] == device]
        now = jobs.device_health(spark.createDataFrame(mine, schema), mine[-1][0], key=["device"]).first()
        assert told[device] == now.state


def test_breaker_looks_again_by_timer(spark, tmp_path, monkeypatch):
    """Three failures retire a device; the clock alone makes its retry due, and a passed test brings it back."""
    monkeypatch.setattr(op, "REARM_S", 1.0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema, told = "job_id string, device string, ts timestamp, outcome string", []

    def feed(name, rows):
        spark.createDataFrame(rows, "job_id string, device string, at long, outcome string").selectExpr(
            "job_id", "device", "timestamp_seconds(at) AS ts", "outcome").coalesce(1).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{name}.parquet")

    (tmp_path / "in").mkdir()
    feed("a", [("j", "g", i, "fail") for i in range(3)])
    out = op.stream_circuit_breaker(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3, live=True)
    query = (out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second")
             .foreachBatch(lambda batch, _: told.extend(r.status for r in batch.collect())).start())
    try:
        for _ in range(90):
            if "retry due" in told or query.exception():
                break
            time.sleep(1)
        assert told == ["retired", "retry due"]
        feed("b", [("j", "g", 100, "test_ok")])
        for _ in range(60):
            if "in use" in told:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert told == ["retired", "retry due", "in use"]


def test_progress_stream_late_rows(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Scene detection", "scenecut: found 4 scene(s)", "Queue 5 Workers 2"]
    rows = []
    for i in range(1, 260):
        n = rng.randrange(100)
        bar = f"00:01 [1/5 Chunks] ▐ {n}% {n * 3}/300 ({rng.choice(('12.5', '0.0'))} fps, eta 5s)"
        rows.append((float(i), f"j{rng.randrange(4)}", rng.choice(texts) if rng.random() < 0.2 else bar))
    schema = "ts double, job_id string, text string"
    batch = jobs.progress_track(spark.createDataFrame(rows, schema).withColumn("pos", F.col("ts").cast("long")))
    want = sorted((r.job_id, float(r.pos), r.stage, r.pct, r.done) for r in batch.collect() if r.reported)
    out = run_stream(spark, tmp_path, batches(rows, 5, 40) + [[(FAR, "end", "Scene detection")]], schema, lambda s: op.stream_progress(s, lateness="50 seconds"))
    assert sorted((r.job_id, r.at, r.stage, r.pct, r.done) for r in out.collect() if r.job_id != "end") == want and len(want) > 40


def test_refit_stream(spark, tmp_path):
    """Six batches: ten new pairs while no fit is usable, twenty-five once one is; a ring of 200; the fit of the batch twin."""
    rng = random.Random(6)
    rows = []
    for i in range(260):
        q, l = rng.uniform(1, 50), rng.uniform(5, 9)
        rows.append(("good", i, q, l, 2 * q - l + rng.gauss(0, 0.1) + (90 if i % 40 == 7 else 0)))
        rows.append(("wild", i, q, l, rng.uniform(0, 100)))
    rows += [("few", i, float(i), 1.0, 2.0) for i in range(11)] + [("flat", i, 3.0, 1.0, float(i % 2)) for i in range(30)] + [("gap", i, None, 1.0, 2.0) for i in range(40)]
    schema = "job_id string, seq long, q double, log_bpf double, x_star double"
    rows.sort(key=lambda r: r[1])
    parts = [rows[i:i + 100] for i in range(0, len(rows), 100)]
    out = run_stream(spark, tmp_path, parts, schema, lambda s: stream_refit(s, 3.0))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.pairs):
        got.setdefault(r.job_id, []).append(r)
    assert set(got) == {"good", "wild", "flat"}
    for job, fits_ in got.items():
        at, sd = 0, None
        for r in fits_:
            # 12 pairs at least, then by whether the fit before could be followed
            wait = 25 if sd is not None and sd <= 3.0 else 10
            assert r.pairs == max(12, at + wait)
            at, sd = r.pairs, r.sd
        upto = spark.createDataFrame([r for r in rows if r[0] == job and r[1] < at], schema)
        twin = fits.ols_trimmed(upto).first()
        assert (fits_[-1].n, fits_[-1].b0, fits_[-1].bq, fits_[-1].bl, fits_[-1].sd) == pytest.approx((twin.n, twin.b0, twin.bq, twin.bl, twin.sd), rel=1e-6, abs=1e-6)
    assert len(got["wild"]) == 25 and got["good"][-1].n < 200


def follow(spark, tmp_path, **options):
    (follow_log(spark, str(tmp_path / "k.log"), **options).writeStream.format("parquet").option("path", str(tmp_path / "o"))
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(str(tmp_path / "o")).collect() if any((tmp_path / "o").glob("*.parquet")) else []
    return sorted(r.line for r in rows)


@pytest.mark.parametrize("block", ["8388608", "7"])
def test_follow_log(spark, tmp_path, block):
    log = tmp_path / "k.log"
    log.write_text("a old\nb old\n")
    options = {"block": block}
    assert follow(spark, tmp_path, **options) == []
    # appended, with an unfinished line
    with open(log, "a") as f:
        f.write("c one\nd tw")
    assert follow(spark, tmp_path, **options) == ["c one"]
    # finished, then moved away with one line more, and begun anew
    with open(log, "a") as f:
        f.write("o\ne last\n")
    log.rename(tmp_path / "k.log.1")
    log.write_text("f new\n")
    assert follow(spark, tmp_path, **options) == ["c one", "d two", "e last", "f new"]
    # shrunk in place, with a copy of what was there
    (tmp_path / "k.log.2").write_text("f new\n")
    log.write_text("")
    assert follow(spark, tmp_path, **options) == ["c one", "d two", "e last", "f new"]
    with open(log, "ab") as f:
        f.write("g \xe9 and ä ".encode("latin-1") + b"\n\nh\n")
    got = follow(spark, tmp_path, **options)
    assert got[:1] == [""] and got[-2:] == ["g � and � ", "h"] and len(got) == 7
    log.unlink()
    assert len(follow(spark, tmp_path, **options)) == 7


def test_follow_log_from_its_start(spark, tmp_path):
    (tmp_path / "k.log").write_text("a\nb\nc")
    (tmp_path / "k.log.1").write_text("z\n")
    assert follow(spark, tmp_path, start="start") == ["a", "b", "z"]
