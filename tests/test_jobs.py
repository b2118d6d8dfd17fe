import pytest
from pyspark.sql import functions as F

from shotlake.operators import grain, jobs, media
from shotlake.operators.visibility import part_b, MODEL
from shotlake.sources.media import parse_media
from shotlake.sources.subtitles import walk_segments


def test_job_rules(spark):
    def state(*events):
        df = spark.createDataFrame([("a", i, e) for i, e in enumerate(events)], "job_id string, seq long, event string")
        r = jobs.job_state(df, order=["seq"], width=64.0).first()
        return r.status, r.stage, r.retries

    assert state("create", "analyze", "run", "done") == ("done", "", 0)
    assert state("create", "analyze", "fail") == ("pending", "retry", 1)
    assert state(*["create"] + ["analyze", "run", "fail"] * 3) == ("failed", "", 2)
    assert state("create", "analyze", "run", "cancel") == ("running", "cancelling", 0)
    assert state("create", "analyze", "run", "cancel", "fail") == ("cancelled", "", 0)
    assert state("create", "analyze", "run", "done", "cancel") == ("done", "", 0)
    assert state("create", "analyze", "skip", "run") == ("skipped", "skipped", 0)
    assert state("create", "analyze", "restart") == ("pending", "", 0)


def test_device_rules(spark):
    def state(now, *events):
        df = spark.createDataFrame([("d", float(t), k, float(s)) for t, k, s in events], "device string, ts double, kind string, started double")
        return jobs.device_health(df, F.lit(float(now))).first().state

    assert state(10, (1, "test_start", 0)) == "starting"
    assert state(10, (1, "test_start", 0), (2, "test_ok", 1)) == "ok"
    ok = [(1, "test_start", 0), (2, "test_ok", 1)]
    assert state(110, *ok, (100, "error", 0)) == "degraded"
    # a test that started before the error does not clear it
    assert state(900, *ok, (100, "error", 0), (101, "test_ok", 99)) == "degraded"
    assert state(900, *ok, (100, "error", 0), (750, "test_ok", 720)) == "ok"
    assert state(900, *ok, (100, "wedged", 0)) == "down"
    assert state(900, *ok, (100, "wedged", 0), (750, "test_ok", 720)) == "ok"
    assert state(300, *ok, (50, "test_start", 0)) == "down"
    assert state(60, *ok, (50, "test_fail", 49)) == "down"
    assert state(60, *ok, (40, "heartbeat", 0)) == "down"


def test_kernel_lines(spark):
    pdev = "0000:c6:00.0"
    lines = {f"kernel: xe {pdev}: [drm] Tile0: GT0: reset started": "error", f"kernel: xe {pdev}: [drm] Timedout job: seqno=1": "error",
             f"kernel: xe {pdev}: [drm] Xe has declared device {pdev} as wedged.": "wedged",
             "kernel: rcu: INFO: rcu_preempt detected stalls on CPUs/tasks:": "error", f"kernel: xe {pdev}: [drm] Registered 4 planes": None,
             "kernel: nvidia 0000:81:00.0: Timedout job something": None}
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    assert {r.line: r.kind for r in jobs.classify_device_lines(df, pdev).collect()} == lines


def test_usage(spark):
    df = spark.createDataFrame([("h", 1, "a", "400 MiB"), ("h", 1, "a", "400 MiB"), ("h", 2, "a", "480 MiB"), ("h", 3, "b", "99 MiB")],
                               "host string, client int, device string, size string")
    assert jobs.dedup_usage(df, "a").first().used_mb == 880


def test_listing(spark):
    rows = [("/grow", 5, 0, 100), ("/grow", 9, 100, 200), ("/still", 9, 0, 100), ("/still", 9, 0, 200), ("/small", 1, 0, 100), ("/small", 1, 0, 200),
            ("/fresh", 9, 190, 195), ("/fresh", 9, 190, 200)]
    df = spark.createDataFrame(rows, "path string, size long, m long, s long").select(
        "path", "size", F.timestamp_seconds("m").alias("mtime"), F.timestamp_seconds("s").alias("scan_ts"))
    assert [r.path for r in jobs.settled_files(df, 30, 2).collect()] == ["/still"]
    js = spark.createDataFrame([(str(i), f"/f{i % 50}", "done" if i % 50 == 3 else "pending", float(i)) for i in range(150)], "id string, source string, status string, created_at double")
    listing = spark.createDataFrame([("/f0",), ("/f3",), ("/f",), ("/new",)], "path string")
    assert [(r.path, r.job_id) for r in jobs.active_jobs(listing, js).collect()] == [("/f0", "0")]
    assert sorted(r.path for r in jobs.new_files(listing, js).collect()) == ["/f", "/new"]


def test_sidecars(spark):
    videos = spark.createDataFrame([("/m", "SRC.mkv"), ("/m", "SRC.part2.mkv")], "dir string, name string")
    names = [("/m", "SRC.en.srt"), ("/m/subs", "src.zh.srt"), ("/m", "SRC.part2.en.srt"), ("/m", "SRCX.zh.srt"), ("/m", "SRC-thumb.jpg"), ("/m", "SRC.nfo")]
    got = {(r.dir, r.name): r.video for r in jobs.pair_sidecars(videos, spark.createDataFrame(names, "dir string, name string")).collect()}
    assert got == {("/m", "SRC.en.srt"): "SRC.mkv", ("/m/subs", "src.zh.srt"): "SRC.mkv", ("/m", "SRC.part2.en.srt"): "SRC.part2.mkv"}


def test_colour_and_signal(spark):
    def stream(transfer, profile=None, compat=0):
        side = f',"side_data_list":[{{"side_data_type":"DOVI configuration record","dv_profile":{profile},"dv_bl_signal_compatibility_id":{compat}}}]' if profile else ""
        t = f',"color_transfer":"{transfer}"' if transfer else ""
        return f'{{"format":{{}},"streams":[{{"codec_type":"video","codec_name":"hevc"{t}{side}}}]}}'

    cases = [("smpte2084", None, 0, "bt2020", "smpte2084"), ("arib-std-b67", None, 0, "bt2020", "arib-std-b67"), ("bt709", None, 0, "bt709", "bt709"),
             ("", 5, 0, "bt2020", "smpte2084"), ("arib-std-b67", 8, 4, "bt2020", "arib-std-b67"), ("bt709", 8, 2, "bt709", "bt709"), ("", 8, 1, "bt2020", "smpte2084"),
             ("smpte2084", 7, 6, "bt2020", "smpte2084"), ("", 8, 0, "bt2020", "smpte2084")]
    docs = spark.createDataFrame([(str(i), stream(t, p, c)) for i, (t, p, c, *_) in enumerate(cases)], "path string, body string")
    tags = media.colour_tags()
    got = {r.path: (r.p, r.t) for r in parse_media(docs).select("path", tags["primaries"].alias("p"), tags["transfer"].alias("t")).collect()}
    assert got == {str(i): (p, t) for i, (*_, p, t) in enumerate(cases)}


def test_segments():
    ok = b"PG" + (90000).to_bytes(4, "big") + bytes(4) + bytes([0x80]) + (0).to_bytes(2, "big")
    assert walk_segments(ok * 2)[0] == [(0, 90000, 0x80, b""), (13, 90000, 0x80, b"")]
    assert walk_segments(ok + b"XX" + bytes(11))[1].startswith("lost sync")
    assert walk_segments(ok[:-1])[1].startswith("short header") and walk_segments(ok[:-2] + b"\x00\x05")[1].startswith("truncated")


def test_otsu_and_fill(spark):
    hist = spark.createDataFrame([("a", 10, 5), ("a", 200, 5), ("b", 3, 1)], "k string, level long, cnt long")
    assert {r.k: r.threshold for r in grain.otsu_threshold(hist, ["k"]).collect()} == {"a": 10, "b": 3}
    bins = spark.createDataFrame([("t", 0, 32, "y", 2.0), ("t", 0, 96, "y", 5.0)], "source_id string, shot_idx int, bin_lo int, channel string, value double")
    dense = grain.cross_bin_grid(bins).filter("channel = 'y'")
    fill = lambda **k: [r.filled for r in grain.fill_nearest(dense, ["source_id", "shot_idx"], **k).orderBy("bin_lo").collect()]
    assert fill() == [2, 2, 2, 2, 2, 5, 5, 5, 5, 5, 5] and fill(below_brightest=True) == [2, 2, 2, 2, 2, 5, 5, 0, 0, 0, 0]


def test_part_b():
    b = part_b(MODEL)
    assert (b["logk"], b["q"], b["beta"]) == (-6.0, 8.0, 2.0)


def test_streak_retirement(spark):
    outcomes = ["fail", "fail", "neutral", "fail", "ok", "fail"]
    df = spark.createDataFrame([("j", "d", i, o) for i, o in enumerate(outcomes)], "job_id string, device string, seq long, outcome string")
    s = jobs.failure_streaks(df, 3, width=2.0)
    assert [(r.seq, r.streak, r.retired) for r in s.orderBy("seq").collect()] == [(0, 1, False), (1, 2, False), (3, 3, True), (4, 0, True), (5, 1, True)]
    r = jobs.retired_devices(s, 3).first()
    assert (r.failures, r.longest, r.retired_at) == (4, 3, 3)


def test_heaviest_step_query_is_its_sql(spark, tmp_path):
    """Part keys so large that they outweigh a cent of price."""
    import duckdb
    from shotlake import catalog

    catalog.load()
    rows = [(1, 30.0, 10.02, 7), (1, 30.0, 10.01, 5000), (1, 30.0, 9.0, 9000), (1, 5.0, 3.0, 1), (2, 5.0, 4.0, 70000), (2, 5.0, 4.5, 30000)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.QUERIES["heaviest_step"](spark, str(tmp_path)).select("job_id", "phase", "peak_gb", "command").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(con.execute(catalog.ORACLES["heaviest_step"]).fetchall())
