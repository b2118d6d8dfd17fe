"""Readers and writers over real files."""

import json

import pytest
from pyspark.sql import functions as F

from shotlake.operators.subtitles import cue_intervals, recognise
from shotlake.sources import grain_tables, logs, media, subtitles


def test_frame_log(spark, tmp_path):
    lines = []
    for n in range(500):
        lines += [f"frame:{n}    pts:{n * 40} pts_time:{n / 25}", f"lavfi.scd.mafd={n % 7}.5", f"lavfi.scd.score={n % 5}.25"]
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("noise\n" + "\n".join(lines) + "\n")
    got = logs.read_frame_log(spark, str(tmp_path)).orderBy("source_id", "frame_no").collect()
    assert len(got) == 1000
    assert [(r.frame_no, r.pts, r.scd_score, r.mafd) for r in got[500:503]] == [(0, 0.0, 0.25, 0.5), (1, 0.04, 1.25, 1.5), (2, 0.08, 2.25, 2.5)]


def test_frame_log_casts_no_empty_text(spark):
    """Values that a line doesn't have are not cast (a failing cast raises and is caught, line by line); odd ones are NULL."""
    text = ["lavfi.scd.score=9", "frame:1 pts:1 pts_time:1.2.3", "lavfi.scd.score=1.2.3", "", "lavfi.scd.mafd=.5", "frame:99999999999999999999",
            "lavfi.scd.mafd=8.5", "frame:2", "lavfi.scd.score=.", "lavfi.scd.score=4."]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate([*text, None])], "file string, line long, text string")
    told = logs.parse_frame_log(lines, order=["line"], width=4.0)
    assert sorted(map(tuple, told.collect())) == [("a", 1, None, None, 8.5), ("a", 2, None, 4.0, None)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("null else try_cast") == plan.count("else try_cast") >= 3


def test_blocks_keep_line_order(spark, tmp_path):
    (tmp_path / "t.log").write_text("".join(f"frame:{n}\nlavfi.scd.score={n}.0\n" for n in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = logs.read_frame_log(spark, str(tmp_path))
        assert rows.filter("frame_no <> scd_score").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_metric_and_progress_logs(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{\n "pooled_metrics": {"vmaf": {"mean": 82.5}}\n}')
    (tmp_path / "m" / "b.json").write_text('{"pooled')
    got = {r.path[-6:]: (r.score, r.error) for r in logs.read_metric_logs(spark, str(tmp_path / "m"), "vmaf").collect()}
    assert got == {"a.json": (82.5, None), "b.json": (None, "unreadable")}
    (tmp_path / "p.log").write_bytes(b"x\r\x1b[1m00:01 [1/5 Chunks]  10% 120/1200 (9.5 fps, eta)\r 60% 724/1200 (97.15 fps, eta 5s)\nQueue 5\n")
    r = logs.read_progress_log(spark, str(tmp_path / "p.log")).collect()
    assert [(x.pct, x.done, x.total, x.fps) for x in r] == [(60.0, 724, 1200, 97.15)]


def test_media_and_library(spark, tmp_path):
    doc = {"format": {"format_name": "matroska,webm", "duration": "60.5", "bit_rate": "1000", "start_time": "N/A"},
           "streams": [{"index": 0, "codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "pix_fmt": "yuv420p10le",
                        "color_transfer": "smpte2084", "avg_frame_rate": "0/0", "r_frame_rate": "24000/1001",
                        "side_data_list": [{"side_data_type": "Content light level metadata", "max_content": 1000, "max_average": 400},
                                           {"side_data_type": "DOVI configuration record", "dv_profile": 8, "rpu_present_flag": 1, "dv_bl_signal_compatibility_id": 1}]},
                       {"codec_type": "audio"}, {"codec_type": "subtitle"}]}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "j" / "bad.json").write_text("nope")
    (r,) = media.read_media_catalog(spark, str(tmp_path / "j")).collect()
    assert (r.fps, r.is_hdr, r.color.bit_depth, r.color.max_cll, r.dovi.profile, r.dovi.rpu_present, r.audio_count) == (23.976024, True, 10, "1000,400", 8, True, 1)
    for p in ("in/a.MKV", "in/av1/b.mkv", "in/av1.mkv", "in/x/work/c.mkv", "in/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = media.scan_library(spark, str(tmp_path / "in"), ["mkv"]).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.MKV", "av1.mkv"]


def test_tags(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        '<?xml version="1.0"?>\n<!DOCTYPE Tags SYSTEM "matroskatags.dtd">\n<Tags><Tag><Targets><TrackUID>1</TrackUID></Targets><Simple><Name>A</Name><String>x</String></Simple></Tag>'
        '<Tag><Targets/><Simple><Name>B</Name><String>y</String></Simple><Simple><Name>C</Name><String>z</String></Simple></Tag></Tags>')
    got = sorted((r.tag_no, r.target, r.name, r.value) for r in media.read_tags(spark, str(tmp_path / "t.xml")).collect())
    assert got == [(0, "track", "A", "x"), (1, "global", "B", "y"), (1, "global", "C", "z")]


def test_grain_table_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("s", i, c, x, x % 9) for i in range(3) for c in ("y", "cb", "cr") for x in (0, 8, 255)],
                                   "source_id string, shot_idx long, channel string, x int, y int")
    bounds = spark.createDataFrame([("s", i, i * 100, i * 100 + 100) for i in range(3)], "source_id string, shot_idx long, f0 long, f1 long")
    arr = lambda n: F.array(*[F.lit(1)] * n)
    shape = F.struct(arr(12).alias("p"), arr(24).alias("cY"), arr(25).alias("cCb"), arr(25).alias("cCr"))
    out = str(tmp_path / "g")
    grain_tables.write_grain_table(grain_tables.grain_segments(points, bounds, shape, 25.0), out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "g" / "source_id=s").glob("part-*")))
    assert text.startswith("filmgrn1\nE 0 40000000 1 ") and text.count("\nE ") == 3
    segs = grain_tables.read_grain_tables(spark, out + "/source_id=s").filter("key = 'sY'").orderBy("seg_id").collect()
    assert [(s.seg_id, s.t0, list(s.vals)) for s in segs] == [(i, i * 40000000, [3, 0, 0, 8, 8, 255, 3]) for i in range(3)]


def test_subtitle_files(spark, tmp_path):
    def seg(kind, pts, payload=b""):
        return b"PG" + pts.to_bytes(4, "big") + bytes(4) + bytes([kind]) + len(payload).to_bytes(2, "big") + payload

    comp = lambda n: bytes(10) + bytes([n])
    (tmp_path / "a.sup").write_bytes(seg(0x16, 90000, comp(1)) + seg(0x80, 90000) + seg(0x16, 180000, comp(0)) + seg(0x80, 180000))
    (tmp_path / "b.sup").write_bytes(b"junkjunkjunkjunk")
    segs = subtitles.read_sup(spark, str(tmp_path))
    assert [r.error for r in segs.filter("error IS NOT NULL").collect()] == ["lost sync at 0"]
    cues = cue_intervals(subtitles.display_sets(segs))
    assert [(r.start, r.end) for r in cues.collect()] == [(1.0, 2.0)]

    @F.pandas_udf("text string, rung string")
    def reader(images):
        import pandas as pd
        return pd.DataFrame({"text": ["hi"] * len(images), "rung": ["primary"] * len(images)})

    told = recognise(cues.withColumn("image", F.lit(b"x")), reader).select(F.lit("t").alias("track_id"), "cue_idx", "start", "end", "text", "rung")
    subtitles.write_srt(told, str(tmp_path / "srt"))
    (part,) = [p for p in (tmp_path / "srt" / "track_id=t").glob("part-*")]
    assert part.read_text() == "1\n00:00:01,000 --> 00:00:02,000\nhi\n\n"


def test_probe_dataset_and_events(spark, tmp_path):
    rows = spark.createDataFrame([("shot", "j", 0, {"20": 90.0, "32": None}), ("job", "j", None, None)], "type string, job string, idx int, svt map<string,double>")
    logs.write_probe_dataset(rows, str(tmp_path / "d"))
    logs.write_probe_dataset(rows, str(tmp_path / "d"))
    log = logs.read_probe_dataset(spark, str(tmp_path / "d"))
    assert log.filter("type = 'job'").count() == 2
    assert sorted((r.x, r.score) for r in logs.dataset_probes(log).dropDuplicates().collect() if r.score) == [(20, 90.0)]
    ev = spark.createDataFrame([("j", "create", "2024-01-01 10:00:00")], "job_id string, event string, t string").select("job_id", F.col("t").cast("timestamp").alias("ts"), "event")
    logs.write_job_events(ev, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).filter("day = '2024-01-01'").count() == 1


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "k.log").write_text("a\nb\n")
    q = (logs.tail_log(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_title_files(spark, tmp_path):
    """One whole file a title; a failing job leaves none, a second run replaces what it writes."""
    from shotlake.sources.title_files import TitleFiles, write_titles

    rows = [(f"t{i % 7}", i, f"line {i}\n") for i in range(200)] + [("a/b ü", 1, "x\n"), ("a/b ü", 0, "w\n"), (None, 0, "n\n"), ("empty", 0, None)]
    df = spark.createDataFrame(rows, "title string, n int, text string").repartition(6)
    out = tmp_path / "out"
    write_titles(df, str(out), F.col("title"), ["n"], F.col("text"), ".txt")
    assert sorted(f.name for f in out.iterdir()) == sorted([*(f"t{i}.txt" for i in range(7)), "a%2Fb %C3%BC.txt", "_null.txt", "empty.txt"])
    for i in range(7):
        assert (out / f"t{i}.txt").read_text() == "".join(f"line {k}\n" for k in range(i, 200, 7))
    assert (out / "a%2Fb %C3%BC.txt").read_text() == "w\nx\n" and (out / "empty.txt").read_text() == ""
    # a task that fails writes nothing in place
    bad = df.withColumn("text", F.when(F.col("title") == "t3", F.raise_error(F.lit("lost"))).otherwise(F.lit("new\n")))
    with pytest.raises(Exception, match="lost"):
        write_titles(bad, str(out), F.col("title"), ["n"], F.col("text"), ".txt")
    assert (out / "t1.txt").read_text().startswith("line 1\n") and not (out / "_attempts").exists()
    # one title in two tasks is refused, and rows of a title must lie together
    spark.dataSource.register(TitleFiles)
    twice = spark.createDataFrame([("z", "1"), ("z", "2")], "name string, text string").repartition(2)
    with pytest.raises(Exception, match="two tasks"):
        twice.write.format("title_files").option("path", str(out)).mode("append").save()
    assert not (out / "z").exists()
    write_titles(df.filter("title = 't1'"), str(out), F.col("title"), ["n"], F.lit("o\n"), ".txt", "overwrite")
    assert [f.name for f in out.iterdir()] == ["t1.txt"] and set((out / "t1.txt").read_text().split()) == {"o"}


def test_srt_and_grain_files(spark, tmp_path):
    from shotlake.sources import grain_tables

    cues = spark.createDataFrame([("t", 0, 1.0, 2.0, "hi"), ("t", 1, 2.0, 3.0, ""), ("t", 2, 3.0, 4.5, "you")], "track_id string, cue_idx long, start double, end double, text string")
    subtitles.write_srt_files(cues, str(tmp_path / "srt"))
    assert (tmp_path / "srt" / "t.srt").read_text() == "1\n00:00:01,000 --> 00:00:02,000\nhi\n\n2\n00:00:03,000 --> 00:00:04,500\nyou\n\n"
    segments = spark.createDataFrame([("f", 5, "E 5 9 1 1 1\n\tsY 1 0 2"), ("f", 0, "E 0 5 1 1 1\n\tsY 1 0 1")], "source_id string, f0 long, record string")
    grain_tables.write_grain_files(segments, str(tmp_path / "g"))
    assert (tmp_path / "g" / "f.tbl").read_text() == "filmgrn1\nE 0 5 1 1 1\n\tsY 1 0 1\nE 5 9 1 1 1\n\tsY 1 0 2\n"
    back = grain_tables.read_grain_tables(spark, str(tmp_path / "g")).orderBy("t0").collect()
    assert [(r.t0, r.key, r.vals) for r in back] == [(0, "sY", [1, 0, 1]), (5, "sY", [1, 0, 2])]


def test_all_record_types(spark, tmp_path):
    """Job, shot and closing records written as lines and read back, costs and seeds with them."""
    shots = spark.createDataFrame([("j", 0, 0, 50, 0, 50), ("j", 1, 50, 80, 55, 75)], "job_id string, shot_idx int, s0 long, s1 long, w0 long, w1 long")
    probes = spark.createDataFrame([("j", 0, 20, "svt", 90.0, None), ("j", 0, 20, "qsv", 88.0, 11.5), ("j", 0, 30, "qsv", 70.0, None), ("j", 1, 20, "qsv", None, 9.0)],
                                   "job_id string, shot_idx int, x int, encoder string, score double, bytes_per_frame double")
    seeds = spark.createDataFrame([("j", 1, 24.5)], "job_id string, shot_idx int, seed double")
    total = spark.createDataFrame([("j", 80)], "job_id string, n_frames long")
    jobs = spark.createDataFrame([("j", "a.mkv", 24.0, [20, 30], 7)], "job_id string, source string, fps double, probe_grid array<int>, other int")
    path = str(tmp_path / "d")
    logs.write_probe_dataset(logs.job_records(jobs, shots), path)
    logs.write_probe_dataset(logs.shot_records(shots, probes, 80.0, total, seeds), path)
    logs.write_probe_dataset(logs.crfs_records(spark.createDataFrame([("j", 0, 25), ("j", 1, None)], "job_id string, shot_idx int, x int")), path)
    log = logs.read_probe_dataset(spark, path)
    head = log.filter("type = 'job'").first()
    assert (head.source, head.fps, head.probe_grid, head.shots, head.frames) == ("a.mkv", 24.0, [20, 30], 2, 80)
    by = {r.idx: r for r in log.filter("type = 'shot'").collect()}
    assert by[0].qsv_bpf == {"20": 11.5} and by[0].seed is None and by[1].seed == 24.5 and by[1].qsv_bpf == {"20": 9.0}
    costs = {(r.shot_idx, r.x): r.bytes_per_frame for r in logs.dataset_probes(log).filter("encoder = 'qsv'").collect()}
    assert costs == {(0, 20): 11.5, (0, 30): None}
    assert [tuple(r) for r in logs.dataset_settings(log).collect()] == [("j", 0, 25.0)]
