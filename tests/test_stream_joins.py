"""Joins of stream lists, which grow with the library, against plain results; none may go through the driver."""

from shotlake.operators import subtitles as op
from shotlake.plans import position

STREAM = ("file string, pos long, codec_type string, codec string, language string, default boolean, forced boolean, flags string, "
          "matroska boolean, tags map<string,string>, nb_frames string, duration_ts string")


def streams(spark):
    row = lambda f, p, codec, default, flags, ts="0": (f, p, "subtitle", codec, "eng", default, False, flags, False, {}, "1", ts)
    return spark.createDataFrame([
        row("a", 0, "ass", True, "default"), row("a", 1, "hdmv_pgs_subtitle", False, "hearing_impaired", "N/A"), row("a", 4, "subrip", True, "default"),
        row("b", 0, "subrip", False, ""), row("b", 1, "subrip", False, "", "N/A"), row("c", 0, "ass", True, "default", "9")], STREAM)


def collected(df):
    """Rows, and whether the plan that ran or any part of it was broadcast."""
    rows = df.collect()
    return rows, "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_default_moves_without_a_broadcast(spark):
    kept = streams(spark).withColumnRenamed("nb_frames", "n")
    rows, broadcast = collected(op.move_default_flag(kept, op.companion_candidates(kept.selectExpr("*", "CAST(NULL AS BOOLEAN) AS empty")).select("file", "pos")))
    assert {(r.file, r.pos, r.kind, r.flags) for r in rows} == {
        ("a", 0, "source", "0"), ("a", 0, "companion", "default"), ("a", 1, "source", "hearing_impaired"), ("a", 1, "companion", "hearing_impaired"),
        ("a", 4, "source", "default"), ("b", 0, "source", ""), ("b", 1, "source", ""), ("c", 0, "source", "0"), ("c", 0, "companion", "default")}
    assert len(rows) == 9 and not broadcast
    rows, broadcast = collected(op.lost_defaults(kept, op.companion_candidates(kept.selectExpr("*", "CAST(NULL AS BOOLEAN) AS empty"))))
    assert [(r.file, r.pos) for r in rows] == [("a", 4)] and not broadcast


def test_second_tool_fills_without_a_broadcast(spark):
    judged, broadcast = collected(op.empty_streams(streams(spark)))
    assert {(r.file, r.pos): r.empty for r in judged} == {("a", 0): None, ("a", 1): None, ("a", 4): None, ("b", 0): None, ("b", 1): None, ("c", 0): False}
    assert not broadcast
    tracks = spark.createDataFrame([("a", 3, "S_TEXT/ASS", 5), ("a", 7, "s_hdmv/pgs", 0), ("a", 9, "S_TEXT/UTF8", None),
                                    ("b", 0, "S_TEXT/UTF8", 0), ("c", 0, "S_TEXT/UTF8", 0)], "file string, id long, codec_id string, entries long")
    rows, broadcast = collected(op.zip_streams(op.empty_streams(streams(spark)), tracks))
    assert {(r.file, r.pos): r.empty for r in rows} == {("a", 0): False, ("a", 1): True, ("a", 4): None, ("b", 0): None, ("b", 1): None, ("c", 0): False}
    assert not broadcast


def test_streams_are_judged_by_one_shuffle(spark, tmp_path):
    spark.createDataFrame([(f, p, f == "b" and p == 1) for f in "abc" for p in (1, 0)], "file string, pos long, told boolean").write.parquet(str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    rows = position(rows, ["file"], ["pos"], 4096, "nth").selectExpr(
        "file", "nth AS pos", "'subtitle' AS codec_type", "false AS matroska", "CAST(map() AS MAP<STRING, STRING>) AS tags", "'1' AS nb_frames",
        "IF(told, '7', '0') AS duration_ts")
    judged = op.empty_streams(rows)
    got = {(r.file, r.pos): (r.empty, r.why) for r in judged.collect()}
    unknown = (None, "file states no duration")
    assert got == {("a", 0): unknown, ("a", 1): unknown, ("b", 0): (True, "zero duration"), ("b", 1): (False, "duration"), ("c", 0): unknown, ("c", 1): unknown}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    # positions and durations come from the same distribution by file
    assert "Join" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_streams_of_large_and_unnamed_files(spark):
    at = lambda f, n, told: [(f, p, "subtitle", "ass", "eng", False, False, "", False, {}, "1", "5" if p == told else "0") for p in range(n)]
    rows = spark.createDataFrame(at("a", 70000, 69999) + at("b", 3, None) + at(None, 2, 0), STREAM)
    got = op.empty_streams(rows).groupBy("file", "empty").count().collect()
    assert {(r.file, r["empty"], r["count"]) for r in got} == {("a", True, 69999), ("a", False, 1), ("b", None, 3)}


def test_each_pattern_of_a_stream_is_tried_once(spark):
    told = lambda tags, nb, ts, mkv: ("a", len(tags or {}), "subtitle", "ass", "eng", False, False, "", mkv, tags, nb, ts)
    wide = "9" * 39
    cases = [(told({"NUMBER_OF_FRAMES-eng": " 0 ", "number_of_frames": "7"}, "1", "0", True), False, "count=7"),
             (told({"NUMBER_OF_FRAMES": "0"}, "9", "9", True), True, "count=0"), (told({"Number_Of_Frames-x": "n/a"}, "9", "9", True), None, "unparseable count"),
             (told({"NUMBER_OF_FRAMES-eng": wide}, "1", "0", True), None, "unparseable count"), (told({"title": "0"}, "1", "0", True), None, "no count"),
             (told(None, " 3 ", "x", False), False, "samples"), (told(None, wide, None, False), None, "no duration"),
             (told(None, None, " 5 ", False), False, "duration"), (told(None, "1", wide, False), None, "file states no duration"),
             (told(None, "1", "0", False), None, "file states no duration")]
    rows = spark.createDataFrame([(f"{i}", *row[1:]) for i, (row, _, _) in enumerate(cases)], STREAM)
    judged = op.empty_streams(rows)
    assert {int(r.file): (r.empty, r.why) for r in judged.collect()} == {i: (e, w) for i, (_, e, w) in enumerate(cases)}
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("number_of_frames") == 1 and plan.count("RLIKE ^\\d+$") <= 4
