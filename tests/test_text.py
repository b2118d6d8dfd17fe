"""Names, signatures, log lines and cue repairs against literal rows."""

import pytest
from pyspark.sql import functions as F

from shotlake.functions import media, naming, text, units
from shotlake.operators import metadata, subtitles
from shotlake.sources.logs import metric_score


def each(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


STEMS = [
    ("Harbour.Lights.2031.S02E03.The.Long.Pier.Bluray-2160p.Remux.h265.DTS-HD.MA.DV.HDR10", "HDR10",
     "Harbour.Lights.2031.S02E03.The.Long.Pier.Bluray-2160p.Remux.AV1.DTS-HD.MA.HDR10", True),
    ("Tidewater.S04E11.Ebb.WEBDL-2160p.x265.EAC3.HDR10Plus", "HDR10", "Tidewater.S04E11.Ebb.WEBDL-2160p.AV1.EAC3.HDR10", True),
    ("Tidewater.S04E12.Flow.WEBDL-1080p.avc.AAC.DV.HLG", "HLG", "Tidewater.S04E12.Flow.WEBDL-1080p.AV1.AAC.HLG", True),
    ("Tidewater.S04E13.Calm.WEBDL-2160p.hevc.EAC3.DV.SDR", "", "Tidewater.S04E13.Calm.WEBDL-2160p.AV1.EAC3", True),
    ("Quarry_2160p_h265_AAC_HDR10", "HDR10", "Quarry_2160p_AV1_AAC_HDR10", True),
    ("Quarry.1080p.VC-1.xvid.10bit-CREW", "", "Quarry.1080p.AV1.10bit-CREW", True),
    ("Quarry.2160p." + ".".join(["x265", "hevc", "h264"] * 3), "", "Quarry.2160p.AV1", True),
    ("Lantern.S01E02.The.DV.Reel.2160p.h265.DV", "HDR10", "Lantern.S01E02.The.DV.Reel.2160p.AV1.HDR10", True),
    ("Lantern.S01E03.2160p.WEB-DL.DV.HDR10+[CREW]", "HDR10", "Lantern.S01E03.2160p.WEB-DL.HDR10[CREW]", False),
    ("Lantern - S01E04 - HDR DV Night", "HDR10", "Lantern - S01E04 - HDR DV Night", False),
]


def test_stems(spark):
    df = spark.createDataFrame([(i, s, d) for i, (s, d, *_) in enumerate(STEMS)], "i int, s string, d string")
    got = df.select("i", naming.av1_stem(F.col("s"), F.col("d")).alias("o")).orderBy("i").collect()
    assert [(r.o.stem, r.o.found) for r in got] == [(w, f) for *_, w, f in STEMS]


ADS = ["Lantern.S01E01.2160p.WEB-DL.DV[ben.the-men]", "Quarry S01E02 [BenTheMen]", "Tidewater.S01E01.2160p.UHD.BluRay.x265.10bit-SWTYBLZ",
       "Harbour.Lights.S01E01.1080p.WEBRip.x265-CREW", "visit http://films.example.org/a today", "psarips.com | Lantern"]
CLEAN = ["Lantern (UK) - S02E05 - Under the Bridge", "Quarry (S03E02) Marble", "Ordinary Folk", "Crème Brûlée", "The Ferry (2031) S01E01 (2160p) ",
         "Knees and Elbows / Колени и локти (2x03)", "News: Harbour Closes for Repairs", "Capitolo 2 : La nave", "09:30", "7", "Psalms of the Sea", "Bond Market"]
STRIPPED = {"RARBG": "", "PSA Forced": "Forced", "HHWEB AAC 2.0 Stereo": "AAC 2.0 Stereo", "French [www.films.example.com]": "French",
            "[Rainbow.Island]": "", "Welsh | ZmPT | SDH": "Welsh | SDH", "Opus / 7.1 / 96 kHz": None, "Welsh [Dolby Digital 5.1]": None,
            "Dub [Studio]": None, "Main | Welsh (Wales) | (SDH)": None, "日本語（字幕）": None, "H.264 / AAC2.0": None}


def test_signatures(spark):
    signed = lambda c: naming.has_ad(c) | naming.is_release_name(c)
    assert each(spark, ADS + CLEAN, signed) == [True] * len(ADS) + [False] * len(CLEAN)
    assert each(spark, list(STRIPPED), naming.strip_ads) == [k if v is None else v for k, v in STRIPPED.items()]


def test_tags(spark):
    tags = spark.createDataFrame(
        [("f", 0, "global", "BPS", "www.x.com"), ("f", 0, "global", "comment", "hi"), ("f", 1, "track", "ENCODER", "Lavc63.1.101 srt"),
         ("f", 2, "track", "ENCODER", "SVT-AV1 v4.2.0"), ("f", 3, "other", "TITLE", "Intro"), ("f", 3, "other", "NOTE", "see RARBG")],
        "file string, tag_no int, target string, name string, value string")
    assert sorted(r.name for r in metadata.drop_tags(tags).collect()) == ["BPS", "ENCODER", "TITLE"]
    assert [r.tag_no for r in metadata.emptied_parents(tags).collect()] == [1]


def test_numbers(spark):
    spelled = ["G(13250,34500)B(7500,3000)R(34000,16000)WP(15635,16450)L(10000000,1)",
               "G(0.265,0.690)B(0.15,0.06)R(0.68,0.32)WP(0.3127,0.329)L(1000,0.0001)",
               "G(265/1000,69/100)B(15/100,6/100)R(68/100,32/100)WP(3127/10000,329/1000)L(1000/1,1/10000)"]
    for r in each(spark, spelled, media.mastering_display):
        assert (r.green_x, r.green_y, r.max_luminance, r.min_luminance) == pytest.approx((0.265, 0.690, 1000, 0.0001))
    assert each(spark, ["junk", "", "G(1/0,1)B(1,1)R(1,1)WP(1,1)L(1,1)"], media.mastering_display) == [None] * 3
    assert each(spark, [0.00005, 1000.0, 0.2649999999], units.plain_decimal, "double") == ["0.00005", "1000.0", "0.265"]
    assert each(spark, ["1024 KiB", "12 MiB", "x", "2048"], units.size_to_mb) == [1.0, 12.0, 0.0, 2.0]
    assert each(spark, [10980.0, 59.6, None], units.fmt_duration, "double") == ["3:03:00", "1:00", None]
    assert [tuple(r) for r in each(spark, ["75", "75-85", "85-75", "abc"], text.parse_target)] == [
        (75, None, None), (75, 85, None), (None, None, "inverted"), (None, None, "invalid")]


def test_options(spark):
    kept = each(spark, ["--film-grain 8 --tune 0", "--film-grain=8", "enable-overlays=1:film-grain=8 --x y", "--film-grain --tune 0"], text.strip_grain_flags)
    assert [r.kept for r in kept] == ["--tune 0", "", "enable-overlays=1 --x y", "--tune 0"]
    assert [list(r.gone) for r in kept] == [["--film-grain 8"], ["--film-grain=8"], ["film-grain=8"], ["--film-grain"]]
    assert each(spark, ["a=1 --b 2 -c=3 --d --e 4 junk"], text.parse_flags) == [{"a": "1", "b": "2", "c": "3", "e": "4"}]


def test_metric_logs(spark):
    bodies = ['{"pooled_metrics":{"vmaf":{"mean":82.5}}}', '{"aggregateVMAF":79.1}', '{"pooled_metrics":{"other":{"mean":3}}}',
              '{"pooled_metrics":{"a":{"mean":1},"b":{"mean":2}}}', "", "[]", '"x"', '{"pooled_metrics":{"vmaf":{"mean":"NaN"}}}', '{"pooled']
    got = each(spark, bodies, lambda c: metric_score(c, "vmaf"))
    assert [r.score for r in got] == [82.5, 79.1, 3.0] + [None] * 6
    assert all(r.error for r in got[3:]) and not any(r.error for r in got[:3])


def cue_rows(spark, texts, track="t"):
    return spark.createDataFrame([(track, i, float(i), i + 0.5, t, "primary") for i, t in enumerate(texts)],
                                 "track_id string, cue_idx long, start double, end double, text string, rung string")


def test_repairs(spark):
    lexicon = spark.createDataFrame([("look",), ("like",), ("in",)], "word string")
    texts = ["|'ve got it", "a bu|let", "S.H.|.E.L.D. is here", "the S.H.I.LE.L.D. team", "-Yes.\n\"No.", "U.S.A. and U.S.S.R.", "|ook |n", "wait... no.",
             "“It’s”  fine \n\n ok", "S.H.I.E.L.D..."]
    got = [r.text for r in subtitles.clean_cues(cue_rows(spark, texts), lexicon).orderBy("cue_idx").collect()]
    assert got == ["I've got it", "a bullet", "S.H.I.E.L.D. is here", "the S.H.I.E.L.D. team", "- Yes.\n- No.", "U.S.A. and U.S.S.R.", "look In",
                   "wait... no.", "\"It's\" fine\nok", "S.H.I.E.L.D..."]


def test_cue_times_and_gates(spark):
    def ends(events):
        return spark.createDataFrame([("t", i, int(p * 90000), k) for i, (p, k) in enumerate(events)], "track_id string, seq long, pts long, kind string")

    cues = lambda e: [(round(r.start, 3), round(r.end, 3)) for r in subtitles.cue_intervals(ends(e)).orderBy("cue_idx").collect()]
    assert cues([(1.418, "compose"), (3.670, "erase"), (4.0, "compose"), (5.5, "erase")]) == [(1.418, 3.67), (4.0, 5.5)]
    assert cues([(1, "compose"), (2, "compose"), (3, "erase")]) == [(1, 2), (2, 3)]
    assert cues([(1, "erase"), (5, "compose")]) == [(5, 7)]
    lexicon = spark.createDataFrame([("hello",), ("there",)], "word string")
    rows = cue_rows(spark, ["hello there"] + [""] * 19, "bad").unionByName(cue_rows(spark, [""] + ["hello there"] * 124, "good"))
    signals = subtitles.track_signals(rows, lexicon)
    assert {r.track_id: r.empty_rate for r in signals.collect()} == {"bad": 0.95, "good": 0.008}
    gates = subtitles.evaluate_gates(signals)
    assert {(r.track_id, r.result) for r in gates.filter("gate = 'oov_rate'").collect()} == {("bad", "skipped"), ("good", "skipped")}
    assert {r.track_id: r.ok for r in subtitles.passed_tracks(gates).collect()} == {"bad": False, "good": True}
    block = subtitles.srt_blocks(cue_rows(spark, ["", "Hi\nthere"])).first()
    assert (block.n, block.block) == (1, "1\n00:00:01,000 --> 00:00:01,500\nHi\nthere\n")
