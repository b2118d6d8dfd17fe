"""Subtitle operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6, table
from shotlake.catalog import views as v
from shotlake.operators import subtitles as op
from shotlake.sources.subtitles import display_sets, sup_segments

# streams from the order lines: an order is a file, a line a subtitle track
STREAMS = """s AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
  l_orderkey % 2 = 0 AS matroska, CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'ass' WHEN 1 THEN 'subrip' WHEN 2 THEN 'hdmv_pgs_subtitle' ELSE 'mov_text' END AS codec,
  CASE WHEN l_returnflag = 'A' THEN 'eng' WHEN l_returnflag = 'N' THEN 'EN ' ELSE 'ger' END AS language,
  l_linestatus = 'O' AS isdef, l_returnflag = 'R' AS isforced, CAST(l_quantity AS INT) AS q, CAST(l_partkey AS BIGINT) AS pk FROM lineitem),
e AS (SELECT *, CASE WHEN q % 5 = 0 THEN 'n/a' WHEN q % 5 = 1 THEN '0' ELSE CAST(q AS VARCHAR) END AS frames, CASE WHEN q % 6 = 0 THEN '3' ELSE '1' END AS nb,
  CASE WHEN q % 7 = 0 THEN 'N/A' WHEN q % 3 = 0 THEN '0' ELSE CAST(q * 1000 AS VARCHAR) END AS dts FROM s),
timed AS (SELECT file, bool_or(coalesce(try_cast(dts AS BIGINT) > 0, false)) AS timed FROM e GROUP BY file),
emp AS (SELECT e.*, CASE WHEN matroska THEN CASE WHEN q % 5 = 0 OR pk % 3 = 0 THEN NULL ELSE frames = '0' END
  WHEN nb = '3' THEN false WHEN dts = 'N/A' THEN NULL WHEN dts <> '0' THEN false WHEN NOT timed THEN NULL ELSE true END AS empty FROM e JOIN timed USING (file))"""


def _streams(spark, sf):
    items = table(spark, sf, "lineitem")
    rows = v._numbered(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], 4096.0, "pos")
    q, pk = F.col("l_quantity").cast("int"), F.col("l_partkey")
    frames = F.when(q % 5 == 0, "n/a").when(q % 5 == 1, "0").otherwise(q.cast("string"))
    tags = F.when(pk % 3 == 0, F.create_map(F.lit("title"), F.lit("x"))).otherwise(F.create_map(F.lit("NUMBER_OF_FRAMES-eng"), frames))
    flags = F.concat_ws("+", F.when(F.col("l_linestatus") == "O", "default"), F.when(F.col("l_returnflag") == "R", "forced"),
                        F.when(q % 2 == 0, "hearing_impaired"))
    return rows.select(
        F.col("l_orderkey").alias("file"), "pos", (F.col("l_orderkey") % 2 == 0).alias("matroska"), F.lit("subtitle").alias("codec_type"),
        F.when(q % 4 == 0, "ass").when(q % 4 == 1, "subrip").when(q % 4 == 2, "hdmv_pgs_subtitle").otherwise("mov_text").alias("codec"),
        F.when(F.col("l_returnflag") == "A", "eng").when(F.col("l_returnflag") == "N", "EN ").otherwise("ger").alias("language"),
        (F.col("l_linestatus") == "O").alias("default"), (F.col("l_returnflag") == "R").alias("forced"), flags.alias("flags"), tags.alias("tags"),
        F.when(q % 6 == 0, "3").otherwise("1").alias("nb_frames"), F.when(q % 7 == 0, "N/A").when(q % 3 == 0, "0").otherwise(
            (q * 1000).cast("string")).alias("duration_ts"), q.alias("q"))


@v.written
def _judged(spark, sf):
    return op.empty_streams(_streams(spark, sf))


@query("empty_streams", f"WITH {STREAMS} SELECT file, pos, empty FROM emp")
def empty_streams(spark, sf):
    return _judged(spark, sf).select("file", "pos", "empty")


@query("keep_streams", f"""WITH {STREAMS} SELECT file, pos, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS new_pos FROM emp WHERE NOT coalesce(empty, false)""")
def keep_streams(spark, sf):
    return op.keep_streams(_judged(spark, sf)).select("file", "pos", "new_pos")


COMPANIONS = STREAMS + """,
comp AS (SELECT *, CASE WHEN codec = 'hdmv_pgs_subtitle' THEN 'ocr' ELSE 'text' END AS companion FROM emp
  WHERE NOT coalesce(empty, false) AND (codec = 'ass' OR codec = 'hdmv_pgs_subtitle' AND trim(lower(language)) IN ('eng', 'en')))"""


@query("companion_candidates", f"WITH {COMPANIONS} SELECT file, pos, companion FROM comp")
def companion_candidates(spark, sf):
    return op.companion_candidates(_judged(spark, sf)).select("file", "pos", "companion")


@query("move_default_flag", f"""WITH {COMPANIONS},
k AS (SELECT emp.*, comp.file IS NOT NULL AS made FROM emp LEFT JOIN comp ON comp.file = emp.file AND comp.pos = emp.pos WHERE NOT coalesce(emp.empty, false))
SELECT file, pos, 'source' AS kind, CASE WHEN made AND isdef THEN coalesce(nullif(concat_ws('+', CASE WHEN isforced THEN 'forced' END, CASE WHEN q % 2 = 0 THEN 'hearing_impaired' END), ''), '0')
  ELSE concat_ws('+', CASE WHEN isdef THEN 'default' END, CASE WHEN isforced THEN 'forced' END, CASE WHEN q % 2 = 0 THEN 'hearing_impaired' END) END AS flags FROM k
UNION ALL SELECT file, pos, 'companion', coalesce(nullif(concat_ws('+', CASE WHEN isdef THEN 'default' END, CASE WHEN isforced THEN 'forced' END,
  CASE WHEN codec = 'hdmv_pgs_subtitle' AND q % 2 = 0 THEN 'hearing_impaired' END), ''), '0') FROM k WHERE made""")
def move_default_flag(spark, sf):
    kept = op.keep_streams(_judged(spark, sf))
    return op.move_default_flag(kept, op.companion_candidates(kept).select("file", "pos"))


@query("lost_defaults", f"WITH {COMPANIONS} SELECT file, pos FROM emp WHERE isdef AND (file, pos) NOT IN (SELECT file, pos FROM comp)")
def lost_defaults(spark, sf):
    rows = _judged(spark, sf)
    return op.lost_defaults(rows, op.companion_candidates(rows))


@query("zip_streams", f"""WITH {STREAMS},
t AS (SELECT file, pos, CASE WHEN codec = 'ass' THEN 'S_TEXT/ASS' WHEN codec = 'subrip' THEN 'S_TEXT/UTF8' WHEN codec = 'hdmv_pgs_subtitle' THEN CASE WHEN file % 10 = 0 THEN 'S_VOBSUB' ELSE 'S_HDMV/PGS' END ELSE 'S_X' END AS id,
  CASE WHEN q % 9 = 0 THEN NULL ELSE q % 4 END AS entries FROM emp WHERE NOT (file % 6 = 0 AND pos = 0)),
n AS (SELECT file, count(*) AS nt, count(entries) AS ne FROM t GROUP BY file),
m AS (SELECT file, count(*) AS ns, bool_or(codec = 'hdmv_pgs_subtitle' AND file % 10 = 0) AS clash FROM emp GROUP BY file),
j AS (SELECT emp.file, emp.pos, empty, t.entries, coalesce(ns = nt AND ne > 0 AND NOT clash, false) AS usable FROM emp JOIN m USING (file) LEFT JOIN n USING (file) LEFT JOIN t ON t.file = emp.file AND t.pos = emp.pos)
SELECT file, pos, CASE WHEN usable AND empty IS NULL AND entries IS NOT NULL THEN entries = 0 ELSE empty END AS empty FROM j""")
def zip_streams(spark, sf):
    rows = _judged(spark, sf)
    c, k = F.col("codec"), F.col("file")
    code = F.when(c == "ass", "S_TEXT/ASS").when(c == "subrip", "S_TEXT/UTF8").when(
        c == "hdmv_pgs_subtitle", F.when(k % 10 == 0, "S_VOBSUB").otherwise("S_HDMV/PGS")).otherwise("S_X")
    tracks = rows.filter(~((k % 6 == 0) & (F.col("pos") == 0))).select(
        "file", F.col("pos").alias("id"), code.alias("codec_id"), F.when(F.col("q") % 9 == 0, None).otherwise(F.col("q") % 4).alias("entries"))
    return op.zip_streams(rows, tracks).select("file", "pos", "empty")


# display sets from events: two of five kinds erase
EVENTS = v.OBS + """,
ev AS (SELECT job_id AS track_id, seq, seq * 90000 + CAST(floor(value) AS BIGINT) * 300 AS pts, CASE WHEN event_type IN ('view', 'error') THEN 'erase' ELSE 'compose' END AS kind FROM obs)"""


def _events(spark, sf):
    return v.obs(spark, sf).select(
        F.col("job_id").alias("track_id"), "seq", (F.col("seq") * 90000 + F.floor("value").cast("long") * 300).alias("pts"),
        F.when(F.col("event_type").isin("view", "error"), "erase").otherwise("compose").alias("kind"))


@query("cue_intervals", f"""WITH {EVENTS},
n AS (SELECT *, lead(pts) OVER (PARTITION BY track_id ORDER BY seq) AS e FROM ev),
c AS (SELECT *, CASE WHEN e > pts THEN e - pts END AS d FROM n WHERE kind = 'compose'),
u AS (SELECT track_id, list_sort(list(d) FILTER (WHERE d IS NOT NULL))[count(d) // 2 + 1] AS usual FROM c GROUP BY track_id)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS cue_idx, round(pts / 90000.0, 6) AS start, round((pts + coalesce(d, usual, 180000)) / 90000.0, 6) AS "end", d IS NULL AS unclosed
FROM c LEFT JOIN u USING (track_id)""")
def cue_intervals(spark, sf):
    return op.cue_intervals(_events(spark, sf)).withColumn("start", r6("start")).withColumn("end", r6("end"))


@query("orphan_erases", f"""WITH {EVENTS}, n AS (SELECT *, lag(kind) OVER (PARTITION BY track_id ORDER BY seq) AS p FROM ev)
SELECT track_id, count(*) FILTER (WHERE kind = 'erase' AND p IS DISTINCT FROM 'compose') AS orphans FROM n GROUP BY track_id""")
def orphan_erases(spark, sf):
    return op.orphan_erases(_events(spark, sf))


@query("sup_segments", f"""WITH {EVENTS}, j AS (SELECT track_id, seq, pts, kind FROM ev)
SELECT CAST(track_id AS VARCHAR) AS path, pts, 22 AS type, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT CAST(track_id AS VARCHAR), pts, 128, count(*) FROM j GROUP BY ALL""")
def sup_segments_query(spark, sf):
    return sup_segments(_sup(spark, sf)).groupBy("path", "pts", "type").agg(F.count(F.lit(1)).alias("n"))


@v.written
def _sup(spark, sf):
    """A binary track per user: a composition of eleven bytes and an end segment per event."""
    pts = F.lpad(F.hex(F.col("pts")), 8, "0")
    count = F.when(F.col("kind") == "compose", "01").otherwise("00")
    text = F.concat(F.lit("5047"), pts, F.lit("0000000016000B"), F.lit("07800438100000008000"), count,
                    F.lit("5047"), pts, F.lit("00000000800000"))
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", text.alias("t")))), lambda s: s["t"]), "")
    return _events(spark, sf).groupBy(F.col("track_id").cast("string").alias("path")).agg(F.unhex(packed).alias("content"))


@query("display_sets", f"""WITH {EVENTS} SELECT CAST(track_id AS VARCHAR) AS track_id, pts, kind, count(*) AS n FROM ev GROUP BY ALL""")
def display_sets_query(spark, sf):
    sets = display_sets(v.settle(sup_segments(_sup(spark, sf))))
    return sets.groupBy("track_id", "pts", "kind").agg(F.count(F.lit(1)).alias("n"))


CLOCK = """lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"""
SRT = v.CUES + """, m AS (SELECT *, CAST(round_even(start * 1000, 0) AS BIGINT) AS a, CAST(round_even("end" * 1000, 0) AS BIGINT) AS b FROM cues WHERE text <> '')"""


@query("srt_blocks", f"""WITH {SRT} SELECT track_id, n, md5(n || chr(10) || {CLOCK.format(ms='a')} || ' --> ' || {CLOCK.format(ms='b')} || chr(10) || text || chr(10)) AS block FROM (
SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) AS n FROM m)""")
def srt_blocks(spark, sf):
    return op.srt_blocks(v.cues(spark, sf)).withColumn("block", F.md5("block"))


WORDS = v.CUES + "," + v.LEXICON + r""",
tok AS (SELECT track_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS t FROM cues),
wd AS (SELECT track_id, regexp_replace(regexp_replace(lower(t), '^[''\-]+|[''\-]+$', '', 'g'), '''(s|t|re|ll|ve|d|m|em)$', '') AS word FROM tok),
wc AS (SELECT track_id, word, count(*) AS n FROM wd GROUP BY ALL)"""


@query("cue_words", f"WITH {WORDS} SELECT * FROM wc")
def cue_words(spark, sf):
    return op.cue_words(v.cues(spark, sf))


SIGNALS = WORDS + """,
n AS (SELECT *, lead(start) OVER (PARTITION BY track_id ORDER BY cue_idx) AS nx FROM cues WHERE text <> ''),
o AS (SELECT track_id, count(*) AS srt_cues, count(*) FILTER (WHERE start >= nx) AS late, count(*) FILTER (WHERE "end" - start <= 0) AS bad, count(*) FILTER (WHERE "end" > nx + 1e-6) AS "overlaps",
  CAST(sum(length(text)) AS BIGINT) AS chars_total, CAST(sum(length(text) - length(replace(text, '|', ''))) AS BIGINT) AS bars, CAST(sum(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) AS BIGINT) AS nonascii,
  list_sort(list(length(text)))[count(*) // 2 + 1] AS med FROM n GROUP BY track_id),
al AS (SELECT track_id, count(*) AS pgs_cues, count(*) FILTER (WHERE rung = 'primary') AS p FROM cues GROUP BY track_id),
jd AS (SELECT track_id, CAST(sum(n) AS BIGINT) AS tokens, sum(CASE WHEN word <> '' AND word NOT IN (SELECT word FROM lexicon) THEN n ELSE 0 END) AS oov FROM wc GROUP BY track_id),
sig AS (SELECT track_id, pgs_cues, coalesce(srt_cues, 0) AS srt_cues, pgs_cues - coalesce(srt_cues, 0) AS empty_cues, round(coalesce(srt_cues, 0) / pgs_cues, 6) AS cue_coverage,
  round((pgs_cues - coalesce(srt_cues, 0)) / pgs_cues, 6) AS empty_rate, coalesce(late, 0) = 0 AND coalesce(bad, 0) = 0 AS timing_parse_sane, coalesce("overlaps", 0) AS "overlaps",
  round(coalesce("overlaps", 0) / greatest(coalesce(srt_cues, 0), 1), 6) AS overlap_rate, coalesce(chars_total, 0) AS chars_total, CAST(coalesce(med, 0) AS DOUBLE) AS chars_per_cue, coalesce(bars, 0) AS bars,
  round(1000.0 * coalesce(bars, 0) / greatest(coalesce(chars_total, 0), 1), 4) AS bar_rate, round(1 - p / pgs_cues, 6) AS fallback_rate, coalesce(nonascii, 0) AS nonascii,
  round(coalesce(nonascii, 0) / greatest(coalesce(chars_total, 0), 1), 6) AS nonascii_rate, coalesce(tokens, 0) AS tokens, CAST(CASE WHEN tokens > 0 THEN round(oov / tokens, 6) ELSE 0 END AS DOUBLE) AS oov_rate,
  (SELECT count(*) FROM lexicon) AS lexicon_entries FROM al LEFT JOIN o USING (track_id) LEFT JOIN jd USING (track_id))"""


@v.written
def _signals(spark, sf):
    return op.track_signals(v.cues(spark, sf), v.lexicon(spark, sf))


@query("track_signals", f"WITH {SIGNALS} SELECT * FROM sig")
def track_signals(spark, sf):
    return op.track_signals(v.cues(spark, sf), v.lexicon(spark, sf))


def _gate(name: str, op_: str, bound: float) -> str:
    cmp = {"<=": "<=", ">=": ">=", "==": "="}[op_]
    skip = "tokens < 100" if name == "oov_rate" else "false"
    return (f"SELECT track_id, '{name}' AS gate, CAST({name} AS DOUBLE) AS value, '{op_}' AS op, CAST({bound} AS DOUBLE) AS bound, "
            f"CASE WHEN {skip} THEN 'skipped' WHEN CAST({name} AS DOUBLE) {cmp} {bound} THEN 'pass' ELSE 'fail' END AS result FROM sig")


GATES = SIGNALS + ", gates AS (" + " UNION ALL ".join(_gate(*g) for g in op.GATES) + ")"


@query("evaluate_gates", f"WITH {GATES} SELECT * FROM gates")
def evaluate_gates(spark, sf):
    return op.evaluate_gates(_signals(spark, sf), min_tokens=100)


@query("passed_tracks", f"WITH {GATES} SELECT track_id, bool_and(result <> 'fail') AS ok, count(*) FILTER (WHERE result = 'fail') AS failed FROM gates GROUP BY track_id")
def passed_tracks(spark, sf):
    return op.passed_tracks(op.evaluate_gates(_signals(spark, sf), min_tokens=100))


# recognised text with the usual damage: strokes for I, and dotted initialisms from a word's first letters
DAMAGED = v.CUES + r""",
dmg AS (SELECT track_id, cue_idx, replace(text, 'I', '|') || chr(10) || CASE WHEN cue_idx % 3 = 0 THEN 'S.H.|.E.L.D. said' WHEN cue_idx % 3 = 1 THEN 'the S.H.I.LE.L.D. |''ve' ELSE 'U.S.A. and N.A.T.O...' END AS text FROM cues)"""


@v.written
def _damaged(spark, sf):
    k = F.col("cue_idx") % 3
    tail = F.when(k == 0, "S.H.|.E.L.D. said").when(k == 1, "the S.H.I.LE.L.D. |'ve").otherwise("U.S.A. and N.A.T.O...")
    text = F.concat(F.replace("text", F.lit("I"), F.lit("|")), F.lit("\n"), tail)
    return v.cues(spark, sf).select("track_id", "cue_idx", text.alias("text"))


@query("track_gazetteer", f"""WITH {DAMAGED},
m AS (SELECT track_id, unnest(regexp_extract_all(translate(text, '|1', 'II'), '(?:[A-Za-z]{{0,2}}\\.){{3,}}')) AS s FROM dmg)
SELECT track_id, replace(s, '.', '') AS word, count(*) AS n FROM m WHERE regexp_full_match(s, '(?:[A-Z]\\.){{3,}}') GROUP BY ALL""".replace("\\\\.", "\\."))
def track_gazetteer(spark, sf):
    return op.track_gazetteer(_damaged(spark, sf)).drop("first_seen")


@query("clean_cues")
def clean_cues(spark, sf):
    return op.clean_cues(_damaged(spark, sf), v.lexicon(spark, sf))


@query("rule_hits")
def rule_hits(spark, sf):
    return op.rule_hits(op.clean_cues(_damaged(spark, sf), v.lexicon(spark, sf)))
