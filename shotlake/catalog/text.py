"""Name, tag and scalar text functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6, table
from shotlake.catalog import views as v
from shotlake.functions import naming, text, units
from shotlake.operators import metadata as op
from shotlake.operators.curves import setting_text

# a word character as the Unicode patterns have it
W = r"\pL\pN\pM_"


@query("has_ad", rf"""SELECT page_id, regexp_matches(html, '(?i)(?:https?://|www\.)[^\s\]\)】|]+|(?:^|[^{W}.])[{W}-]{{2,}}(?:\.[{W}-]+)*\.(?:com|net|org|cc|me|tv|io|xyz|top|info|vip|cn|club)(?:$|[^{W}])') AS ad FROM pages""")
def has_ad(spark, sf):
    return table(spark, sf, "pages").select("page_id", naming.has_ad(F.col("html"), []).alias("ad"))


# release-like names from pages: resolution, source, codec and a group
NAME = """nm AS (SELECT page_id, 'Show.S' || lpad(CAST(page_id % 20 AS VARCHAR), 2, '0') || CASE page_id % 3 WHEN 0 THEN '.2160p' WHEN 1 THEN '.1080p' ELSE ' (1080p)' END || CASE page_id % 4 WHEN 0 THEN '.x265' WHEN 1 THEN '.H.264' WHEN 2 THEN '.HEVC' ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN '.DV.HDR10' WHEN page_id % 5 = 1 THEN '.HDR10' ELSE '' END || '-GRP' AS stem FROM pages)"""


def _name():
    k = F.col("page_id")
    return F.concat(F.lit("Show.S"), F.lpad((k % 20).cast("string"), 2, "0"), F.when(k % 3 == 0, ".2160p").when(k % 3 == 1, ".1080p").otherwise(" (1080p)"),
                    F.when(k % 4 == 0, ".x265").when(k % 4 == 1, ".H.264").when(k % 4 == 2, ".HEVC").otherwise(""),
                    F.when(k % 5 == 0, ".DV.HDR10").when(k % 5 == 1, ".HDR10").otherwise(""), F.lit("-GRP"))


@query("is_release_name", f"WITH {NAME} SELECT page_id, page_id % 3 < 2 AS release FROM nm")
def is_release_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", naming.is_release_name(_name()).alias("release"))


@query("av1_stem", f"""WITH {NAME} SELECT page_id, regexp_replace(regexp_replace(stem, '\\.(x265|H\\.264|HEVC)', '.AV1'), '\\.DV\\.HDR10', CASE WHEN page_id % 2 = 0 THEN '.HDR10' ELSE '' END) AS stem, page_id % 4 < 3 AS found FROM nm""")
def av1_stem(spark, sf):
    out = naming.av1_stem(_name(), F.when(F.col("page_id") % 2 == 0, "HDR10").otherwise(""))
    return table(spark, sf, "pages").select("page_id", out["stem"].alias("stem"), out["found"].alias("found"))


@query("strip_ads", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'English ' || n_chars WHEN 1 THEN 'Dub ' || n_chars || ' | SDH' ELSE 'Track ' || n_chars END AS name FROM documents""")
def strip_ads(spark, sf):
    k, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    name = F.when(k == 0, F.concat(F.lit("English "), n, F.lit(" [www.example.com]"))).when(k == 1, F.concat(
        F.lit("Dub "), n, F.lit(" | BTM | SDH"))).otherwise(F.concat(F.lit("Track "), n))
    return table(spark, sf, "documents").select("doc_id", naming.strip_ads(name).alias("name"))


@query("strip_ads_pages")
def strip_ads_pages(spark, sf):
    clean = naming.strip_ads(F.col("html"))
    return table(spark, sf, "pages").select("page_id", clean.alias("html"), naming.has_ad(clean).alias("left"))


TAGS = """tg AS (SELECT doc_id AS file, doc_id % 4 AS tag_no, CASE source WHEN 'src0' THEN 'global' WHEN 'src1' THEN 'track' ELSE 'other' END AS target,
  CASE doc_id % 5 WHEN 0 THEN 'ENCODER' WHEN 1 THEN 'comment' WHEN 2 THEN 'BPS' WHEN 3 THEN 'TITLE' ELSE 'VENDOR_ID' END AS name,
  CASE doc_id % 7 WHEN 0 THEN 'Lavc61.3' WHEN 1 THEN 'see www.example.com' WHEN 2 THEN 'Show.S01.1080p.x265-G' ELSE 'plain' END AS value FROM documents),
jt AS (SELECT *, CASE WHEN upper(name) = 'BPS' THEN false WHEN target = 'global' AND upper(name) IN ('ENCODER', 'COMMENT') THEN true WHEN target = 'track' AND (upper(name) = 'VENDOR_ID' OR upper(name) = 'ENCODER' AND value LIKE 'Lavc6%') THEN true
  ELSE value LIKE '%www.%' OR (target = 'global' AND value LIKE 'Show%') END AS gone FROM tg)"""


def _tags(spark, sf):
    k, s = F.col("doc_id"), F.col("source")
    return table(spark, sf, "documents").select(
        k.alias("file"), (k % 4).alias("tag_no"), F.when(s == "src0", "global").when(s == "src1", "track").otherwise("other").alias("target"),
        F.when(k % 5 == 0, "ENCODER").when(k % 5 == 1, "comment").when(k % 5 == 2, "BPS").when(k % 5 == 3, "TITLE").otherwise("VENDOR_ID").alias("name"),
        F.when(k % 7 == 0, "Lavc61.3").when(k % 7 == 1, "see www.example.com").when(k % 7 == 2, "Show.S01.1080p.x265-G").otherwise("plain").alias("value"))


@query("drop_tags", f"WITH {TAGS} SELECT file, tag_no, target, name, value FROM jt WHERE NOT gone")
def drop_tags(spark, sf):
    return op.drop_tags(_tags(spark, sf))


@query("emptied_parents", f"WITH {TAGS} SELECT file // 10 AS file, tag_no FROM jt GROUP BY ALL HAVING bool_and(gone)")
def emptied_parents(spark, sf):
    return op.emptied_parents(_tags(spark, sf).withColumn("file", F.floor(F.col("file") / 10)))


@query("metadata_edits", """SELECT doc_id AS file, 'delete title' AS kind, CAST(NULL AS BIGINT) AS uid, CAST(NULL AS VARCHAR) AS new_value FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'delete name' ELSE 'set name' END, n_chars, CASE WHEN doc_id % 4 <> 0 THEN 'SDH' END FROM documents WHERE doc_id % 4 < 2
UNION ALL SELECT doc_id, 'delete attachment', n_chars, NULL FROM documents WHERE doc_id % 5 = 1""")
def metadata_edits(spark, sf):
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    titles = docs.select(k.alias("file"), F.when(k % 3 == 0, "Show.S01E01.1080p.WEBRip.x265-RARBG").otherwise("A plain title").alias("title"))
    tracks = docs.select(k.alias("file"), F.col("n_chars").alias("uid"), F.when(k % 4 == 0, "BTM").when(k % 4 == 1, "BTM SDH").otherwise("English").alias("name"))
    att = docs.select(k.alias("file"), F.col("n_chars").alias("uid"), F.when(k % 5 == 0, "www.font.com.ttf").when(k % 5 == 1, "BEN.THE.MEN.TORRENTS.jpg").otherwise("cover.jpg").alias("name"),
                      F.when(k % 5 == 0, "font/ttf").otherwise("image/jpeg").alias("content_type"))
    return op.metadata_edits(titles, tracks, att)


@query("parse_target", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(60 + event_id % 30 AS DOUBLE) END AS lo, CASE WHEN event_id % 4 = 1 THEN CAST(90 + event_id % 10 AS DOUBLE) END AS hi,
CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_id % 8 = 3 THEN 'invalid' ELSE 'inverted' END END AS error FROM events""")
def parse_target(spark, sf):
    k = F.col("event_id")
    lo, hi = (60 + k % 30).cast("string"), (90 + k % 10).cast("string")
    t = F.when(k % 4 == 1, F.concat(F.lit(" "), lo, F.lit(" - "), hi)).when(k % 4 < 3, lo).when(k % 8 == 3, "x75").otherwise(F.concat(hi, F.lit("-"), F.lit("10")))
    out = text.parse_target(t)
    return table(spark, sf, "events").select("event_id", out["lo"].alias("lo"), out["hi"].alias("hi"), out["error"].alias("error"))


@query("parse_flags", """SELECT event_id, CAST(event_id % 9 AS VARCHAR) AS tune, CASE WHEN event_id % 3 = 0 THEN '8' END AS grain, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS crf FROM events""")
def parse_flags(spark, sf):
    k = F.col("event_id")
    options = F.concat_ws(" ", F.concat(F.lit("--tune="), (k % 9).cast("string")), F.when(k % 3 == 0, "--film-grain 8"), F.lit("--flag"),
                          F.when(k % 2 == 0, F.concat(F.lit("-crf "), F.col("user_id").cast("string"))))
    m = text.parse_flags(options)
    return table(spark, sf, "events").select("event_id", F.try_element_at(m, F.lit("tune")).alias("tune"),
                                             F.try_element_at(m, F.lit("film-grain")).alias("grain"), F.try_element_at(m, F.lit("crf")).alias("crf"))


@query("strip_grain_flags", """SELECT event_id, '--tune 0' || CASE WHEN event_id % 3 = 1 THEN ' overlays=1' ELSE '' END || ' --keyint 240' AS kept,
CASE event_id % 3 WHEN 0 THEN '--film-grain 8' WHEN 1 THEN 'film-grain=8' ELSE '' END AS gone FROM events""")
def strip_grain_flags(spark, sf):
    k = F.col("event_id") % 3
    options = F.concat(F.lit("--tune 0"), F.when(k == 0, " --film-grain 8").when(k == 1, " overlays=1:film-grain=8").otherwise(""), F.lit(" --keyint 240"))
    out = text.strip_grain_flags(options)
    return table(spark, sf, "events").select("event_id", out["kept"].alias("kept"), F.array_join(out["gone"], ",").alias("gone"))


@query("sanitise_srt", r"SELECT conv_id, turn, text || '!' AS text FROM conversations")
def sanitise_srt(spark, sf):
    dirty = F.concat(F.lit('<font face="x">{\\an8}'), F.col("text"), F.lit("</font>!"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.sanitise_srt(dirty).alias("text"))


@query("clean_text", r"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\f\x0B\x{0085}\x{2028}\x{2029}]'),
  lambda s: regexp_replace(regexp_replace(s, '[ \t\x{00A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda s: s <> ''), chr(10)) AS text FROM conversations""")
def clean_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.clean_text(F.col("text")).alias("text"))


@query("rebuild_reason", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'unspecified' END AS reason FROM events""")
def rebuild_reason(spark, sf):
    k = F.col("event_id") % 4
    log = F.when(k == 0, F.concat(F.lit("x\r[vf] Reconfiguring filter graph because "), F.col("event_type"), F.lit(" \nend"))).when(
        k == 1, "abc Reconfiguring filter graph\n").when(k == 2, "      title           : Reconfiguring filter graph because me").otherwise("quiet")
    return table(spark, sf, "events").select("event_id", text.rebuild_reason(log).alias("reason"))


@query("json_or_text", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(props ->> 'k' AS BIGINT) END AS k, CASE WHEN event_id % 3 = 0 THEN left(props, 4) ELSE props END AS raw FROM events")
def json_or_text(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    out = text.json_or_text(raw, "k long")
    return table(spark, sf, "events").select("event_id", out["value"]["k"].alias("k"), out["raw"].alias("raw"))


@query("size_to_mb", """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN floor(value) / 1024 WHEN 1 THEN floor(value) WHEN 2 THEN floor(value) * 1024 ELSE 0 END, 6) AS mb FROM events""")
def size_to_mb(spark, sf):
    k, n = F.col("event_id") % 4, F.floor("value").cast("string")
    t = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" MiB"))).when(k == 2, F.concat(n, F.lit("  GiB"))).otherwise("junk KiB")
    return table(spark, sf, "events").select("event_id", r6(units.size_to_mb(t)).alias("mb"))


@query("fmt_bytes", """SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(CAST(floor(b + 0.5) AS BIGINT) AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024 * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0 * 10 + 0.5) / 10) END AS text
FROM (SELECT o_orderkey, floor(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 0.003 WHEN 1 THEN 1.0 ELSE 9000.7 END AS b FROM orders)""")
def fmt_bytes(spark, sf):
    k = F.col("o_orderkey") % 3
    n = F.floor("o_totalprice") * F.when(k == 0, 0.003).when(k == 1, 1.0).otherwise(9000.7)
    return table(spark, sf, "orders").select("o_orderkey", units.fmt_bytes(n).alias("text"))


@query("fmt_duration", """SELECT o_orderkey, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 40 + 0.5) AS BIGINT) AS s FROM orders)""")
def fmt_duration(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", units.fmt_duration(F.col("o_totalprice") / 40).alias("text"))


@query("fmt_ratio", f"""WITH {v.JOBS}, p AS (SELECT id, CAST(floor((1 - size_after / size_before) * 100 + 0.5) AS BIGINT) AS p FROM jobs)
SELECT id, CASE WHEN p > 0 THEN '↘' || p || '%' WHEN p < 0 THEN '↗' || -p || '%' ELSE '±0%' END AS text FROM p""")
def fmt_ratio(spark, sf):
    return v.jobs(spark, sf).select("id", units.fmt_ratio(F.col("size_before"), F.col("size_after")).alias("text"))


@query("eta_text", f"""WITH {v.JOBS}, s AS (SELECT *, CAST(floor((1000 - progress_done) / nullif(progress_fps, 0) + 0.5) AS BIGINT) AS s FROM jobs)
SELECT id, CASE WHEN stage = 'probing' OR progress_fps = 0 THEN '' ELSE s // 60 || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS text FROM s""")
def eta_text(spark, sf):
    return v.jobs(spark, sf).select("id", units.eta_text(F.col("progress_done"), F.col("progress_total"), F.col("progress_fps"), F.col("stage")).alias("text"))


@query("plain_decimal", r"""SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(regexp_replace(printf('%.6f', l_tax / 8), '0+$', ''), '\.$', '.0') AS text FROM lineitem""")
def plain_decimal(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", units.plain_decimal(F.col("l_tax") / 8).alias("text"))


@query("estimate_memory", """SELECT l_orderkey, l_linenumber, l_partkey, round((0.4 + 8.2944 * greatest(0.3, 0.2455 * ln(greatest(l_quantity * 20, 8)) - 0.368) * CASE l_linenumber WHEN 1 THEN 0.55 WHEN 2 THEN 0.65 WHEN 3 THEN 0.8 WHEN 5 THEN 1.15 WHEN 6 THEN 1.35 ELSE 1.0 END) * 1.1, 6) AS gb FROM lineitem""")
def estimate_memory(spark, sf):
    gb = units.estimate_memory(F.col("l_quantity") * 20, units.megapixels(F.lit(3840), F.lit(2160)), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(gb).alias("gb"))


@query("setting_text", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round_even(greatest(0, least(63, l_quantity * 1.5)), 0) AS BIGINT) AS VARCHAR) AS text FROM lineitem""")
def setting_text_query(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", setting_text(F.col("l_quantity") * 1.5).alias("text"))


@query("srt_timestamp", f"""WITH m AS (SELECT o_orderkey, CAST(round_even(o_totalprice * 13 / 1000 * 1000, 0) AS BIGINT) AS ms FROM orders)
SELECT o_orderkey, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS text FROM m""")
def srt_timestamp(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.srt_timestamp(F.col("o_totalprice") * 13 / 1000).alias("text"))
