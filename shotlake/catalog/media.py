"""Media headers and plans on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, r6, table
from shotlake.catalog import views as v
from shotlake.functions import media as fn
from shotlake.functions.naming import dynamic_range
from shotlake.operators import media as op
from shotlake.sources.media import parse_media, parse_streams, parse_tags

MASTER = "G(13250,34500)B(7500,3000)R(34000,16000)WP(15635,16450)L(10000000,1)"


@v.written
def _docs(spark, sf):
    """A probe document per order, written out as JSON text."""
    k = F.col("o_orderkey")
    trc = F.when(k % 6 == 0, "smpte2084").when(k % 6 == 1, "arib-std-b67").when(k % 6 == 2, "bt709")
    side = F.when(k % 6 == 0, F.lit('{"side_data_type":"Content light level metadata","max_content":1000,"max_average":400}'))
    dovi = F.when(k % 8 == 0, F.concat(
        F.lit('{"side_data_type":"DOVI configuration record","dv_profile":'), F.when(k % 16 == 0, "5").otherwise("8"),
        F.lit(',"rpu_present_flag":1,"el_present_flag":0,"bl_present_flag":1,"dv_bl_signal_compatibility_id":'), (k % 5).cast("string"), F.lit("}")))
    sides = F.concat(F.lit('"side_data_list":['), F.concat_ws(",", side, dovi), F.lit("],"))
    video = F.concat(
        F.lit('{"index":0,"codec_type":"video","codec_name":"'), F.when(k % 9 == 0, "av1").otherwise("hevc"), F.lit('","width":'),
        F.when(k % 2 == 0, "3840").otherwise("1920"), F.lit(',"height":'), F.when(k % 2 == 0, "2160").otherwise("1080"), F.lit(',"pix_fmt":"'),
        F.when(k % 3 == 0, "yuv420p10le").otherwise("yuv420p"), F.lit('",'), F.coalesce(F.concat(F.lit('"color_transfer":"'), trc, F.lit('",')), F.lit("")),
        sides, F.lit('"avg_frame_rate":"'), F.when(k % 7 == 0, "0/0").otherwise("24000/1001"), F.lit('","r_frame_rate":"25/1","tags":{"language":"eng"}}'))
    audio = F.array_join(F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: F.concat(F.lit('{"codec_type":"audio","index":'), i.cast("string"), F.lit("}"))), ",")
    streams = F.concat_ws(",", F.when(k % 50 != 0, video), audio, F.lit(
        '{"codec_type":"subtitle","codec_name":"ass","disposition":{"default":1,"forced":0,"hearing_impaired":1},"tags":{"title":"t"}}'))
    body = F.concat(F.lit('{"format":{"format_name":"matroska,webm","duration":"'), F.col("o_totalprice").cast("string"),
                    F.lit('","bit_rate":"5000","start_time":"N/A"},"streams":['), streams, F.lit("]}"))
    body = F.when(k % 97 == 0, "not json").otherwise(body)
    name = F.concat(F.lit("/lib/show/Show.S01E"), k.cast("string"), F.when(k % 2 == 0, ".2160p.h265").otherwise(".1080p"), F.when(k % 8 == 0, ".DV.HDR10").otherwise(""), F.lit(".mkv"))
    # a file scan is as wide as the file has row groups; the documents are spread by key before they are parsed
    return table(spark, sf, "orders").select(name.alias("path"), body.alias("body"), k.alias("k")).repartition("k")


MEDIA = """md AS (SELECT o_orderkey AS k, '/lib/show/Show.S01E' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.2160p.h265' ELSE '.1080p' END || CASE WHEN o_orderkey % 8 = 0 THEN '.DV.HDR10' ELSE '' END AS base,
  o_totalprice AS duration, o_orderkey % 50 <> 0 AS v, CASE WHEN o_orderkey % 2 = 0 THEN 3840 ELSE 1920 END AS w, CASE WHEN o_orderkey % 2 = 0 THEN 2160 ELSE 1080 END AS h FROM orders WHERE o_orderkey % 97 <> 0)"""


@query("parse_media", f"""WITH {MEDIA} SELECT base || '.mkv' AS path, duration, CASE WHEN v THEN w ELSE 0 END AS width, CASE WHEN v THEN h ELSE 0 END AS height,
  CASE WHEN NOT v THEN 0.0 WHEN k % 7 = 0 THEN 25.0 ELSE 23.976024 END::DOUBLE AS fps, CASE WHEN NOT v THEN '' WHEN k % 9 = 0 THEN 'av1' ELSE 'hevc' END AS video_codec, k % 3 + 1 AS audio_count, 1 AS subtitle_count,
  v AND k % 6 = 0 AS is_hdr, v AND k % 6 = 1 AS is_hlg, v AND k % 9 = 0 AS is_av1, CASE WHEN v AND k % 3 = 0 THEN 10 END AS bit_depth, CASE WHEN v AND k % 6 = 0 THEN '1000,400' END AS max_cll,
  v AND k % 8 = 0 AS dovi, CASE WHEN v AND k % 8 = 0 THEN CASE WHEN k % 16 = 0 THEN 5 ELSE 8 END ELSE 0 END AS profile, CASE WHEN v AND k % 8 = 0 THEN k % 5 ELSE 0 END AS compatible_id FROM md""")
def parse_media_query(spark, sf):
    return parse_media(_docs(spark, sf)).select(
        "path", "duration", "width", "height", "fps", "video_codec", "audio_count", "subtitle_count", "is_hdr", "is_hlg", "is_av1",
        "color.bit_depth", "color.max_cll", F.col("dovi.present").alias("dovi"), "dovi.profile", "dovi.compatible_id")


@query("parse_streams", f"""WITH {MEDIA} SELECT base || '.mkv' AS file, 'video' AS codec_type, 0 AS pos, '' AS flags, 'eng' AS language FROM md WHERE v
UNION ALL SELECT base || '.mkv', 'audio', unnest(range(0, k % 3 + 1)), '', '' FROM md UNION ALL SELECT base || '.mkv', 'subtitle', 0, 'default+hearing_impaired', '' FROM md""")
def parse_streams_query(spark, sf):
    return parse_streams(_docs(spark, sf)).select("file", "codec_type", "pos", "flags", "language")


BASE = """, base AS (SELECT *, CASE WHEN k % 8 = 0 AND v THEN CASE WHEN k % 16 = 0 THEN 5 ELSE 8 END ELSE 0 END AS prof,
  CASE k % 5 WHEN 1 THEN 'pq' WHEN 4 THEN 'hlg' WHEN 2 THEN 'sdr' END AS known, CASE WHEN k % 6 = 0 THEN 'pq' WHEN k % 6 = 1 THEN 'hlg' WHEN k % 6 = 2 THEN 'sdr' ELSE 'pq' END AS said FROM md),
sig AS (SELECT *, CASE WHEN prof = 5 THEN 'pq' WHEN prof = 8 THEN coalesce(known, said) WHEN v AND k % 6 = 0 THEN 'pq' WHEN v AND k % 6 = 1 THEN 'hlg' ELSE 'sdr' END AS base_sig FROM base)"""


@query("base_signal", f"WITH {MEDIA} {BASE} SELECT base || '.mkv' AS path, CASE WHEN NOT v THEN 'pq' WHEN prof > 0 THEN coalesce(known, said) ELSE said END AS signal FROM sig")
def base_signal(spark, sf):
    return parse_media(_docs(spark, sf)).select("path", op.base_signal().alias("signal"))


@query("colour_tags", f"""WITH {MEDIA} {BASE} SELECT base || '.mkv' AS path, CASE WHEN base_sig = 'sdr' THEN 'bt709' ELSE 'bt2020' END AS primaries, CASE base_sig WHEN 'pq' THEN 'smpte2084' WHEN 'hlg' THEN 'arib-std-b67' ELSE 'bt709' END AS transfer,
  CASE WHEN base_sig = 'pq' AND v AND k % 6 = 0 THEN '{MASTER}' END AS master_display, CASE WHEN base_sig = 'pq' AND v AND k % 6 = 0 THEN '1000,400' END AS max_cll FROM sig""")
def colour_tags(spark, sf):
    t = op.colour_tags()
    return parse_media(_docs(spark, sf)).select("path", t["primaries"].alias("primaries"), t["transfer"].alias("transfer"),
                                                t["master_display"].alias("master_display"), t["max_cll"].alias("max_cll"))


@query("plan_actions", f"""WITH {MEDIA} {BASE},
p AS (SELECT *, CASE WHEN NOT v THEN 'no video stream' WHEN k % 9 = 0 AND h >= 2000 THEN 'already AV1 (' || w || 'x' || h || ')' WHEN k % 11 = 0 THEN 'no target quality' END AS skip_reason,
  CASE WHEN base_sig = 'pq' THEN CASE WHEN v AND k % 6 = 0 THEN 'HDR10' ELSE 'PQ' END WHEN base_sig = 'hlg' THEN 'HLG' ELSE '' END AS dr FROM sig)
SELECT base || '.mkv' AS path, skip_reason IS NOT NULL AS skip, skip_reason, CASE WHEN skip_reason IS NULL THEN '/lib/show/av1/Show.S01E' || k || CASE WHEN k % 2 = 0 THEN '.2160p.AV1' ELSE '.1080p' END
  || CASE WHEN k % 8 = 0 THEN CASE WHEN dr = '' THEN '' ELSE '.' || dr END ELSE '' END || CASE WHEN k % 2 = 0 THEN '.mkv' ELSE '.av1.mkv' END END AS output_path,
  CASE WHEN skip_reason IS NULL THEN CASE WHEN base_sig = 'sdr' THEN 'bt709' ELSE 'bt2020' END END AS color_primaries FROM p""")
def plan_actions(spark, sf):
    k = F.regexp_extract("path", r"S01E(\d+)", 1).cast("long")
    media = parse_media(_docs(spark, sf)).withColumn("preset", F.when(k % 11 == 0, "shots").otherwise("")).withColumn(
        "overrides", F.create_map(F.lit("crf"), F.lit("24"), F.lit("bogus"), F.lit("1")))
    presets = table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "balanced").when(F.col("r_regionkey") == 1, "shots").otherwise(
        F.col("r_name")).alias("name")).withColumn("params", F.create_map(F.lit("crf"), F.lit("30"), F.lit("engine"), F.when(
            F.col("name") == "shots", "optimizer").otherwise("svt"), F.lit("target_quality"), F.lit("")))
    base = {"crf": "30", "engine": "svt", "target_quality": "", "target_metric": "vmaf"}
    return op.plan_actions(media, presets, base, {"min_height": 2000}).select("path", "skip", "skip_reason", "output_path", "color_primaries")


@query("dynamic_range", """SELECT k, CASE k % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'HDR10' ELSE 'PQ' END WHEN 1 THEN 'HLG' ELSE '' END AS dr FROM (SELECT o_orderkey AS k FROM orders)""")
def dynamic_range_query(spark, sf):
    k = F.col("k")
    trc = F.when(k % 3 == 0, "smpte2084").when(k % 3 == 1, "arib-std-b67").otherwise("bt709")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", dynamic_range(trc, k % 2 == 0).alias("dr"))


@query("mastering_display", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN round(CASE o_orderkey % 5 WHEN 0 THEN (10000 + o_orderkey % 3000) / 50000.0 WHEN 1 THEN (1 + o_orderkey % 9) / 16.0 ELSE 0.265 END, 6) END AS green_x,
CASE WHEN o_orderkey % 5 < 4 THEN CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1000.0 ELSE 4000.0 END AS DOUBLE) END AS max_luminance FROM orders""")
def mastering_display(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.format_string("G(%d,34500)B(7500,3000)R(34000,16000)WP(15635,16450)L(10000000,1)", 10000 + k % 3000)).when(
        k % 5 == 1, F.format_string("G(%d/16,1/2)B(1/8,1/16)R(3/4,1/3)WP(1/3,1/3)L(4000/1,1/1000)", 1 + k % 9)).when(
        k % 5 < 4, "G(0.265,0.69)B(0.15,0.06)R(0.68,0.32)WP(0.3127,0.329)L(4000,0.005)").otherwise("G(1/0,1)B(1,1)R(1,1)WP(1,1)L(1,1)")
    md = fn.mastering_display(text)
    return table(spark, sf, "orders").select(k, r6(md["green_x"]).alias("green_x"), md["max_luminance"].alias("max_luminance"))


@query("colour_codes", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 1 END AS primaries, CASE o_orderkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 1 ELSE 18 END AS transfer, CASE o_orderkey % 2 WHEN 0 THEN 10 ELSE 8 END AS bits,
CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE 1 END AS subsample_h, CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE 0 END AS subsample_v, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS siting_h FROM orders""")
def colour_codes(spark, sf):
    k = F.col("o_orderkey")
    c = fn.colour_codes(F.when(k % 2 == 0, "yuv420p10le").otherwise("yuvj422p"), F.when(k % 3 == 0, "bt2020").when(k % 3 == 1, "bt709"),
                        F.when(k % 3 == 0, "smpte2084").when(k % 3 == 1, "bt709").otherwise("arib-std-b67"), F.lit("bt2020nc"), F.lit("tv"),
                        F.when(k % 4 == 0, "left").when(k % 4 == 1, "center").otherwise("unspecified"))
    return table(spark, sf, "orders").select(k, *[c[n].alias(n) for n in ("primaries", "transfer", "bits", "subsample_h", "subsample_v", "siting_h")])


@query("display_label", f"""WITH {MEDIA} SELECT k, CASE WHEN NOT v THEN '?' ELSE CASE WHEN k % 9 = 0 THEN 'av1' ELSE 'hevc' END || ' ' || w || 'x' || h || CASE WHEN k % 7 = 0 THEN ' 25fps' ELSE ' 23.976fps' END
|| CASE k % 6 WHEN 0 THEN ' trc=smpte2084' WHEN 1 THEN ' trc=arib-std-b67' WHEN 2 THEN ' trc=bt709' ELSE '' END || CASE WHEN k % 16 = 0 THEN ' DV-P5' WHEN k % 8 = 0 THEN ' DV-P8' WHEN k % 6 = 0 THEN ' HDR' ELSE '' END END AS label FROM md""")
def display_label(spark, sf):
    m = parse_media(_docs(spark, sf))
    k = F.regexp_extract("path", r"S01E(\d+)", 1).cast("long")
    label = fn.display_label(F.col("video_codec"), F.col("width"), F.col("height"), F.col("fps"), F.col("color.transfer"),
                             F.col("dovi.present"), F.col("dovi.profile"), F.col("is_hdr"))
    return m.select(k.alias("k"), label.alias("label"))


@query("parse_tags", """SELECT CAST(c_custkey AS VARCHAR) AS file, CAST(0 AS BIGINT) AS tag_no, CASE c_custkey % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'global' ELSE 'other' END AS target, 'TITLE' AS name, c_name AS value FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'global', unnest(['SEGMENT', 'NATION']), unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) FROM customer""")
def parse_tags_query(spark, sf):
    k = F.col("c_custkey")
    uid = F.when(k % 3 == 0, "<TrackUID>1</TrackUID>").when(k % 3 == 1, "<TargetTypeValue>50</TargetTypeValue>").otherwise("<ChapterUID>2</ChapterUID>")

    def simple(name: str, value):
        return F.concat(F.lit(f"<Simple><Name>{name}</Name><String>"), value, F.lit("</String></Simple>"))

    body = F.concat(F.lit('<?xml version="1.0"?><Tags><Tag><Targets>'), uid, F.lit("</Targets>"), simple("TITLE", F.col("c_name")), F.lit("</Tag><Tag><Targets/>"),
                    simple("SEGMENT", F.col("c_mktsegment")), simple("NATION", F.col("c_nationkey").cast("string")), F.lit("</Tag></Tags>"))
    tags = parse_tags(table(spark, sf, "customer").select(k.cast("string").alias("path"), body.alias("body")))
    return tags.withColumn("tag_no", F.col("tag_no").cast("long"))
