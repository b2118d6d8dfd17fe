"""Media headers, library listings, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake import schemas
from shotlake.functions.media import frame_rate
from shotlake.sources.lines import read_whole

OWN_DIRS = ["av1", "work", "rpu"]


def side_data(stream: Column) -> Column:
    """struct(dovi, mastering_display, max_cll) from a stream's side data, each picked by its type name."""
    items = F.coalesce(stream["side_data_list"], F.array().cast(f"array<{schemas.SIDE_DATA}>"))

    def kind(d: Column) -> Column:
        return F.coalesce(d["side_data_type"], F.lit(""))

    dv = F.try_element_at(F.filter(items, lambda d: F.lower(kind(d)).rlike("dolby vision configuration|dovi configuration")), F.lit(-1))
    master = F.try_element_at(F.filter(items, lambda d: kind(d) == "Mastering display metadata"), F.lit(1))
    light = F.try_element_at(F.filter(items, lambda d: kind(d).startswith("Content light level")), F.lit(1))

    def flag(*names: str) -> Column:
        return F.coalesce(F.coalesce(*[dv[n] for n in names]).isin("1", "true"), F.lit(False))

    def number(*names: str) -> Column:
        return F.coalesce(F.coalesce(*[dv[n] for n in names]).try_cast("int"), F.lit(0))

    fields = ["green_x", "green_y", "blue_x", "blue_y", "red_x", "red_y", "white_point_x", "white_point_y",
              "max_luminance", "min_luminance"]
    whole = F.lit(True)
    for f in fields:
        whole = whole & master[f].isNotNull()
    display = F.when(whole, F.format_string("G(%s,%s)B(%s,%s)R(%s,%s)WP(%s,%s)L(%s,%s)", *[master[f] for f in fields]))
    cll = F.when(light.isNotNull(), F.concat_ws(",", F.coalesce(light["max_content"], F.lit("0")),
                                                F.coalesce(light["max_average"], F.lit("0"))))
    dovi = F.struct(
        dv.isNotNull().alias("present"), number("dv_profile").alias("profile"),
        flag("rpu_present_flag", "rpu_present").alias("rpu_present"), flag("el_present_flag", "el_present").alias("el_present"),
        flag("bl_present_flag", "bl_present").alias("bl_present"),
        number("dv_bl_signal_compatibility_id", "compatibility_id").alias("compatible_id"))
    return F.struct(dovi.alias("dovi"), display.alias("mastering_display"), cll.alias("max_cll"))


def _parsed(docs: DataFrame, body: str) -> DataFrame:
    """Documents with their JSON in `_j`, read once: the explode keeps later filters and
    projections from repeating the parse."""
    return docs.withColumn("_j", F.explode(F.array(F.from_json(F.col(body), schemas.PROBE_JSON, {"mode": "PERMISSIVE"}))))


def parse_media(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Media rows from probe JSON: the first video stream wins, the others are counted. Unreadable documents give no row."""
    rows = _parsed(docs, body).filter(F.col("_j.format").isNotNull() | F.col("_j.streams").isNotNull())
    streams = F.coalesce("_j.streams", F.array())

    def of(kind: str) -> Column:
        return F.filter("_j.streams", lambda s: s["codec_type"] == kind)

    rows = rows.withColumn("_v", F.try_element_at(of("video"), F.lit(1))).withColumn("_side", side_data(F.col("_v")))

    def text(name: str) -> Column:
        return F.col("_v." + name)

    def seconds(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))

    pix = F.coalesce(text("pix_fmt"), F.lit(""))
    depth = F.coalesce(F.when(text("bits_per_raw_sample") != "", text("bits_per_raw_sample").try_cast("int")),
                       F.when(pix.contains("p10"), 10).when(pix.contains("p12"), 12))
    trc = F.lower(F.coalesce(text("color_transfer"), F.lit("")))
    hdr = trc.rlike("smpte2084|smpte-st-2084|pq")
    return rows.select(
        F.col(path).alias("path"), F.coalesce("_j.format.format_name", F.lit("")).alias("container"),
        seconds("_j.format.duration").alias("duration"), F.col("_j.format.size").try_cast("long").alias("size"),
        F.coalesce(text("width"), F.lit(0)).alias("width"), F.coalesce(text("height"), F.lit(0)).alias("height"),
        F.when(F.col("_v").isNull(), 0.0).otherwise(frame_rate(text("avg_frame_rate"), text("r_frame_rate"))).alias("fps"),
        seconds("_j.format.bit_rate").cast("long").alias("bitrate"),
        F.coalesce(text("codec_name"), F.lit("")).alias("video_codec"),
        F.greatest(F.size(of("audio")), F.lit(0)).alias("audio_count"),
        F.greatest(F.size(of("subtitle")), F.lit(0)).alias("subtitle_count"),
        seconds("_j.format.start_time").alias("format_start"), seconds("_v.start_time").alias("video_start"),
        F.coalesce(F.try_element_at(text("tags"), F.lit("language")), F.lit("")).alias("video_language"),
        hdr.alias("is_hdr"), (~hdr & trc.rlike("arib-std-b67|hlg")).alias("is_hlg"),
        F.coalesce(text("codec_name") == "av1", F.lit(False)).alias("is_av1"),
        F.struct(text("color_primaries").alias("primaries"), text("color_transfer").alias("transfer"),
                 text("color_space").alias("space"), text("color_range").alias("range"), text("pix_fmt").alias("pix_fmt"),
                 depth.alias("bit_depth"), F.col("_side.mastering_display").alias("mastering_display"),
                 F.col("_side.max_cll").alias("max_cll")).alias("color"),
        F.col("_side.dovi").alias("dovi"))


def read_media_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_media(read_whole(spark, path, recursive=True))


def parse_streams(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """One row per stream of each probe document, with its position among streams of its kind."""
    rows = _parsed(docs, body)
    every = rows.select(F.col(path).alias("file"), F.col("_j.format.format_name").contains("matroska").alias("matroska"),
                        F.col("_j.streams").alias("_all"), F.posexplode("_j.streams").alias("_i", "s"))
    before = F.size(F.filter(F.slice("_all", 1, F.col("_i")), lambda o: o["codec_type"] == F.col("s.codec_type")))
    # flags in the order the probe lists them
    on = F.map_keys(F.map_filter(F.coalesce("s.disposition", F.create_map().cast("map<string,int>")), lambda k, v: v == 1))
    return every.select(
        "file", "matroska", F.col("s.index").alias("index"), before.alias("pos"), F.col("s.codec_type").alias("codec_type"),
        F.col("s.codec_name").alias("codec"), F.array_join(on, "+").alias("flags"),
        F.array_contains(on, "default").alias("default"), F.array_contains(on, "forced").alias("forced"),
        F.coalesce(F.try_element_at("s.tags", F.lit("language")), F.lit("")).alias("language"),
        F.coalesce(F.try_element_at("s.tags", F.lit("title")), F.lit("")).alias("title"),
        F.coalesce("s.tags", F.create_map().cast("map<string,string>")).alias("tags"),
        F.col("s.nb_frames").alias("nb_frames"), F.col("s.duration_ts").alias("duration_ts"))


def eligible(listing: DataFrame, root: str, exts: Sequence[str], own_dirs: Sequence[str] = OWN_DIRS) -> DataFrame:
    """Listed files with a wanted suffix that do not lie under one of the archive's own directories."""
    relative = F.regexp_replace("path", "^(?:file:)?/*" + "[/]*".join(["", *[p for p in root.replace("file:", "").split("/") if p]]) + "/+", "")
    folders = F.split(relative, "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return listing.filter(suffix.isin([e.lower() for e in exts]) & ~F.arrays_overlap(
        folders, F.array(*[F.lit(d) for d in own_dirs])))


def scan_library(spark: SparkSession, root: str, exts: Sequence[str], own_dirs: Sequence[str] = OWN_DIRS) -> DataFrame:
    """path, size, mtime of the library's candidate sources; contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    return eligible(files, root, exts, own_dirs)


def parse_tags(docs: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Tag rows from Matroska tag XML; the target is track, global (no *UID child) or other."""
    clean = F.regexp_replace(body, r"^\s*(<\?xml[^>]*\?>)?\s*(<!DOCTYPE[^>]*>)?", "")
    rows = docs.withColumn("_x", F.from_xml(clean, schemas.TAGS_XML, {"rowTag": "Tags"}))
    tags = rows.select(F.col(path).alias("file"), F.posexplode("_x.Tag").alias("tag_no", "t"))
    uid = F.col("t.Targets")
    other = F.coalesce(uid["ChapterUID"], uid["EditionUID"], uid["AttachmentUID"]).isNotNull()
    target = F.when(uid["TrackUID"].isNotNull(), "track").when(other, "other").otherwise("global")
    return tags.select("file", "tag_no", target.alias("target"), F.explode("t.Simple").alias("s")).select(
        "file", "tag_no", "target", F.col("s.Name").alias("name"), F.col("s.String").alias("value"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return parse_tags(read_whole(spark, path))
