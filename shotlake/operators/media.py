"""Media headers to transcode plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlake.functions.naming import av1_stem, dynamic_range
from shotlake.operators.jobs import layer_params, resolve_presets

# fixed values: what a Dolby Vision base layer carries by compatibility id; default metadata
BASE_SIGNAL = {1: "pq", 6: "pq", 4: "hlg", 2: "sdr"}
DEFAULT_MASTER = "G(13250,34500)B(7500,3000)R(34000,16000)WP(15635,16450)L(10000000,1)"
DEFAULT_CLL = "1000,400"

CONFIG = {"skip_existing_av1": True, "min_height": 0, "hdr_preserve": True, "dovi_enabled": True, "save_rpu": True,
          "default_preset": "balanced", "output_dir": None, "rpu_dir": None}


def base_signal() -> Column:
    """pq, hlg or sdr for a media row: the compatibility id decides, then what the
    stream says of itself; a silent stream is pq."""
    table = F.create_map(*[F.lit(v) for kv in BASE_SIGNAL.items() for v in kv])
    trc = F.lower(F.coalesce("color.transfer", F.lit("")))
    told = (trc != "") & ~trc.isin("unknown", "unspecified", "reserved")
    return F.coalesce(F.try_element_at(table, F.coalesce("dovi.compatible_id", F.lit(0))),
                      F.when(F.col("is_hdr"), "pq").when(F.col("is_hlg"), "hlg").when(told, "sdr").otherwise("pq"))


def colour_tags(cfg: Mapping = CONFIG) -> Column:
    """struct(primaries, transfer, matrix, range, master_display, max_cll) for the encode of a media row."""
    dovi = F.coalesce("dovi.present", F.lit(False))
    p5 = dovi & (F.coalesce("dovi.profile", F.lit(0)) == 5) & F.lit(bool(cfg["dovi_enabled"]))
    base = F.when(p5, "pq").when(dovi, base_signal()).when(F.col("is_hdr"), "pq").when(F.col("is_hlg"), "hlg").otherwise("sdr")
    wide = base.isin("pq", "hlg")
    hdr_default = F.col("is_hdr")
    keep = (base == "pq") & F.lit(bool(cfg["hdr_preserve"]))

    def meta(own: str, default: str) -> Column:
        return F.when(keep, F.coalesce(own, F.when(hdr_default, F.lit(default))))

    range_ = F.when(wide, "tv").otherwise(F.when(F.coalesce("color.range", F.lit("")) != "", F.col("color.range")).otherwise("tv"))
    return F.struct(
        F.when(wide, "bt2020").otherwise("bt709").alias("primaries"),
        F.when(base == "pq", "smpte2084").when(base == "hlg", "arib-std-b67").otherwise("bt709").alias("transfer"),
        F.when(wide, "bt2020nc").otherwise("bt709").alias("matrix"), range_.alias("range"),
        meta("color.mastering_display", DEFAULT_MASTER).alias("master_display"), meta("color.max_cll", DEFAULT_CLL).alias("max_cll"))


def output_paths(path: Column, transfer: Column, has_metadata: Column, rpu: Column, cfg: Mapping = CONFIG) -> Column:
    """struct(output_path, rpu_path) of an encode."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = av1_stem(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), dynamic_range(transfer, has_metadata))
    out = F.lit(cfg["output_dir"]) if cfg["output_dir"] else F.concat(parent, F.lit("/av1"))
    rpu_dir = F.lit(cfg["rpu_dir"]) if cfg["rpu_dir"] else F.concat(out, F.lit("/rpu"))
    ending = F.when(stem["found"], ".mkv").otherwise(".av1.mkv")
    return F.struct(F.concat(out, F.lit("/"), stem["stem"], ending).alias("output_path"),
                    F.when(rpu, F.concat(rpu_dir, F.lit("/"), stem["stem"], F.lit(".rpu"))).alias("rpu_path"))


def plan_actions(media: DataFrame, presets: DataFrame, base: Mapping[str, str], cfg: Mapping = CONFIG) -> DataFrame:
    """What to do with each file. `media` carries `preset` (may be empty) and
    `overrides` (a map); the first rule that applies decides."""
    cfg = {**CONFIG, **dict(cfg)}
    rows = resolve_presets(media, presets, cfg["default_preset"], base)
    rows = rows.withColumn("params", layer_params(
        F.col("params"), F.coalesce("overrides", F.create_map().cast("map<string,string>")), known=list(base)))

    def param(name: str) -> Column:
        return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(""))

    no_video = F.coalesce("video_codec", F.lit("")) == ""
    av1 = F.coalesce("is_av1", F.lit(False)) & F.lit(bool(cfg["skip_existing_av1"]))
    tall = F.col("height") >= cfg["min_height"]
    shots = param("engine") == "optimizer"
    untargeted = shots & (F.trim(param("target_quality")) == "")
    reason = (F.when(no_video, "no video stream")
              .when(av1 & tall, F.format_string("already AV1 (%dx%d)", F.col("width"), F.col("height")))
              .when(untargeted, "no target quality"))
    dovi, on = F.coalesce("dovi.present", F.lit(False)), bool(cfg["dovi_enabled"])
    profile = F.col("dovi.profile")
    rpu = dovi & F.lit(on and bool(cfg["save_rpu"]))
    target = F.upper(F.when(profile == 5, "pq").otherwise(base_signal()))
    target = F.when(target == "PQ", "HDR10").otherwise(target)
    go = reason.isNull()
    notes = F.array_compact(F.array(
        F.when(~no_video & av1 & ~tall, "AV1 source below min height, still re-encoding"),
        F.when(go & shots, F.format_string("shot-based: %s %s", param("target_metric"), param("target_quality"))),
        F.when(go & dovi & F.lit(on), F.concat(F.format_string("Dolby Vision P%d: -> %s", profile, target),
                                                F.when(rpu, " + RPU saved").otherwise(""))),
        F.when(go & dovi & F.lit(on) & (profile == 5), "P5: converted to HDR10"),
        F.when(go & dovi & F.lit(on) & profile.isin(7, 8), F.format_string("P%d: base layer encoded", profile)),
        F.when(go & dovi & ~F.lit(on), "Dolby Vision kept as is")))
    rows = rows.withColumn("_tags", colour_tags(cfg)).withColumn("skip_reason", reason).withColumn("_notes", notes)
    has_meta = F.col("_tags.master_display").isNotNull() | F.col("_tags.max_cll").isNotNull()
    rows = rows.withColumn("_out", output_paths(F.col("path"), F.col("_tags.transfer"), has_meta, rpu, cfg))

    def when_going(c: Column) -> Column:
        return F.when(F.col("skip_reason").isNull(), c)

    return rows.select(
        "path", F.col("skip_reason").isNotNull().alias("skip"), "skip_reason", "preset_name", "params",
        when_going(F.col("_tags.primaries")).alias("color_primaries"), when_going(F.col("_tags.transfer")).alias("color_trc"),
        when_going(F.col("_tags.matrix")).alias("colorspace"), when_going(F.col("_tags.range")).alias("color_range"),
        when_going(F.col("_tags.master_display")).alias("master_display"), when_going(F.col("_tags.max_cll")).alias("max_cll"),
        when_going(F.col("_out.output_path")).alias("output_path"), when_going(F.col("_out.rpu_path")).alias("rpu_path"),
        F.col("_notes").alias("notes"))
