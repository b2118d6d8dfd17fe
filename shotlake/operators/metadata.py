"""Release signatures in titles, tags, track names and attachments.

tags    file, tag_no, target (global, track, other), name, value
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.functions.naming import AD_TOKENS, has_ad, is_release_name, strip_ads

# fixed values: tags that only say who made the file, stamps, statistics, font suffixes
JUNK_GLOBAL = ["ENCODER", "ENCODED_BY", "COMMENT", "COPYRIGHT", "UPLOADER", "GROUP", "MUXER", "MAJOR_BRAND",
               "MINOR_VERSION", "COMPATIBLE_BRANDS"]
JUNK_TRACK = ["HANDLER_NAME", "VENDOR_ID"]
LAV_STAMP = r"^Lav[cf]\d"
STATISTICS = ["BPS", "DURATION", "NUMBER_OF_FRAMES", "NUMBER_OF_BYTES", "_STATISTICS_WRITING_APP",
              "_STATISTICS_WRITING_DATE_UTC", "_STATISTICS_TAGS"]
FONTS = r"(?i)\.(?:ttf|otf|ttc|woff|woff2|pfb|pfm)$"

FILE = ("file",)


def judge_tags(tags: DataFrame, tokens: Iterable[str] = AD_TOKENS) -> DataFrame:
    """Each tag with `drop`: junk names by target, encoder stamps on tracks, any
    value with a signature, and global values that are release names. Statistics stay."""
    name, value, target = F.upper("name"), F.coalesce("value", F.lit("")), F.col("target")
    drop = (F.when(name.isin(STATISTICS), False)
            .when((target == "global") & name.isin(JUNK_GLOBAL), True)
            .when((target == "track") & (name.isin(JUNK_TRACK) | ((name == "ENCODER") & value.rlike(LAV_STAMP))), True)
            .otherwise(has_ad(value, tokens) | ((target == "global") & is_release_name(value))))
    return tags.withColumn("drop", F.coalesce(drop, F.lit(False)))


def drop_tags(tags: DataFrame, tokens: Iterable[str] = AD_TOKENS) -> DataFrame:
    """Tags that stay."""
    return judge_tags(tags, tokens).filter(~F.col("drop")).drop("drop")


def emptied_parents(tags: DataFrame, tokens: Iterable[str] = AD_TOKENS, key: Sequence[str] = FILE) -> DataFrame:
    """Tag elements left without any entry: they go too."""
    return judge_tags(tags, tokens).groupBy(*key, "tag_no").agg(F.every("drop").alias("_all")).filter("_all").drop("_all")


def metadata_edits(titles: DataFrame, tracks: DataFrame, attachments: DataFrame,
                   tokens: Iterable[str] = AD_TOKENS, key: Sequence[str] = FILE) -> DataFrame:
    """Edits taking signatures out of each file's header: (file, kind, uid, new_value).

    titles (file, title), tracks (file, uid, name), attachments (file, uid, name,
    content_type). An empty new track name is deleted; fonts are never touched.
    """
    tokens = list(tokens)
    title = F.col("title")
    gone = titles.filter((F.coalesce(title, F.lit("")) != "") & (has_ad(title, tokens) | is_release_name(title)))
    named = tracks.filter((F.coalesce("name", F.lit("")) != "") & F.col("uid").isNotNull()).withColumn(
        "_new", F.when(is_release_name(F.col("name")), "").otherwise(strip_ads(F.col("name"), tokens)))
    changed = named.filter(F.col("_new") != F.col("name"))
    font = F.coalesce("content_type", F.lit("")).contains("font") | F.col("name").rlike(FONTS)
    signed = attachments.filter(F.col("uid").isNotNull() & ~font & has_ad(F.col("name"), tokens))
    nothing = F.lit(None).cast("string")
    return (gone.select(*key, F.lit("delete title").alias("kind"), F.lit(None).cast("long").alias("uid"), nothing.alias("new_value"))
            .unionByName(changed.select(
                *key, F.when(F.col("_new") == "", "delete name").otherwise("set name").alias("kind"),
                F.col("uid").cast("long").alias("uid"), F.when(F.col("_new") != "", F.col("_new")).alias("new_value")))
            .unionByName(signed.select(*key, F.lit("delete attachment").alias("kind"),
                                       F.col("uid").cast("long").alias("uid"), nothing.alias("new_value"))))
