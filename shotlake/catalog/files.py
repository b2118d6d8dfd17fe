"""Sources and writers that go through files: the given tables are written, read back, and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shotlake.catalog import query, subtitles, table
from shotlake.catalog import views as v
from shotlake.plans.lineage import shared_folder
from shotlake.sources import grain_tables
from shotlake.sources import subtitles as subtitle_files
from shotlake.sources.lines import read_whole
from shotlake.sources.tail import follow_log


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _titles(spark, folder: str, suffix: str):
    """(title, n_chars, md5) of the files of a folder."""
    name = F.regexp_extract("path", r"([^/]+)\." + suffix.removeprefix(".") + "$", 1)
    return read_whole(spark, folder).select(name.cast("long").alias("title"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("md5"))


@query("srt_files", f"""WITH {subtitles.SRT}, b AS (SELECT track_id, n, n || chr(10) || {subtitles.CLOCK.format(ms='a')} || ' --> ' || {subtitles.CLOCK.format(ms='b')} || chr(10) || text || chr(10) || chr(10) AS block FROM (
SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cue_idx) AS n FROM m)),
f AS (SELECT track_id AS title, string_agg(block, '' ORDER BY n) AS body FROM b GROUP BY track_id)
SELECT title, length(body) AS n_chars, md5(body) AS md5 FROM f""")
def srt_files(spark, sf):
    folder = _folder(spark, "srt")
    subtitle_files.write_srt_files(v.cues(spark, sf), folder)
    return _titles(spark, folder, ".srt")


@query("grain_files", f"""WITH {v.PAIRS}, r AS (SELECT job_id, seq, 'E ' || seq * 10 || ' ' || (seq * 10 + 10) || ' 1 7 1' || chr(10) || chr(9) || 'sY 1 0 ' || CAST(q AS INT) || chr(10) AS record FROM pairs),
f AS (SELECT job_id AS title, 'filmgrn1' || chr(10) || string_agg(record, '' ORDER BY seq) AS body FROM r GROUP BY job_id)
SELECT title, length(body) AS n_chars, md5(body) AS md5 FROM f""")
def grain_files(spark, sf):
    folder, n = _folder(spark, "grain"), F.col("seq")
    record = F.format_string("E %d %d 1 7 1\n\tsY 1 0 %d", n * 10, n * 10 + 10, F.col("q").cast("int"))
    grain_tables.write_grain_files(v.pairs(spark, sf).select(F.col("job_id").alias("source_id"), n.alias("f0"), record.alias("record")), folder)
    return _titles(spark, folder, ".tbl")


@query("follow_log", "SELECT event_id, event_id || ' ' || event_type AS line, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS run FROM events")
def follow_log_(spark, sf):
    """Lines of logs that are followed twice, more logs having come in between; each line is read once."""
    folder = _folder(spark, "logs")
    rows = table(spark, sf, "events").select("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value"))
    for run, part in enumerate((F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0)):
        rows.filter(part).select("value").write.mode("append").text(f"{folder}/in")

        def keep(batch, batch_id, run=run):
            batch.write.mode("overwrite").parquet(f"{folder}/out/run={run}/batch={batch_id}")

        (follow_log(spark, f"{folder}/in/part-*", "start", rotated=f"{folder}/none").writeStream.option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).foreachBatch(keep).start().awaitTermination())
    out = spark.read.schema("file string, file_id string, pos long, line string, run int, batch long").parquet(f"{folder}/out")
    return out.select(F.split("line", " ")[0].cast("long").alias("event_id"), "line", "run")
