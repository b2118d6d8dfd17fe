"""Device, state and progress operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.catalog import query, table
from shotlake.catalog import views as v
from shotlake.operators import jobs as op

PDEV = "0000:c6:00.0"


@query("classify_device_lines", f"""WITH l AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'xe {PDEV}: ' ELSE 'xe 0000:01:00.0: ' END || CASE event_type WHEN 'error' THEN 'Tile0: reset started'
  WHEN 'purchase' THEN 'device is Wedged.' WHEN 'view' THEN 'rcu_preempt detected expedited stalls' ELSE 'registered' END AS line, user_id % 2 = 0 AS ours, event_type FROM events)
SELECT event_id, CASE WHEN ours THEN CASE event_type WHEN 'purchase' THEN 'wedged' WHEN 'error' THEN 'error' END WHEN event_type = 'view' THEN 'error' END AS kind FROM l""")
def classify_device_lines(spark, sf):
    e = F.col("event_type")
    line = F.concat(F.when(F.col("user_id") % 2 == 0, f"xe {PDEV}: ").otherwise("xe 0000:01:00.0: "), F.when(e == "error", "Tile0: reset started").when(
        e == "purchase", "device is Wedged.").when(e == "view", "rcu_preempt detected expedited stalls").otherwise("registered"))
    return op.classify_device_lines(table(spark, sf, "events").select("event_id", line.alias("line")), PDEV).select("event_id", "kind")


@query("dedup_usage", """WITH c AS (SELECT user_id % 7 AS host, user_id AS client, event_type AS device, CASE WHEN event_id % 5 = 0 THEN floor(value) ELSE floor(value) * 1024 END / 1024.0 AS mb FROM events),
once AS (SELECT host, client, max(CASE WHEN device = 'view' THEN mb END) AS mb FROM c GROUP BY ALL)
SELECT host, round(coalesce(sum(mb), 0), 6) AS used_mb FROM once GROUP BY host""")
def dedup_usage(spark, sf):
    n = F.floor("value").cast("string")
    size = F.when(F.col("event_id") % 5 == 0, F.concat(n, F.lit(" KiB"))).otherwise(F.concat(n, F.lit(" MiB")))
    rows = table(spark, sf, "events").select((F.col("user_id") % 7).alias("host"), F.col("user_id").alias("client"),
                                             F.col("event_type").alias("device"), size.alias("size"))
    return op.dedup_usage(rows, "view").withColumn("used_mb", F.round("used_mb", 6))


KINDS = {"error": "error", "purchase": "wedged", "signup": "test_start", "click": "test_ok", "view": "test_fail"}
HEALTH = """ev AS (SELECT user_id AS device, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'wedged' WHEN 'signup' THEN 'test_start' WHEN 'click' THEN 'test_ok'
  WHEN 'view' THEN 'test_fail' END AS kind, epoch_us(ts) / 1e6 - value AS started FROM events)"""


@query("device_health", f"""WITH {HEALTH},
now AS (SELECT max(t) + 30 AS now FROM ev),
told AS (SELECT device, max(t) FILTER (WHERE kind IN ('error', 'wedged')) AS err, max(t) FILTER (WHERE kind = 'wedged') AS wed, arg_max(started, t) FILTER (WHERE kind = 'test_ok') AS passed,
  arg_max(kind, t) FILTER (WHERE kind IN ('test_ok', 'test_fail')) AS result, arg_max(kind, t) FILTER (WHERE starts_with(kind, 'test')) AS test, max(t) FILTER (WHERE kind = 'test_start') AS since FROM ev GROUP BY device),
judged AS (SELECT device, CASE WHEN test = 'test_start' AND now - since > 180 THEN 'down' WHEN wed IS NOT NULL AND NOT coalesce(passed > wed, false) THEN 'down' WHEN result = 'test_fail' THEN 'down'
  WHEN err IS NOT NULL AND (now - err < 600 OR NOT coalesce(passed > err, false)) THEN 'degraded' WHEN passed IS NULL THEN 'starting' ELSE 'ok' END AS state FROM told, now)
SELECT device, state, state = 'ok' AS usable FROM judged""")
def device_health(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    t = F.col("ts").cast("timestamp").cast("double")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("device"), t.alias("ts"), F.try_element_at(kinds, F.col("event_type")).alias("kind"),
                                             (t - F.col("value")).alias("started"))
    return op.device_health(rows, rows.agg(F.max("ts") + 30).scalar(), key=["device"])


STREAK = 3
STREAKS = """o AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE WHEN event_type = 'view' THEN 'neutral' WHEN value < 40 THEN 'fail' ELSE 'ok' END AS outcome FROM events),
j AS (SELECT *, count(*) FILTER (WHERE outcome = 'ok') OVER (PARTITION BY job_id ORDER BY seq) AS island FROM o WHERE outcome <> 'neutral'),
s AS (SELECT *, count(*) FILTER (WHERE outcome = 'fail') OVER (PARTITION BY job_id, island ORDER BY seq) AS streak FROM j)"""


def _outcomes(spark, sf):
    outcome = F.when(F.col("event_type") == "view", "neutral").when(F.col("value") < 40, "fail").otherwise("ok")
    return v.obs(spark, sf).select("job_id", "seq", outcome.alias("outcome"))


@query("failure_streaks", f"WITH {STREAKS} SELECT job_id, seq, outcome, streak, bool_or(streak >= {STREAK}) OVER (PARTITION BY job_id ORDER BY seq) AS retired FROM s")
def failure_streaks(spark, sf):
    return op.failure_streaks(_outcomes(spark, sf), STREAK, key=["job_id"])


@query("retired_devices", f"""WITH {STREAKS} SELECT job_id, count(*) FILTER (WHERE outcome = 'fail') AS failures, max(streak) AS longest, min(seq) FILTER (WHERE streak >= {STREAK}) AS retired_at FROM s GROUP BY job_id""")
def retired_devices(spark, sf):
    return op.retired_devices(op.failure_streaks(_outcomes(spark, sf), STREAK, key=["job_id"]), STREAK, key=["job_id"])


@query("bad_windows", f"WITH {STREAKS} SELECT DISTINCT job_id, seq // 10 AS w0 FROM o WHERE outcome = 'fail'")
def bad_windows(spark, sf):
    return op.bad_windows(_outcomes(spark, sf).withColumn("w0", F.floor(F.col("seq") / 10)), ["w0"], ["job_id"])


JOB_EVENTS = {"signup": "create", "click": "analyze", "view": "run", "purchase": "done", "error": "fail"}


@query("job_state", f"""WITH RECURSIVE {v.OBS},
ev AS (SELECT job_id, seq, CASE WHEN value < 3 THEN 'cancel' WHEN value > 200 THEN 'restart' ELSE CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'analyze' WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'done' ELSE 'fail' END END AS e FROM obs),
st AS (
  SELECT DISTINCT job_id, CAST(-1 AS BIGINT) AS seq, 'none' AS s, 0 AS f, 0 AS r FROM ev
  UNION ALL
  SELECT t.job_id, t.seq + 1,
    CASE WHEN e = 'create' AND s = 'none' THEN 'pending' WHEN e = 'analyze' AND s = 'pending' THEN 'analyzing' WHEN e = 'run' AND s = 'analyzing' THEN 'running' WHEN e = 'done' AND s = 'running' THEN CASE WHEN f = 1 THEN 'cancelled' ELSE 'done' END
      WHEN e = 'fail' AND s = 'running' AND f = 1 THEN 'cancelled' WHEN e = 'fail' AND s IN ('analyzing', 'running') THEN CASE WHEN r < 2 THEN 'pending' ELSE 'failed' END
      WHEN e = 'cancel' AND s IN ('pending', 'analyzing') THEN 'cancelled' WHEN e = 'restart' AND s IN ('analyzing', 'running') THEN 'pending' ELSE s END,
    CASE WHEN e = 'fail' AND s IN ('analyzing', 'running') AND NOT (s = 'running' AND f = 1) AND r < 2 THEN 1 WHEN e = 'cancel' AND s = 'running' THEN 1
      WHEN e = 'create' AND s = 'none' OR e = 'analyze' AND s = 'pending' OR e = 'run' AND s = 'analyzing' OR e = 'done' AND s = 'running' OR e IN ('fail', 'restart') AND s IN ('analyzing', 'running') OR e = 'cancel' AND s IN ('pending', 'analyzing') THEN 0 ELSE f END,
    CASE WHEN e = 'fail' AND s IN ('analyzing', 'running') AND NOT (s = 'running' AND f = 1) AND r < 2 THEN r + 1 ELSE r END
  FROM st t JOIN ev ON ev.job_id = t.job_id AND ev.seq = t.seq + 1)
SELECT job_id, max(seq) + 1 AS n_events, arg_max(s, seq) AS status, CASE WHEN arg_max(s, seq) = 'pending' AND arg_max(f, seq) = 1 THEN 'retry' WHEN arg_max(s, seq) = 'running' AND arg_max(f, seq) = 1 THEN 'cancelling'
  WHEN arg_max(s, seq) = 'running' THEN 'encoding' ELSE '' END AS stage, CAST(arg_max(r, seq) AS BIGINT) AS retries FROM st GROUP BY job_id""")
def job_state(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in JOB_EVENTS.items() for x in kv])
    event = F.when(F.col("value") < 3, "cancel").when(F.col("value") > 200, "restart").otherwise(F.try_element_at(names, F.col("event_type")))
    return op.job_state(v.obs(spark, sf).select("job_id", "seq", event.alias("event")), order=["seq"], width=4096)


# the same events with a report of the stage or of progress in between
REPORTS = ["probing", "scenedetect", "encoding"]
RECORDS = v.OBS + f""",
ev AS (SELECT job_id, seq, CASE WHEN seq % 6 = 4 THEN 'stage' WHEN seq % 6 = 5 THEN 'progress' WHEN value < 3 THEN 'cancel' WHEN value > 200 THEN 'restart' ELSE CASE event_type WHEN 'signup' THEN 'create'
  WHEN 'click' THEN 'analyze' WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'done' ELSE 'fail' END END AS e, {REPORTS}[1 + seq % 3] AS told, least(99, floor(value)) AS bar FROM obs),
st AS (
  SELECT DISTINCT job_id, CAST(-1 AS BIGINT) AS seq, 0 AS n, 'none' AS s, 0 AS f, 0 AS r, '' AS g, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z, CAST(NULL AS DOUBLE) AS p FROM ev
  UNION ALL
  SELECT job_id, seq_, n_, s2, f2, r2, CASE WHEN e = 'stage' THEN CASE WHEN s = 'running' AND f = 1 THEN g ELSE told END WHEN (s, f, r) = (s2, f2, r2) THEN g WHEN s2 = 'pending' THEN CASE WHEN f2 = 1 THEN 'retry' ELSE '' END
      WHEN s2 = 'running' THEN CASE WHEN f2 = 1 THEN 'cancelling' ELSE 'encoding' END ELSE s2 END,
    CASE WHEN s2 = 'running' AND s <> 'running' THEN seq_ WHEN s2 = 'pending' AND (s, f, r) <> (s2, f2, r2) THEN NULL ELSE a END,
    CASE WHEN s2 <> s AND s2 IN ('done', 'failed', 'cancelled', 'skipped') THEN seq_ ELSE z END, CASE WHEN e = 'progress' THEN bar ELSE p END
  FROM (SELECT t.*, e, told, bar, t.seq + 1 AS seq_, n + CASE WHEN e IN ('stage', 'progress') THEN 0 ELSE 1 END AS n_,
    CASE WHEN e = 'create' AND s = 'none' THEN 'pending' WHEN e = 'analyze' AND s = 'pending' THEN 'analyzing' WHEN e = 'run' AND s = 'analyzing' THEN 'running'
      WHEN e IN ('done', 'fail') AND s = 'running' AND f = 1 THEN 'cancelled' WHEN e = 'done' AND s = 'running' THEN 'done' WHEN e = 'fail' AND s IN ('analyzing', 'running') THEN CASE WHEN r < 2 THEN 'pending' ELSE 'failed' END
      WHEN e = 'cancel' AND s IN ('pending', 'analyzing') THEN 'cancelled' WHEN e = 'restart' AND s IN ('analyzing', 'running') THEN 'pending' ELSE s END AS s2,
    CASE WHEN e = 'fail' AND s IN ('analyzing', 'running') AND NOT (s = 'running' AND f = 1) AND r < 2 OR e = 'cancel' AND s = 'running' THEN 1
      WHEN e = 'create' AND s = 'none' OR e = 'analyze' AND s = 'pending' OR e = 'run' AND s = 'analyzing' OR e = 'done' AND s = 'running' OR e IN ('fail', 'restart') AND s IN ('analyzing', 'running') OR e = 'cancel' AND s IN ('pending', 'analyzing') THEN 0 ELSE f END AS f2,
    CASE WHEN e = 'fail' AND s IN ('analyzing', 'running') AND NOT (s = 'running' AND f = 1) AND r < 2 THEN r + 1 ELSE r END AS r2
    FROM st t JOIN ev ON ev.job_id = t.job_id AND ev.seq = t.seq + 1))"""


@v.written
def _record_events(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in JOB_EVENTS.items() for x in kv])
    report = F.when(F.col("seq") % 6 == 4, "stage").when(F.col("seq") % 6 == 5, "progress")
    event = F.when(F.col("value") < 3, "cancel").when(F.col("value") > 200, "restart").otherwise(F.try_element_at(names, F.col("event_type")))
    bar = report == "progress"
    return v.obs(spark, sf).select(
        "job_id", F.col("seq").cast("double").alias("ts"), F.coalesce(report, event).alias("event"),
        F.when(report == "stage", F.get(F.array(*[F.lit(x) for x in REPORTS]), (F.col("seq") % 3).cast("int"))).alias("stage"),
        F.when(bar, F.least(F.lit(99.0), F.floor("value").cast("double"))).alias("pct"), F.when(bar, F.floor("value")).alias("done"),
        F.when(bar, F.lit(1200).cast("long")).alias("total"), F.when(bar, F.lit(12.5)).alias("fps"))


@query("job_record", f"""WITH RECURSIVE {RECORDS}
SELECT job_id, CAST(arg_max(n, seq) AS BIGINT) AS n_events, arg_max(s, seq) AS status, arg_max(g, seq) AS stage, CAST(arg_max(r, seq) AS BIGINT) AS retries, CAST(arg_max_null(a, seq) AS DOUBLE) AS started_at,
  CAST(arg_max_null(z, seq) AS DOUBLE) AS finished_at, CASE WHEN arg_max(s, seq) = 'done' THEN 100.0 ELSE arg_max_null(p, seq) END AS progress FROM st GROUP BY job_id""")
def job_record(spark, sf):
    rows = op.job_record(_record_events(spark, sf))
    return rows.select("job_id", "n_events", "status", "stage", "retries", "started_at", "finished_at", "progress")


# progress lines from events: markers for sign-ups, clicks and errors, bars for the rest
LINES = v.OBS + """,
lines AS (SELECT job_id, seq AS pos, CASE event_type WHEN 'signup' THEN 'scenedetect' WHEN 'click' THEN 'probing' WHEN 'error' THEN 'encoding' END AS mark,
  CASE WHEN event_type IN ('view', 'purchase') THEN least(100, floor(value)) END AS pct, CASE WHEN event_type IN ('view', 'purchase') THEN floor(value) END AS done,
  CASE WHEN event_type = 'view' THEN 12.5 ELSE 0.0 END AS fps FROM obs)"""


@v.written
def _lines(spark, sf):
    e, n = F.col("event_type"), F.floor("value")
    bar = F.format_string("00:01 [1/5 Chunks] ▐ %d%% %d/9999 (%s fps, eta 5s)", F.least(F.lit(100), n), n, F.when(e == "view", "12.5").otherwise("0.0"))
    text = F.when(e == "signup", "Scene detection").when(e == "click", "scenecut: found 4 scene(s)").when(e == "error", "Queue 5 Workers 2").otherwise(bar)
    return v.obs(spark, sf).select("job_id", F.col("seq").alias("pos"), text.alias("text"))


@query("progress_track", f"""WITH {LINES},
a AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM lines),
b AS (SELECT *, coalesce(mark, CASE WHEN was = 'probing' AND pct IS NOT NULL AND fps > 0 THEN 'encoding' END) AS step FROM a),
c AS (SELECT *, last_value(step IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY pos) AS stage FROM b),
d AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY pos) AS was_stage, last_value(done IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c),
f AS (SELECT *, count(*) FILTER (WHERE was_stage IS DISTINCT FROM stage OR done < seen) OVER (PARTITION BY job_id ORDER BY pos) AS seg FROM d),
g AS (SELECT *, max(pct) OVER (PARTITION BY job_id, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f)
SELECT job_id, pos, stage, CAST(pct AS DOUBLE) AS pct, CAST(done AS BIGINT) AS done, CAST(9999 AS BIGINT) AS total, CAST(fps AS DOUBLE) AS fps, pct > coalesce(top, -1) AS reported FROM g WHERE pct IS NOT NULL""")
def progress_track(spark, sf):
    return op.progress_track(_lines(spark, sf))


@query("silences", """WITH g AS (SELECT event_id, user_id AS job_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS d FROM events)
SELECT event_id, job_id, round(d, 3) AS silence_s FROM g WHERE d > 36000""")
def silences(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), "ts")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return op.silences(rows, order=["ts", "event_id"], limit=36000).select("event_id", "job_id", F.round("silence_s", 3).alias("silence_s"))


@query("tail_incremental", f"""WITH {v.OBS}, since AS (SELECT DISTINCT user_id AS job_id, user_id % 30 AS since FROM events), kept AS (SELECT * FROM obs WHERE seq >= job_id % 20),
f AS (SELECT job_id, min(seq) AS lo FROM kept GROUP BY job_id)
SELECT k.job_id, k.seq AS line_no, greatest(0, greatest(since, lo) - since) AS lost FROM kept k JOIN f USING (job_id) JOIN since USING (job_id) WHERE k.seq >= greatest(since, lo)""")
def tail_incremental(spark, sf):
    rows = v.obs(spark, sf).select("job_id", F.col("seq").alias("line_no"))
    since = rows.select("job_id").distinct().withColumn("since", F.col("job_id") % 30)
    return op.tail_incremental(rows.filter(F.col("line_no") >= F.col("job_id") % 20), since)
