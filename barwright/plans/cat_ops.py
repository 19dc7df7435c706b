"""Operations and streaming queries (survey 2.4 parts, 2.12)."""

from pyspark.sql import functions as F

from barwright.functions.rolling import KEY
from barwright.operators import calendar as cal
from barwright.operators import ops
from barwright.plans.oracle import define
from barwright.plans.registry import query
from barwright.session import work_folder
from barwright.plans.cat_sources import stored_live
from barwright.streaming import alerts, dedupe, health, quotes, store

NOW = "2024-01-30 23:59:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


_SQLNOW = f"TIMESTAMP '{NOW}'"


@query(
    "agg_17_task_health",
    "task_name s, runs i, failures i, failure_rate f, avg_duration_seconds f, latest_status s, latest_started_at t, latest_error s",
    f"""
SELECT task_name, count(*) AS runs, count(*) FILTER (status = 'failure') AS failures, round_even(count(*) FILTER (status = 'failure') / count(*), 3) AS failure_rate,
  round_even(avg(epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6), 2) AS avg_duration_seconds, arg_max(status, (started_at, run_id)) AS latest_status, max(started_at) AS latest_started_at,
  CASE WHEN arg_max(status, (started_at, run_id)) = 'failure' THEN arg_max(error, (started_at, run_id)) ELSE '' END AS latest_error
FROM task_runs WHERE started_at >= {_SQLNOW} - INTERVAL 7 DAY GROUP BY task_name""",
    "task_runs",
)
def _(m):
    return ops.task_health(m.task_runs, _now())


_TNOW = "TIMESTAMP '2001-06-30 00:00:00'"


def _tnow():
    return F.lit("2001-06-30 00:00:00").cast("timestamp_ntz")


@query(
    "agg_19_ticket_dashboard",
    "new_count i, awaiting_review i, urgent i, bugs i, feature_requests i, data_prediction i, in_progress i, recently_resolved i, avg_review_hours f",
    f"""
SELECT count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status IN ('new', 'under_review')) AS awaiting_review, count(*) FILTER (reporter_priority = 'urgent' AND status <> 'resolved') AS urgent,
  count(*) FILTER (category = 'bug' AND status <> 'resolved') AS bugs, count(*) FILTER (category = 'feature_request' AND status <> 'resolved') AS feature_requests,
  count(*) FILTER (category IN ('data_issue', 'prediction_issue') AND status <> 'resolved') AS data_prediction, count(*) FILTER (status = 'in_progress') AS in_progress,
  count(*) FILTER (status = 'resolved' AND resolved_at >= {_TNOW} - INTERVAL 14 DAY) AS recently_resolved,
  round_even(avg(epoch_us(reviewed_at) / 1e6 - epoch_us(created_at) / 1e6) / 3600, 1) AS avg_review_hours FROM tickets""",
    "tickets",
)
def _(m):
    return ops.ticket_dashboard(m.tickets, _tnow())


@query("agg_19_ticket_volume", "day d, tickets i", f"SELECT CAST(created_at AS DATE) AS day, count(*) AS tickets FROM tickets WHERE created_at >= {_TNOW} - INTERVAL 30 DAY GROUP BY 1", "tickets")
def _(m):
    return ops.ticket_volume(m.tickets, _tnow())


@query("agg_19_top_pages", "page_path s, tickets i", "SELECT page_path, count(*) AS tickets FROM tickets WHERE page_path <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "tickets")
def _(m):
    return ops.top_pages(m.tickets)


ALERT = "key s, severity s, message s"
define(
    "stale_alerts", "bars",
    """
SELECT 'stale_data_' || e AS key, CASE WHEN age IS NULL THEN 'critical' WHEN age <= 8 THEN 'warning' ELSE 'critical' END AS severity,
  CASE WHEN age IS NULL THEN e || ': no price data on record at all.' ELSE format('{}: latest price data is {:d} days old (threshold 4).', e, age) END AS message
FROM (SELECT e, DATE '2001-11-10' - latest AS age FROM (SELECT unnest(['DSE', 'CSE', 'XSE']) AS e) LEFT JOIN (SELECT exchange, max(date) AS latest FROM bars GROUP BY 1) ON exchange = e) WHERE age IS NULL OR age > 4
UNION ALL
SELECT 'stale_analysis', CASE WHEN age <= 8 THEN 'warning' ELSE 'critical' END, format('Latest analysis is {:d} days old (threshold 4).', age) FROM (SELECT DATE '2001-11-10' - max(date) AS age FROM bars) WHERE age > 4""",
)


def _stale(m):
    day = F.lit("2001-11-10").cast("date")
    analysed = m.bars.groupBy(*KEY).agg(F.max("date").alias("as_of"))
    return ops.stale_price_alerts(m.bars, ["DSE", "CSE", "XSE"], day).unionByName(ops.stale_analysis_alerts(analysed, day))


@query("ops_01_stale_data_alerts", ALERT, "SELECT * FROM stale_alerts", "stale_alerts")
def _(m):
    return _stale(m)


define(
    "fail_alerts", "task_runs",
    """
SELECT 'repeated_failure_' || task_name AS key, 'critical' AS severity, task_name || ': last 3 runs all failed.' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY started_at DESC, run_id DESC) AS r FROM task_runs) WHERE r <= 3 GROUP BY task_name HAVING count(*) = 3 AND bool_and(status = 'failure')""",
)


@query("ops_02_repeated_failures", ALERT, "SELECT * FROM fail_alerts", "fail_alerts")
def _(m):
    return ops.repeated_failures(m.task_runs)


define(
    "silent_alerts", "task_runs",
    f"""
SELECT 'silent_sync_failure_' || task_name AS key, 'critical' AS severity, task_name || ': a recent run reported ''success'' but its own result recorded an error: ' || e AS message
FROM (SELECT task_name, arg_max(status, (started_at, run_id)) AS s, arg_max({{'e': embedded_error}}, (started_at, run_id)).e AS e FROM task_runs WHERE started_at >= {_SQLNOW} - INTERVAL 720 HOUR GROUP BY task_name) WHERE s = 'success' AND e IS NOT NULL""",
)


@query("ops_03_silent_failures", ALERT, "SELECT * FROM silent_alerts", "silent_alerts")
def _(m):
    return ops.silent_failures(m.task_runs, _now(), 720)


define(
    "flight_alerts", "task_runs",
    f"""
SELECT 'job_overlap_' || task_name AS key, 'warning' AS severity, format('{{}}: {{:d}} runs currently in-flight at once.', task_name, count(*)) AS message FROM task_runs WHERE status = 'started' GROUP BY task_name HAVING count(*) > 1
UNION ALL
SELECT 'stuck_job_' || task_name, 'critical', format('{{}}: run #{{:d}} has been ''started'' for over 20 minutes without finishing.', task_name, arg_min(run_id, (started_at, run_id)))
FROM task_runs WHERE status = 'started' AND started_at < {_SQLNOW} - INTERVAL 20 MINUTE GROUP BY task_name""",
)


@query("ops_04_overlap_and_stuck", ALERT, "SELECT * FROM flight_alerts", "flight_alerts")
def _(m):
    return ops.overlap_alerts(m.task_runs).unionByName(ops.stuck_alerts(m.task_runs, _now()))


def _event_calendar(m):
    return cal.calendar(cal.span_of(m.table("events").select(F.to_date("ts")), slack=20), m.holidays)


@query(
    "ops_05_missing_daily_append", "date d, key s",
    """
SELECT d AS date, 'missing_daily_append_' || d AS key FROM (SELECT CAST(unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP), CAST(max(CAST(ts AS DATE)) + 20 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM events)
WHERE dayofweek(d) NOT IN (5, 6) AND d NOT IN (SELECT CAST(started_at AS DATE) FROM task_runs WHERE task_name = 'task_3' AND status = 'success')""",
    "task_runs",
)
def _(m):
    return ops.missing_sessions(_event_calendar(m), m.task_runs, "task_3")


@query(
    "ops_05_absent_heartbeat", "event_id i, ts t",
    """
SELECT event_id, ts FROM events e WHERE dayofweek(ts) NOT IN (5, 6) AND hour(ts) * 60 + minute(ts) BETWEEN 600 AND 869
AND NOT EXISTS (SELECT 1 FROM task_runs r WHERE r.task_name = 'task_3' AND r.started_at >= e.ts - INTERVAL 10 MINUTE AND r.started_at <= e.ts)""",
    "task_runs",
)
def _(m):
    checks = cal.session_status(m.table("events").select("event_id", "ts"), _event_calendar(m))
    return ops.absent_heartbeats(checks.select("event_id", "ts", "is_open"), m.task_runs, "task_3")


define(
    "model_alerts", "bars",
    """
SELECT 'model_degraded_' || exchange AS key, 'warning' AS severity, format('{}: skill vs. naive is {:.4f} over {:d} forecasts (not positive).', exchange, skill, n) AS message
FROM (SELECT exchange, round_even(1 - avg(abs(p - a)) / avg(abs(a)), 4) AS skill, count(*) AS n FROM (
  SELECT exchange, close / lag(close) OVER w - 1 AS p, lead(close) OVER w / close - 1 AS a FROM bars WINDOW w AS (PARTITION BY exchange, symbol ORDER BY date)) WHERE p IS NOT NULL AND a IS NOT NULL GROUP BY exchange) WHERE skill <= 0""",
)


def _models(m):
    from barwright.functions.rolling import ahead, change, history

    w = history()
    df = m.bars.select("exchange", change(F.col("close"), w).alias("p"), ahead(F.col("close"), w).alias("a")).dropna()
    skill = F.bround(F.lit(1.0) - F.avg(F.abs(F.col("p") - F.col("a"))) / F.avg(F.abs("a")), 4)
    return df.groupBy(F.col("exchange").alias("name")).agg(skill.alias("skill_vs_naive"), F.count(F.lit(1)).alias("n")).withColumns(
        {"deployed": F.lit(True), "min_n": F.lit(30)}
    )


# the daily report of a day is the last run of task_7 on it
define(
    "report_alerts", "task_runs",
    """
SELECT 'report_repeated_failure' AS key, 'critical' AS severity, format('The daily report failed on its last 3 dates in a row ({} to {}).', min(d), max(d)) AS message
FROM (SELECT CAST(started_at AS DATE) AS d, arg_max(status, (started_at, run_id)) AS s FROM task_runs WHERE task_name = 'task_7' GROUP BY d ORDER BY d DESC LIMIT 3)
HAVING count(*) = 3 AND bool_and(s = 'failure')""",
)


def _reports(m):
    runs = m.task_runs.filter(F.col("task_name") == "task_7")
    return runs.groupBy(F.to_date("started_at").alias("report_date")).agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))


@query(
    "ops_06_all_alerts", f"{ALERT}, severity_rank i",
    "SELECT *, CASE severity WHEN 'critical' THEN 0 ELSE 1 END AS severity_rank FROM (SELECT * FROM stale_alerts UNION ALL SELECT * FROM fail_alerts UNION ALL SELECT * FROM silent_alerts UNION ALL SELECT * FROM flight_alerts UNION ALL SELECT * FROM model_alerts UNION ALL SELECT * FROM report_alerts)",
    "stale_alerts fail_alerts silent_alerts flight_alerts model_alerts report_alerts",
)
def _(m):
    runs = m.task_runs
    return ops.all_alerts(
        [
            _stale(m), ops.repeated_failures(runs), ops.silent_failures(runs, _now(), 720),
            ops.overlap_alerts(runs), ops.stuck_alerts(runs, _now()), ops.model_alerts(_models(m)), ops.report_failures(_reports(m)),
        ]
    )


@query(
    "ops_07_reconciled_orphans", "run_id i, task_name s, status s, finished_at t, reconciled b",
    f"""
SELECT run_id, task_name, CASE WHEN o THEN 'failure' ELSE status END AS status, CASE WHEN o THEN {_SQLNOW} ELSE finished_at END AS finished_at, o AS reconciled
FROM (SELECT *, status = 'started' AND epoch_us({_SQLNOW}) / 1e6 - epoch_us(started_at) / 1e6 >= CASE WHEN task_name = 'task_1' THEN 1728000 ELSE 600 END + 120 AS o FROM task_runs)""",
    "task_runs",
)
def _(m):
    return ops.reconcile_orphans(m.task_runs, _now(), {"task_1": 1728000})


# ------------------------------------------------------------------ streams


def _streamed(m, table_schema_from):
    """The events table as a file stream (copied nowhere, read in place)."""
    schema = table_schema_from.schema
    return m.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(m.folder)


def _quote_stream(m):
    from barwright.sources.adapters import Market

    stream = _streamed(m, m.table("events"))

    class Streamed(Market):
        def table(self, name):
            return stream if name == "events" else super().table(name)

    return Streamed(m.spark, m.folder)


@query("str_01_streamed_daily_bars", "symbol s, date d, open f, high f, low f, close f, volume i", "SELECT symbol, CAST(ts AS DATE) AS date, arg_min(coalesce(nullif(open, 0), ltp), (ts, event_id)) AS open, max(greatest(coalesce(high, ltp), ltp)) AS high, min(least(coalesce(low, ltp), ltp)) AS low, arg_max(ltp, (ts, event_id)) AS close, arg_max(volume, (ts, event_id)) AS volume FROM quotes WHERE ltp > 0 GROUP BY ALL", "quotes")
def _(m):
    folder = work_folder(m.spark, "stream")
    quotes.run_available(_quote_stream(m).quotes, f"{folder}/bars", f"{folder}/checkpoint")
    return quotes.read_upserted(m.spark, f"{folder}/bars")


define(
    "health_walk", "task_runs",
    """
SELECT task_name, count(*) AS runs, max(started_at) AS last_run, list(status ORDER BY started_at, run_id) AS s FROM task_runs WHERE status <> 'started' GROUP BY task_name""",
)
define(
    "health_state", "health_walk",
    """
SELECT task_name, runs, last_run, tail AS consecutive_failures, CASE WHEN tail >= 3 THEN 'unhealthy' ELSE 'healthy' END AS health,
  CASE WHEN tail >= 3 THEN 'failure_pending' WHEN contains(word, 'fff') THEN 'recovery_pending' ELSE 'none' END AS alert_state
FROM (SELECT *, len(word) - len(rtrim(word, 'f')) AS tail FROM (SELECT *, array_to_string(list_transform(s, lambda x: CASE WHEN x = 'failure' THEN 'f' ELSE 'o' END), '') AS word FROM health_walk))""",
)
HEALTH = "task_name s, runs i, last_run t, consecutive_failures i, health s, alert_state s"


@query("str_02_task_health_batch", HEALTH, "SELECT * FROM health_state", "health_state")
def _(m):
    return ops.health_states(m.task_runs)


@query("str_02_task_health_stream", HEALTH, "SELECT * FROM health_state", "health_state")
def _(m):
    folder = work_folder(m.spark, "stream")
    runs = _quote_stream(m).task_runs.withColumn("started_at", F.col("started_at").cast("timestamp"))
    states = health.task_health(runs)

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id:012d}")

    q = (
        states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = m.spark.read.parquet(f"{folder}/out/batch=*")
    rest = [c for c in out.columns if c not in ("task_name", "batch_id")]
    return out.groupBy("task_name").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("task_name", "r.*")


def _flight_events(runs):
    return runs.select("task_name", "run_id", "status", "started_at", F.coalesce("finished_at", "started_at").alias("at"))


@query(
    "ops_04_stuck_runs_stream", "task_name s, run_id i, started_at t, stuck_at t",
    """
SELECT task_name, run_id, started_at, started_at + INTERVAL 20 MINUTE AS stuck_at FROM task_runs, (SELECT max(coalesce(finished_at, started_at)) AS newest FROM task_runs)
WHERE status = 'started' AND epoch_ms(started_at) + 1200000 < epoch_ms(newest) - 300000""",
    "task_runs",
)
def _(m):
    return _streamed_alerts(m, health.stuck_runs(_flight_events(_quote_stream(m).task_runs)))


@query(
    "str_01_stream_into_stored_bars", f"{', '.join(f'{c} s' for c in KEY)}, date d, open f, high f, low f, close f, volume i, source s",
    """
SELECT 'DSE' AS exchange, n.symbol, n.date, coalesce(nullif(o.open, 0), n.open) AS open, CASE WHEN o.date IS NULL THEN n.high ELSE greatest(o.high, n.high, n.close) END AS high,
  CASE WHEN o.date IS NULL THEN n.low ELSE least(o.low, n.low, n.close) END AS low, n.close, n.volume, 'dse_live' AS source
FROM daybars n LEFT JOIN stored_live o ON o.symbol = n.symbol AND o.date = n.date""",
    "daybars stored_live",
)
def _(m):
    folder = work_folder(m.spark, "stream")
    sessions = cal.calendar(cal.span_of(m.quotes.select(F.to_date("ts")), slack=1), m.holidays).filter("is_session").select("date")
    live = lambda df: df.join(sessions, "date", "left_semi").select(F.lit("DSE").alias("exchange"), "*", F.lit(0.0).alias("value"), F.lit("dse_live").alias("source"))
    store.create(stored_live(m), folder)
    store.drain(quotes.daily_bars(_quote_stream(m).quotes), folder, f"{folder}/checkpoint", live)
    return store.read(m.spark, folder)


def alert_observations(m, quoted=None):
    """Twelve rules per symbol class, met with the quote events."""
    r = m.quotes.select("symbol").distinct().select(
        "symbol", F.explode(F.array(*[F.lit(x) for x in ("target_price", "percent_move", "signal_change", "confidence")])).alias("rule_type")
    )
    no = F.regexp_extract("symbol", r"(\d+)", 1).cast("long")
    kind = F.when(F.col("rule_type") == "target_price", 0).when(F.col("rule_type") == "percent_move", 1).when(F.col("rule_type") == "signal_change", 2).otherwise(3)
    rules = r.select(
        (no * 4 + kind).alias("rule_id"), "symbol", "rule_type", F.lit(120.0).alias("target_price"), F.lit(60.0).alias("threshold_pct"),
        F.lit(70.0).alias("min_confidence"), (no % 5 != 4).alias("is_active"),
    )
    action = F.when(F.col("ltp") > 80, "BUY").when(F.col("ltp") < 5, "SELL").otherwise("HOLD")
    facts = (m.quotes if quoted is None else quoted).select(
        "symbol", F.col("event_id").alias("seq"), "ts", F.col("ltp").alias("price"), (F.col("ltp") - 40.0).alias("change_pct"), action.alias("action"),
        (F.col("volume") / 1000.0).alias("confidence"),
    )
    return alerts.observations(rules, facts)


define(
    "obs", "quotes",
    """
SELECT no * 4 + kind AS rule_id, kind, seq, ts, action, CASE kind WHEN 0 THEN ltp >= 120 WHEN 1 THEN abs(ltp - 40) >= 60 WHEN 3 THEN volume / 1000 * 100 >= 70 ELSE false END AS hit
FROM (SELECT CAST(symbol[2:] AS BIGINT) AS no, event_id AS seq, ts, ltp, volume, CASE WHEN ltp > 80 THEN 'BUY' WHEN ltp < 5 THEN 'SELL' ELSE 'HOLD' END AS action FROM quotes), (SELECT unnest([0, 1, 2, 3]) AS kind)
WHERE no % 5 <> 4""",
)
define("obs_n", "obs", "SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, seq) AS rn FROM obs")
define(
    "alert_walk", "obs_n",
    """
SELECT rule_id, rn, kind, ts, hit AS fires, CASE WHEN hit THEN ts END AS last_at, CASE WHEN kind = 2 THEN action END AS sig FROM obs_n WHERE rn = 1
UNION ALL
SELECT o.rule_id, o.rn, o.kind, o.ts, fire, CASE WHEN fire THEN o.ts ELSE w.last_at END, CASE WHEN o.kind = 2 AND NOT cool THEN o.action ELSE w.sig END
FROM alert_walk w JOIN obs_n o ON o.rule_id = w.rule_id AND o.rn = w.rn + 1,
LATERAL (SELECT coalesce(o.ts - w.last_at < INTERVAL 4 HOUR, false) AS cool), LATERAL (SELECT NOT cool AND CASE WHEN o.kind = 2 THEN w.sig IS NOT NULL AND o.action <> w.sig ELSE o.hit END AS fire)""",
)


@query("str_03_alert_rules", "rule_id i, ts t, kind s", "SELECT rule_id, ts, (['target_price', 'percent_move', 'signal_change', 'confidence'])[kind + 1] AS kind FROM alert_walk WHERE fires", "alert_walk")
def _(m):
    return alerts.evaluate_batch(alert_observations(m))


def _streamed_alerts(m, frame):
    """Rows of a streaming table, each micro-batch in a folder of its own, so that a repeated one replaces itself."""
    folder = work_folder(m.spark, "stream")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id:012d}")

    q = frame.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return m.spark.read.parquet(f"{folder}/out/batch=*")


@query("str_03_alert_rules_stream", "rule_id i, ts t, kind s", "SELECT rule_id, ts, (['target_price', 'percent_move', 'signal_change', 'confidence'])[kind + 1] AS kind FROM alert_walk WHERE fires", "alert_walk")
def _(m):
    live = _quote_stream(m).quotes
    return _streamed_alerts(m, alerts.evaluate_stream(alert_observations(m, live)))


@query(
    "str_04_once_per_day_stream", "title s, day d",
    "SELECT DISTINCT 'Alert: ' || event_type || ' ' || (user_id % 10) AS title, CAST(ts AS DATE) AS day FROM events",
)
def _(m):
    title = F.concat(F.lit("Alert: "), "event_type", F.lit(" "), (F.col("user_id") % 10).cast("string")).alias("title")
    e = _streamed(m, m.table("events")).select(title, "ts", F.col("event_id").alias("alert_id"))
    return _streamed_alerts(m, dedupe.once_per_day_stream(e)).select("title", "day")


@query(
    "str_04_once_per_day", "title s, day d, alert_id i",
    """
SELECT title, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS alert_id FROM (SELECT *, 'Alert: ' || event_type || ' ' || (user_id % 10) AS title FROM events)
WHERE NOT (event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-10') GROUP BY title, CAST(ts AS DATE)""",
)
def _(m):
    e = m.table("events").select(
        F.concat(F.lit("Alert: "), "event_type", F.lit(" "), (F.col("user_id") % 10).cast("string")).alias("title"), "ts", F.col("event_id").alias("alert_id"), "event_type"
    )
    sent = e.filter((F.col("event_type") == "click") & (F.to_date("ts") == F.lit("2024-01-10").cast("date"))).select("title", F.to_date("ts").alias("day")).distinct()
    return dedupe.once_per_day(e.drop("event_type"), sent)
