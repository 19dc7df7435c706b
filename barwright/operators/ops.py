"""Operations facts and alerts over task runs, tickets and table freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.operators.listing import latest_by, top_per_group

def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_micros(b.cast("timestamp")) / 1e6 - F.unix_micros(a.cast("timestamp")) / 1e6


def task_health(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Runs, failures, mean duration and latest outcome per task."""
    df = runs.filter(F.col("started_at") >= now - F.make_dt_interval(F.lit(days)))
    newest = F.max_by(F.struct("status", "error"), F.struct("started_at", "run_id"))
    failed = F.count_if(F.col("status") == "failure")
    return df.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("runs"), failed.alias("failures"), F.bround(failed / F.count(F.lit(1)), 3).alias("failure_rate"),
        F.bround(F.avg(seconds_between(F.col("started_at"), F.col("finished_at"))), 2).alias("avg_duration_seconds"),
        newest["status"].alias("latest_status"), F.max("started_at").alias("latest_started_at"),
        F.when(newest["status"] == "failure", F.substring(newest["error"], 1, 300)).otherwise("").alias("latest_error"),
    )


def ticket_dashboard(tickets: DataFrame, now: Column) -> DataFrame:
    """Headline counts of the ticket queue."""
    s, c = F.col("status"), F.col("category")
    opened = ~s.isin("resolved", "implemented", "closed", "rejected", "duplicate")
    hours = F.avg(seconds_between(F.col("created_at"), F.col("reviewed_at"))) / 3600.0
    return tickets.agg(
        F.count_if(s == "new").alias("new_count"),
        F.count_if(s.isin("new", "under_review")).alias("awaiting_review"),
        F.count_if((F.col("reporter_priority") == "urgent") & opened).alias("urgent"),
        F.count_if((c == "bug") & opened).alias("bugs"),
        F.count_if((c == "feature_request") & opened).alias("feature_requests"),
        F.count_if(c.isin("data_issue", "prediction_issue") & opened).alias("data_prediction"),
        F.count_if(s == "in_progress").alias("in_progress"),
        F.count_if(s.isin("implemented", "resolved") & (F.col("resolved_at") >= now - F.make_dt_interval(F.lit(14)))).alias("recently_resolved"),
        F.bround(hours, 1).alias("avg_review_hours"),
    )


def ticket_volume(tickets: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = tickets.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("tickets"))


def top_pages(tickets: DataFrame, n: int = 10) -> DataFrame:
    pages = tickets.filter(F.col("page_path") != "").groupBy("page_path").agg(F.count(F.lit(1)).alias("tickets"))
    return pages.orderBy(F.desc("tickets"), "page_path").limit(n)


def _alert(df: DataFrame, key: Column, severity: Column, message: Column) -> DataFrame:
    return df.select(key.alias("key"), severity.alias("severity"), message.alias("message"))


def _staleness(age: Column) -> Column:
    return F.when(age.isNull(), "critical").when(age <= fixed.STALE_DATA_DAYS * 2, "warning").otherwise("critical")


def stale_price_alerts(bars: DataFrame, exchanges: list[str], today: Column) -> DataFrame:
    """Exchanges without data or whose newest bar is more than four days old."""
    spark = bars.sparkSession
    wanted = spark.createDataFrame([(e,) for e in exchanges], "exchange string")
    last = bars.groupBy("exchange").agg(F.max("date").alias("latest"))
    df = wanted.join(last, "exchange", "left").withColumn("age", F.date_diff(today, F.col("latest")))
    df = df.filter(F.col("age").isNull() | (F.col("age") > fixed.STALE_DATA_DAYS))
    # fixed values: texts a user sees
    text = F.when(F.col("age").isNull(), F.concat("exchange", F.lit(": no price data on record at all."))).otherwise(
        F.format_string("%s: latest price data is %d days old (threshold %d).", "exchange", "age", F.lit(fixed.STALE_DATA_DAYS))
    )
    return _alert(df, F.concat(F.lit("stale_data_"), "exchange"), _staleness(F.col("age")), text)


def stale_analysis_alerts(analysis: DataFrame, today: Column) -> DataFrame:
    df = analysis.agg(F.max("as_of").alias("latest")).withColumn("age", F.date_diff(today, F.col("latest")))
    df = df.filter(F.col("age").isNull() | (F.col("age") > fixed.STALE_DATA_DAYS))
    # fixed values: texts a user sees
    text = F.when(F.col("age").isNull(), "No analysis rows exist at all.").otherwise(
        F.format_string("Latest analysis is %d days old (threshold %d).", "age", F.lit(fixed.STALE_DATA_DAYS))
    )
    return _alert(df, F.lit("stale_analysis"), _staleness(F.col("age")), text)


def repeated_failures(runs: DataFrame, streak: int = 3) -> DataFrame:
    """Tasks whose last runs all failed."""
    last = top_per_group(runs.select("task_name", "status", "started_at", "run_id"), ["task_name"], [F.desc("started_at"), F.desc("run_id")], streak)
    bad = last.groupBy("task_name").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "failure").alias("all_failed"))
    bad = bad.filter((F.col("n") == streak) & F.col("all_failed"))
    return _alert(
        bad, F.concat(F.lit("repeated_failure_"), "task_name"), F.lit("critical"),
        F.format_string("%s: last %d runs all failed.", "task_name", F.lit(streak)),
    )


def report_failures(reports: DataFrame, streak: int = 3) -> DataFrame:
    """One alert when the newest reports of `streak` days all failed. reports: report_date, status (one a day)."""
    last = reports.orderBy(F.desc("report_date")).limit(streak)
    bad = last.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "failure").alias("all_failed"), F.min("report_date").alias("a"), F.max("report_date").alias("b")
    ).filter((F.col("n") == streak) & F.col("all_failed"))
    return _alert(
        bad, F.lit("report_repeated_failure"), F.lit("critical"),
        F.format_string("The daily report failed on its last %d dates in a row (%s to %s).", F.lit(streak), F.col("a").cast("string"), F.col("b").cast("string")),
    )


def embedded_error(detail: Column) -> Column:
    """First error a successful run's own result carries, at any known depth."""
    found = []
    for prefix in ("", "dse.", "cse.", "live.", "analysis.", "dse.live.", "cse.live."):
        ok, err = F.get_json_object(detail, f"$.{prefix}ok"), F.get_json_object(detail, f"$.{prefix}error")
        found.append(F.when((ok == "false") & (err != ""), err))
        found.append(F.nullif(F.get_json_object(detail, f"$.{prefix}last_error"), F.lit("")))
    return F.coalesce(*found)


def silent_failures(runs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Latest recent run says success but its result holds an error."""
    recent = runs.filter(F.col("started_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    last = latest_by(recent.select("task_name", "status", "detail", "started_at", "run_id"), ["task_name"], "started_at", "run_id")
    bad = last.filter(F.col("status") == "success").withColumn("e", embedded_error(F.col("detail"))).filter(F.col("e").isNotNull())
    return _alert(
        bad, F.concat(F.lit("silent_sync_failure_"), "task_name"), F.lit("critical"),
        F.concat("task_name", F.lit(": a recent run reported 'success' but its own result recorded an error: "), F.substring("e", 1, 200)),
    )


def overlap_alerts(runs: DataFrame) -> DataFrame:
    n = runs.filter(F.col("status") == "started").groupBy("task_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _alert(
        n, F.concat(F.lit("job_overlap_"), "task_name"), F.lit("warning"), F.format_string("%s: %d runs currently in-flight at once.", "task_name", "n")
    )


def stuck_alerts(runs: DataFrame, now: Column) -> DataFrame:
    late = runs.filter((F.col("status") == "started") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(fixed.STUCK_JOB_MINUTES))))
    first = late.groupBy("task_name").agg(F.min_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return _alert(
        first, F.concat(F.lit("stuck_job_"), "task_name"), F.lit("critical"),
        F.format_string("%s: run #%d has been 'started' for over %d minutes without finishing.", "task_name", "run_id", F.lit(fixed.STUCK_JOB_MINUTES)),
    )


def missing_sessions(cal: DataFrame, runs: DataFrame, task: str) -> DataFrame:
    """Sessions of the calendar without a successful run of a task."""
    done = runs.filter((F.col("task_name") == task) & (F.col("status") == "success")).select(F.to_date("started_at").alias("date")).distinct()
    df = cal.filter("is_session").select("date").join(done, "date", "left_anti")
    return df.withColumn("key", F.concat(F.lit("missing_daily_append_"), F.col("date").cast("string")))


def absent_heartbeats(checks: DataFrame, runs: DataFrame, task: str, minutes: int = 10) -> DataFrame:
    """Check moments in market hours with no run of a task in the minutes before.

    Runs are put in buckets of the look-back length so that a check only meets
    the runs of its own and the previous bucket, by equality.
    """
    size = minutes * 60
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / size)
    beats = runs.filter(F.col("task_name") == task).select(F.col("started_at").alias("beat"), bucket(F.col("started_at")).alias("b")).groupBy("b").agg(
        F.min("beat").alias("first_beat"), F.max("beat").alias("last_beat")
    )
    asked = checks.filter("is_open").withColumn("b", F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) - 1)))
    start = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    # a run strictly inside the bucket of the check may lie after it; the older
    # bucket matters by its last run, the newer one by its first
    alive = ((F.col("last_beat") >= start) & (F.col("last_beat") <= F.col("ts"))) | ((F.col("first_beat") >= start) & (F.col("first_beat") <= F.col("ts")))
    hit = asked.join(beats, "b").filter(alive).select("event_id").distinct()
    return checks.filter("is_open").join(hit, "event_id", "left_anti")


def model_alerts(models: DataFrame) -> DataFrame:
    """models: name, deployed, skill_vs_naive, n, min_n."""
    bad = models.filter(F.col("deployed") & (F.col("n") >= F.col("min_n")) & (F.coalesce("skill_vs_naive", F.lit(0.0)) <= 0))
    return _alert(
        bad, F.concat(F.lit("model_degraded_"), "name"), F.lit("warning"),
        F.format_string("%s: skill vs. naive is %.4f over %d forecasts (not positive).", "name", F.coalesce("skill_vs_naive", F.lit(0.0)), "n"),
    )


def all_alerts(parts: list[DataFrame]) -> DataFrame:
    """Union of alerts, the most severe first."""
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return df.withColumn("severity_rank", rank).orderBy("severity_rank", "key")


def reconcile_orphans(runs: DataFrame, now: Column, limits: dict[str, int]) -> DataFrame:
    """Runs still started past their hard limit plus grace become failures."""
    limit = F.lit(fixed.DEFAULT_HARD_LIMIT_SECONDS)
    for task, seconds in limits.items():
        limit = F.when(F.col("task_name") == task, seconds).otherwise(limit)
    df = runs.withColumn("hard_limit", limit)
    orphan = (F.col("status") == "started") & (seconds_between(F.col("started_at"), now) >= F.col("hard_limit") + fixed.ORPHAN_GRACE_SECONDS)
    # fixed values: texts a user sees
    text = F.format_string("Orphaned task record: no completion was written after the %d-second hard limit plus grace period.", "hard_limit")
    return df.withColumns(
        {
            "reconciled": orphan,
            "error": F.when(orphan, text).otherwise(F.col("error")),
            "finished_at": F.when(orphan, now).otherwise(F.col("finished_at")),
            "status": F.when(orphan, "failure").otherwise(F.col("status")),
        }
    )


def health_states(runs: DataFrame) -> DataFrame:
    """Final health per task over its finished runs: batch form of the stream.

    Only the tail after the last healthy run matters for the failure count,
    and whether three failures in a row came before it for the recovery mark,
    both found with running counts over each task's runs.
    """
    done = runs.filter(F.col("status") != "started")
    bad = F.col("status") == "failure"
    # runs of one task spread over hourly slices: inside a slice count failures
    # since each healthy run, then carry over at most two rows per slice
    df = done.withColumn("slice", F.date_trunc("HOUR", "started_at"))
    inside = Window.partitionBy("task_name", "slice").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_island", F.count_if(~bad).over(inside))
    islands = df.groupBy("task_name", "slice", "_island").agg(F.count_if(bad).alias("fails"), F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last_at"))
    slices = islands.groupBy("task_name", "slice").agg(
        F.max("_island").alias("islands"), F.sum(F.when(F.col("_island") == 0, F.col("fails")).otherwise(0)).alias("head"),
        F.max_by("fails", "_island").alias("tail"), F.max(F.when(F.col("_island") > 0, F.col("fails"))).alias("most"),
        F.sum("n").alias("n"), F.max("last_at").alias("last_at"),
    )
    healed = F.col("islands") > 0
    parts = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("part"), F.col("head").alias("fails"), F.lit(0).cast("long").alias("most"), F.lit(0).alias("fresh")),
            F.when(healed, F.struct(F.lit(1).alias("part"), F.col("tail").alias("fails"), F.col("most").alias("most"), F.lit(1).alias("fresh"))),
        )
    )
    ends = slices.select("task_name", "slice", F.explode(parts).alias("p")).select("task_name", "slice", "p.*")
    w = Window.partitionBy("task_name").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, 0)
    chains = ends.withColumn("_chain", F.sum("fresh").over(w)).groupBy("task_name", "_chain").agg(F.sum("fails").alias("fails"), F.max("most").alias("most"))
    total = slices.groupBy("task_name").agg(F.sum("n").alias("runs"), F.max("last_at").alias("last_run"))
    top = chains.groupBy("task_name").agg(
        F.max_by(F.struct("fails", "_chain"), "_chain").alias("t"),
        F.max(F.when((F.col("fails") >= 3) | (F.col("most") >= 3), F.col("_chain"))).alias("_last_bad"),
    ).join(total, "task_name")
    sick = F.col("t.fails") >= 3
    return top.select(
        "task_name", "runs", "last_run", F.col("t.fails").alias("consecutive_failures"),
        F.when(sick, "unhealthy").otherwise("healthy").alias("health"),
        F.when(sick, "failure_pending").when(F.col("_last_bad").isNotNull(), "recovery_pending").otherwise("none").alias("alert_state"),
    )
