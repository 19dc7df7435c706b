"""Task health over a stream of finished runs, and runs found stuck by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barwright import fixed

OUTPUT = "task_name string, consecutive_failures int, health string, alert_state string, last_run timestamp, runs long"
STATE = "consecutive_failures int, health string, alert_state string, last_run timestamp, runs long"
LIMIT = 3


def advance(state: tuple[int, str, str], status: str) -> tuple[int, str, str]:
    """Next (consecutive failures, health, alert state) after one finished run."""
    failures, health, alert = state
    if status == "failure":
        failures += 1
        if failures >= LIMIT:
            return failures, "unhealthy", alert if alert == "failure_sent" else "failure_pending"
        return failures, health, alert
    if health == "unhealthy":
        return 0, "healthy", "recovery_pending"
    return 0, "healthy", alert if alert == "recovery_pending" else "none"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, health, alert, last, runs = state.get if state.exists else (0, "healthy", "none", None, 0)
    # within a micro-batch runs are applied in event order
    rows = pd.concat(list(batches)).sort_values(["started_at", "run_id"])
    now = (failures, health, alert)
    for status in rows["status"]:
        now = advance(now, status)
    newest = rows["started_at"].iloc[-1]
    last = newest if last is None or pd.isna(last) or newest > last else last
    runs += len(rows)
    state.update((*now, last, runs))
    yield pd.DataFrame([(key[0], *now, last, runs)], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def task_health(runs: DataFrame) -> DataFrame:
    """runs: task_name, run_id, status, started_at (timestamp); started rows are ignored."""
    done = runs.filter(F.col("status") != "started").select("task_name", "run_id", "status", "started_at")
    return done.groupBy("task_name").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


FLIGHT_STATE = "run_id array<long>, started_us array<long>, done array<boolean>"
FLIGHT_OUTPUT = "task_name string, run_id long, started_us long"
SLOTS = 128


def _in_flight(limit_ms: int):
    """State of the runs of one slot: when each started and whether it has finished. The timer stands at the earliest
    start plus limit.

    A finish that comes before its start is kept as a mark until the same timer, so state holds only runs whose limit the
    watermark has not passed yet.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(dict(zip(("run_id", "started_us", "done"), state.get)))] if state.exists else []
        if not state.hasTimedOut:
            held += [rows[["run_id", "started_us"]].assign(done=rows["status"] != "started") for rows in batches]
        runs = pd.concat(held).groupby("run_id", as_index=False).agg({"started_us": "min", "done": "max"})
        due = runs["started_us"] // 1000 + limit_ms
        passed = due < state.getCurrentWatermarkMs()
        stuck, rest = runs[passed & ~runs["done"].astype(bool)], runs[~passed]
        if len(rest):
            state.update((rest["run_id"].tolist(), rest["started_us"].tolist(), rest["done"].astype(bool).tolist()))
            state.setTimeoutTimestamp(int(due[~passed].min()))
        elif state.exists:
            state.remove()
        if len(stuck):
            yield pd.DataFrame({"task_name": key[0], "run_id": stuck["run_id"], "started_us": stuck["started_us"]})

    return update


def stuck_runs(events: DataFrame, limit: str = f"{fixed.STUCK_JOB_MINUTES} minutes", delay: str = "5 minutes", slots: int = SLOTS) -> DataFrame:
    """Runs that are in flight when the watermark passes their start plus the limit; each appears once, without a further event.

    events: task_name, run_id, status, started_at, at (moment of the event: the start for a started row, else the finish).
    A task's runs are dealt into `slots` by a hash of their id, one state each, so a task with most of the events is spread
    over many tasks of the job and a call of the update serves many runs. Rows without a start, an id or a moment are left out.
    """
    limit_ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    rows = (
        events.dropna(subset=["task_name", "run_id", "started_at", "at"])
        .withColumn("at", F.col("at").cast("timestamp"))
        .withWatermark("at", delay)
        .select("task_name", F.col("run_id").cast("long"), "status", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), "at")
    )
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("run_id"), F.lit(slots)))
    found = rows.groupBy("task_name", "slot").applyInPandasWithState(
        _in_flight(limit_ms), FLIGHT_OUTPUT, FLIGHT_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(
        "task_name", "run_id", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros(F.col("started_us") + limit_ms * 1000).alias("stuck_at")
    )
