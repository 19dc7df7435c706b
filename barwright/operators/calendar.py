"""Trading calendar: a dimension with one row per day of the data's range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_weekend(d: Column) -> Column:
    """Friday and Saturday; the trading week is Sunday to Thursday."""
    return F.dayofweek(d).isin(6, 7)


def calendar(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days from span.first_day to span.last_day (one row in, calendar-bounded out).

    `session_no` counts sessions up to and including the day, so the n-th
    session after a day is the session whose number is session_no + n.
    """
    days = span.select(F.explode(F.sequence("first_day", "last_day")).alias("date"))
    named = holidays.groupBy("date").agg(F.min("name").alias("name"))
    df = days.join(named, "date", "left")
    reason = F.when(is_weekend(F.col("date")), F.lit("Weekend")).otherwise(F.col("name"))
    df = df.select("date", reason.alias("closure"), reason.isNull().alias("is_session"))
    # ordered by date over at most a few ten thousand calendar days
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session_no", F.count_if("is_session").over(w))


def span_of(*dates: DataFrame, slack: int = 400) -> DataFrame:
    """One row with the first and last day over single-column date tables."""
    both = dates[0].toDF("d")
    for other in dates[1:]:
        both = both.unionByName(other.toDF("d"))
    return both.agg(F.min("d").alias("first_day"), F.date_add(F.max("d"), slack).alias("last_day"))


def nth_session(cal: DataFrame, n: int, name: str = "target_date") -> DataFrame:
    """date -> the n-th session strictly after it (an equality join on session number)."""
    sessions = cal.filter("is_session").select(F.col("session_no").alias("_s"), F.col("date").alias(name))
    return cal.withColumn("_s", F.col("session_no") + n).join(sessions, "_s").select("date", name)


def with_nth_session(df: DataFrame, cal: DataFrame, by: str, n: Column, name: str) -> DataFrame:
    """As nth_session with a per-row distance."""
    sessions = cal.filter("is_session").select(F.col("session_no").alias("_s"), F.col("date").alias(name))
    at = cal.select(F.col("date").alias(by), "session_no")
    return (
        df.join(at, by, "left").withColumn("_s", F.col("session_no") + n).join(sessions, "_s", "left").drop("_s", "session_no")
    )


def session_status(moments: DataFrame, cal: DataFrame, ts: str = "ts") -> DataFrame:
    """Open or closed at a local timestamp, with the next open or close."""
    nxt = nth_session(cal, 1, "next_session").withColumnRenamed("date", "day")
    df = (
        moments.withColumn("day", F.to_date(ts))
        .join(cal.select(F.col("date").alias("day"), "closure", "is_session"), "day")
        .join(nxt, "day", "left")
    )
    minute = F.hour(ts) * 60 + F.minute(ts)
    opened = F.col("is_session") & (minute >= 600) & (minute < 870)
    at = lambda d, m: d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    next_at = (
        F.when(opened, at(F.col("day"), 870))
        .when(F.col("is_session") & (minute < 600), at(F.col("day"), 600))
        .otherwise(at(F.col("next_session"), 600))
    )
    return df.withColumns(
        {
            "is_open": opened,
            "status": F.when(opened, "Open")
            .when(F.col("closure").isNotNull(), F.concat(F.lit("Closed — "), F.col("closure")))
            .otherwise("Closed"),
            "next_event": F.when(opened, "closes").otherwise("opens"),
            "next_at": next_at,
        }
    )
