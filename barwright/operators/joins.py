"""Temporal and membership joins between market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.rolling import KEY


def daily_state(states: DataFrame, end, date: str = "as_of") -> DataFrame:
    """One row per security and day carrying the latest state as of that day.

    A state is valid until the security's next state, so the spans are
    expanded to days; the result is bounded by securities x calendar.
    """
    w = Window.partitionBy(*KEY).orderBy(date)
    until = F.coalesce(F.date_sub(F.lead(date).over(w), 1), end)
    return (
        states.withColumn("_until", until)
        .filter(F.col("_until") >= F.col(date))
        .withColumn("day", F.explode(F.sequence(F.col(date), F.col("_until"))))
        .drop("_until")
    )


def as_of_join(facts: DataFrame, states: DataFrame, fact_date: str, date: str = "as_of") -> DataFrame:
    """Latest state with date <= fact date, as an equality join.

    Facts of one security may be most of the table: they are spread by
    (security, day) and never gathered per security.
    """
    end = facts.select(F.max(fact_date)).scalar()
    keyed = daily_state(states, end, date).withColumnRenamed("day", fact_date)
    return facts.join(keyed, [*KEY, fact_date], "left")


def next_bar(facts: DataFrame, bars: DataFrame, fact_date: str, within: int = 30) -> DataFrame:
    """First bar strictly after a date, at most `within` days later."""
    b = bars.select(*KEY, "date", F.col("open").alias("next_open"))
    w = Window.partitionBy(*KEY).orderBy("date")
    spans = b.withColumn("_from", F.greatest(F.coalesce(F.lag("date").over(w), F.date_sub("date", within)), F.date_sub("date", within)))
    days = spans.withColumn(fact_date, F.explode(F.sequence("_from", F.date_sub("date", 1)))).drop("_from")
    return facts.join(days.withColumnRenamed("date", "next_date"), [*KEY, fact_date], "left")


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not on record yet; a repeated run adds nothing."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
