"""Searches, latest-row lookups and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.rolling import KEY
from barwright.operators.calendar import is_weekend


def enabled(df: DataFrame, exchanges: list[str]) -> DataFrame:
    """Gate applied to every discovery operator."""
    return df.filter(F.col("exchange").isin(exchanges))


def stock_search(stocks: DataFrame, text: str = "", exchange: str = "", exchanges: list[str] = fixed.EXCHANGES) -> DataFrame:
    df = enabled(stocks.filter("is_active"), exchanges)
    if exchange:
        df = df.filter(F.col("exchange") == exchange)
    if text:
        df = df.filter(F.contains(F.lower("symbol"), F.lit(text.lower())) | F.contains(F.lower("company_name"), F.lit(text.lower())))
    return df


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Newest row per key as an aggregate with map-side combine, so that a
    key holding most of the rows is reduced before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*")


def top_per_group(df: DataFrame, groups: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group; the limit is applied before the exchange too."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def page(df: DataFrame, order: list, size: int = 25, number: int = 1) -> DataFrame:
    df = df.orderBy(*order)
    return (df.offset((number - 1) * size) if number > 1 else df).limit(size)


def recent_closes(bars: DataFrame, days: int = 15) -> DataFrame:
    """Recent bar count, latest close and last real close before the newest day."""
    today = bars.select(F.max("date")).scalar()
    df = bars.withColumn("today", today).filter(F.col("date") >= F.date_sub("today", days))
    return df.groupBy(*KEY).agg(
        F.max("today").alias("today"),
        F.count(F.lit(1)).alias("recent_bars"),
        F.max_by("close", "date").alias("latest_close"),
        F.max_by(
            "close", F.when((F.col("date") < F.col("today")) & ~F.col("is_synthetic"), F.col("date"))
        ).alias("previous_close"),
    )


def ticker(quoted: DataFrame, n: int = 70, exchanges: list[str] = fixed.EXCHANGES) -> DataFrame:
    """Most traded securities of each exchange."""
    df = enabled(quoted.filter(F.col("is_active") & F.col("last_price").isNotNull()), exchanges)
    return top_per_group(df, ["exchange"], [F.desc("last_volume"), F.asc("symbol")], n)


def history_table(bars: DataFrame, holidays: DataFrame, range_key: str = "30d") -> DataFrame:
    """Bars of each security over a calendar range, closed days labelled.

    Days without a bar that are neither weekend nor holiday are left out.
    """
    days = fixed.HISTORY_RANGES.get(range_key, fixed.HISTORY_RANGES["30d"])
    last = bars.groupBy(*KEY).agg(F.max("date").alias("latest"))
    spine = last.select(*KEY, F.explode(F.sequence(F.date_sub("latest", days - 1), F.col("latest"))).alias("date"))
    shown = (
        spine.join(bars.select(*KEY, "date", "open", "high", "low", "close", "volume"), [*KEY, "date"], "left")
        .join(holidays.groupBy("date").agg(F.min("name").alias("holiday")), "date", "left")
        .withColumn(
            "closed_reason",
            F.when(F.col("close").isNull(), F.when(is_weekend(F.col("date")), F.lit("Weekend")).otherwise(F.col("holiday"))),
        )
        .filter(F.col("close").isNotNull() | F.col("closed_reason").isNotNull())
    )
    w = Window.partitionBy(*KEY).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last("close", ignorenulls=True).over(w)
    return shown.withColumn("_prev", prev).select(
        *KEY, "date", "open", "high", "low", "close", "volume", "closed_reason",
        F.when(F.col("_prev") > 0, F.bround(F.col("close") - F.col("_prev"), 2)).alias("change"),
        F.when(F.col("_prev") > 0, F.bround((F.col("close") / F.col("_prev") - 1.0) * 100.0, 2)).alias("change_pct"),
    )


def chart_series(bars: DataFrame, n: int = 280) -> DataFrame:
    df = top_per_group(bars, KEY, [F.desc("date")], n)
    two = {c: F.bround(c, 2) for c in ("open", "high", "low", "close")}
    return df.withColumns(two)


def upcoming_events(events: DataFrame, as_of, n: int = 100) -> DataFrame:
    return events.filter(F.col("is_public") & (F.col("event_date") >= as_of)).orderBy(F.desc("event_date"), "title").limit(n)


def ticket_diagnostics(tickets: DataFrame, stocks: DataFrame, latest_analysis: DataFrame, latest_bar: DataFrame) -> DataFrame:
    """Facts on record for the security a prediction or data ticket names."""
    named = tickets.filter(F.col("category").isin("prediction_issue", "data_issue"))
    facts = (
        stocks.select(*KEY)
        .join(latest_analysis.select(*KEY, F.col("as_of").alias("analysis_date")), KEY, "left")
        .join(latest_bar.select(*KEY, F.col("source").alias("data_source"), F.col("date").alias("price_date")), KEY, "left")
    )
    return named.join(facts, KEY, "left").withColumn(
        "prediction_reference",
        F.when(F.col("analysis_date").isNotNull(), F.concat_ws(":", "exchange", "symbol", F.col("analysis_date").cast("string"))),
    )
