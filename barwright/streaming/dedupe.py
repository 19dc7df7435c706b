"""Once-per-day delivery of digests and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_per_day_stream(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """First alert per title and day; state lives as long as the watermark."""
    df = alerts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("day", F.to_date("ts"))
    return df.dropDuplicatesWithinWatermark(["title", "day"])


def once_per_day(alerts: DataFrame, delivered: DataFrame) -> DataFrame:
    """Batch form: earliest alert per title and day that was not delivered yet."""
    rest = [c for c in alerts.columns if c != "title"]
    first = alerts.withColumn("day", F.to_date("ts")).groupBy("title", "day").agg(F.min_by(F.struct(*rest), F.struct("ts", "alert_id")).alias("r"))
    return first.select("title", "day", "r.*").join(delivered.select("title", "day"), ["title", "day"], "left_anti")
