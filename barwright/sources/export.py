"""CSV exports with fixed public columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holdings_export(rows: DataFrame, allocation: DataFrame) -> DataFrame:
    share = allocation.filter(F.col("kind") == "stock").select("portfolio_id", F.col("label").alias("_label"), F.col("pct").alias("allocation_pct"))
    df = rows.withColumn("_label", F.concat_ws(":", "exchange", "symbol")).join(share, ["portfolio_id", "_label"], "left")
    return df.select(
        "portfolio_id", F.col("symbol").alias("code"), "exchange", "quantity", F.col("average_price").alias("average_buy"),
        F.col("price").alias("current_price"), "market_value", F.col("unrealized_pl").alias("gain_loss"), "allocation_pct",
    )


def ticket_export(tickets: DataFrame) -> DataFrame:
    return tickets.select(
        F.col("reference").alias("reference_number"), "category", "reporter_priority", "admin_priority", "status", "title", "created_at", "resolved_at"
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
