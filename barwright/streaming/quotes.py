"""Quote stream to daily bars, upserted per micro-batch."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def day_start(spark: SparkSession) -> str:
    """Offset of local midnight from a UTC day, for day windows in the session's zone."""
    offset = datetime.now(ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))).utcoffset()
    return f"{int(-offset.total_seconds()) % 86400} seconds"


def daily_bars(quotes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming aggregate of quotes to (symbol, day) bars.

    The newest event decides close and volume whatever the arrival order; a
    day's state is dropped once the watermark has passed it.
    """
    ltp = F.col("ltp")
    at = F.struct("ts", "event_id")
    df = quotes.filter(ltp > 0).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        df.groupBy("symbol", F.window("ts", "1 day", startTime=day_start(quotes.sparkSession)).alias("w"))
        .agg(
            F.min_by(F.coalesce(F.nullif("open", F.lit(0.0)), ltp), at).alias("open"),
            F.max(F.greatest(F.coalesce("high", ltp), ltp)).alias("high"),
            F.min(F.least(F.coalesce("low", ltp), ltp)).alias("low"),
            F.max_by("ltp", at).alias("close"),
            F.max_by("volume", at).alias("volume"),
            F.max("ts").alias("fetched_at"),
        )
        .select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume", "fetched_at")
    )


def upsert_sink(path: str):
    """foreachBatch sink: keep the newest version of each (symbol, date).

    Every batch is written to its own folder named by the batch id, so a
    replayed batch overwrites itself; readers take the newest row per key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in ("symbol", "date", "batch_id")]
    return rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("symbol", "date", "r.*")


def run_available(quotes: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what has arrived, in update mode, and stop."""
    q = (
        daily_bars(quotes)
        .writeStream.outputMode("update")
        .foreachBatch(upsert_sink(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
