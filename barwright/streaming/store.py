"""Stored daily bars that a quote stream merges into.

`<path>/bars/date=…` holds the bars. A micro-batch touches only the dates it brings: their stored rows are merged with the
new ones, staged, and put in place by dynamic partition overwrite, which also leaves each date with few files. The ledger
knows which of the last two batches are staged or applied: a replayed batch that was applied changes nothing, one that
stopped after staging is put in place from there, so a stop in the middle of an overwrite loses no stored row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.sources import upsert

LEDGER = "batch_id long, state string"


def _put(rows: DataFrame, path: str, parts: int) -> None:
    (
        rows.repartition("date", F.pmod(F.hash("symbol"), F.lit(parts)))
        .sortWithinPartitions("date", "exchange", "symbol")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{path}/bars")
    )


def create(bars: DataFrame, path: str, parts: int = 4) -> None:
    """A store with these bars (it may be empty) and an empty ledger. `parts`: files a date may have."""
    spark = bars.sparkSession
    rows = bars.select(*upsert.BAR, *upsert.VALUES)
    # a store without rows has its schema from this empty part
    rows.limit(0).withColumn("date", F.lit("0001-01-01").cast("date")).write.mode("overwrite").parquet(f"{path}/schema")
    _put(rows, path, parts)
    spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{path}/ledger/slot=none")


def read(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/bars").select(*upsert.BAR, *upsert.VALUES)


def marks(spark: SparkSession, path: str, batch_id: int) -> set[str]:
    """What has been done with a batch (at most two rows)."""
    rows = spark.read.schema(LEDGER).option("basePath", f"{path}/ledger").parquet(f"{path}/ledger")
    return {r["state"] for r in rows.filter(F.col("batch_id") == batch_id).collect()}


def _mark(spark: SparkSession, path: str, batch_id: int, state: str) -> None:
    one = spark.createDataFrame([(batch_id, state)], LEDGER).coalesce(1)
    one.write.mode("overwrite").parquet(f"{path}/ledger/slot={state}_{batch_id % 2}")


def sink(path: str, shape: Callable[[DataFrame], DataFrame], parts: int = 4) -> Callable[[DataFrame, int], None]:
    """foreachBatch function. `shape` turns a micro-batch into bars, one row a security and date.

    The stored open stays, the range widens, close and volume are the new ones; invented data never replaces real data.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = marks(spark, path, batch_id)
        if "applied" in done:
            return
        staging = f"{path}/staging/slot={batch_id % 2}"
        if "staged" not in done:
            new = shape(batch).select(*upsert.BAR, *upsert.VALUES).persist()
            days = [r["date"] for r in new.select("date").distinct().collect()]  # days of one micro-batch, bounded by the watermark
            stored = read(spark, path).filter(F.col("date").isin(days)) if days else read(spark, path).limit(0)
            upsert.upsert_live(stored, new).write.mode("overwrite").parquet(staging)
            new.unpersist()
            _mark(spark, path, batch_id, "staged")
        _put(spark.read.parquet(staging), path, parts)
        _mark(spark, path, batch_id, "applied")

    return write


def drain(bars: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame], parts: int = 4) -> None:
    """Merge all that has arrived, and stop. bars: a streaming aggregate such as `quotes.daily_bars`."""
    q = (
        bars.writeStream.outputMode("update").foreachBatch(sink(path, shape, parts))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
