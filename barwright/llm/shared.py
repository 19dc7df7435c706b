"""Helpers that several of the corpus operators use."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.session import work_folder

LOWEST = -(2**63)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def own_columns(stage: Callable) -> Callable:
    """A pipeline stage (spark, docs, folder) that sees the columns of `documents` only; whatever else the rows hold
    travels in one struct of an unused name and comes back under its own names. Columns that the stage adds keep
    their names, a column of the input with such a name comes back as `given_<name>`."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        rest = [c for c in docs.columns if c not in DOCUMENT]
        if not rest:
            return stage(spark, docs, folder)
        hidden = "_rest"
        while hidden in docs.columns:
            hidden += "_"
        out = stage(spark, docs.select(*[c for c in docs.columns if c in DOCUMENT], F.struct(*[F.col(f"`{c}`") for c in rest]).alias(hidden)), folder)
        added = [c for c in out.columns if c not in docs.columns and c != hidden or c in rest]
        back = {c: F.col(f"{hidden}.`{c}`").alias(f"given_{c}" if c in added else c) for c in rest}
        return out.select(*[back.get(c, F.col(c)) for c in docs.columns], *added)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(texts: pd.Series, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Lists of texts (null: empty) of about `chars` characters; one longer text makes a list of its own."""
    part, held = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def text_slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of an Arrow batch of about `chars` bytes of text each, with their texts (null: empty); the rest of the
    batch is not turned into Python objects meanwhile."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + chars, side="right")))
        yield batch.slice(at, end - at), [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, for models and caches that tasks share."""
    return vars(sys).setdefault("_barwright_store", {}).setdefault(name, {})


def range_edges(keys: DataFrame, n: int) -> list[tuple[tuple, tuple]]:
    """First and last key of each of about `n` ranges that hold equal shares of the rows, ascending.

    Only key columns are read and shuffled; the driver gets one row for each range.
    """
    edges = (
        keys.repartitionByRange(n, *keys.columns)
        .select(F.spark_partition_id().alias("part"), F.struct(*keys.columns).alias("key"))
        .groupBy("part")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"))
    )
    return sorted((tuple(r["first"]), tuple(r["last"])) for r in edges.collect())


def range_of(firsts: list[tuple], key: tuple) -> int:
    return max(0, bisect_right(firsts, key) - 1)


def global_rank(df: DataFrame, order: list, name: str, purpose: str) -> DataFrame:
    """Adds the place (from 0) of each row in `order`: ranges are ranked on their own and offset by the
    sizes of the ranges before. The result is a stored table."""
    n = partitions(df.sparkSession)
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), purpose)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_row") - 1)
        .drop("_part", "_row", "_before")
    )


def placed(df: DataFrame, order: list, name: str, purpose: str) -> DataFrame:
    """The rows with their place (from 0) in `order`, stored range by range in that order.

    Needs one shuffle and no window over rows: a row's place is its number in its sorted range plus the sizes of
    the ranges before.
    """
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = stored(ranged.withColumns({"_part": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), purpose)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
