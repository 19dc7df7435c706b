"""Keyed upserts of daily bars, revision audit and batch accounting.

Plain Parquet has no MERGE: the merged rows come from one full outer join and
only the partitions they touch are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.rolling import KEY

BAR = [*KEY, "date"]
VALUES = ["open", "high", "low", "close", "volume", "value", "source"]


def quotes_to_bars(quotes: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Daily bars from quote snapshots: first open, extreme range, last price and volume.

    Late data is settled by event time, so any arrival order gives one result.
    Quotes on closed days write no bar.
    """
    ltp = F.col("ltp")
    df = quotes.filter(ltp > 0).withColumns(
        {
            "date": F.to_date("ts"),
            "_at": F.struct("ts", "event_id"),
            "_open": F.coalesce(F.nullif("open", F.lit(0.0)), ltp),
            "_high": F.greatest(F.coalesce("high", ltp), ltp),
            "_low": F.least(F.coalesce("low", ltp), ltp),
        }
    )
    if calendar is not None:
        df = df.join(calendar.filter("is_session").select("date"), "date", "left_semi")
    group = [c for c in ("exchange", "symbol", "date") if c in df.columns]
    return df.groupBy(*group).agg(
        F.min_by("_open", "_at").alias("open"), F.max("_high").alias("high"), F.min("_low").alias("low"),
        F.max_by("ltp", "_at").alias("close"), F.max_by("volume", "_at").alias("volume"), F.max("ts").alias("fetched_at"),
    )


def _paired(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    old = existing.select(*BAR, F.struct(*VALUES).alias("o"))
    new = incoming.select(*BAR, F.struct(*VALUES).alias("n"))
    return old.join(new, BAR, "full_outer")


def _blocked(o: Column, n: Column) -> Column:
    """Synthetic data never replaces a row from a confirmed real source."""
    real = ~o["source"].isin(["unknown", *fixed.SYNTHETIC_SOURCES])
    return F.coalesce(o["source"].isNotNull() & real & n["source"].isin(fixed.SYNTHETIC_SOURCES), F.lit(False))


def merge_history(existing: DataFrame, incoming: DataFrame, today: Column, replace_all: bool = False) -> DataFrame:
    """Archive merge: past days take the archive, today's live close and volume stay."""
    if replace_all:
        replaced = incoming.select(*KEY).distinct()
        existing = existing.join(replaced, KEY, "left_anti")
    j = _paired(existing, incoming)
    o, n = F.col("o"), F.col("n")
    keep = n.isNull() | _blocked(o, n)
    live_today = (F.col("date") == today) & o.isNotNull()
    positive = lambda c: F.when(c > 0, c)
    out = {
        "open": F.coalesce(F.nullif(o["open"], F.lit(0.0)), n["open"]),
        "high": F.greatest(o["high"], n["high"], o["close"]),
        "low": F.least(positive(o["low"]), positive(n["low"]), positive(o["close"])),
        "close": o["close"],
        "volume": o["volume"],
        "value": o["value"],
        "source": o["source"],
    }
    cols = {c: F.when(keep, o[c]).when(live_today, out[c]).otherwise(n[c]) for c in VALUES}
    outcome = (
        F.when(n.isNull(), "kept").when(_blocked(o, n), "protected").when(o.isNull(), "inserted").when(live_today, "merged_today").otherwise("replaced")
    )
    return j.select(*BAR, *[v.alias(c) for c, v in cols.items()], outcome.alias("outcome"))


def revisions(existing: DataFrame, merged: DataFrame, reason: str) -> DataFrame:
    """Previous values of bars whose price or volume materially changed."""
    old = existing.select(*BAR, *[F.col(c).alias(f"previous_{c}") for c in ("open", "high", "low", "close", "volume", "source")])
    new = merged.select(*BAR, *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close", "volume")], F.col("source").alias("new_source"))
    moved = F.lit(False)
    for c in ("open", "high", "low", "close"):
        moved = moved | (F.abs(F.coalesce(f"previous_{c}", F.lit(0.0)) - F.col(f"_{c}")) > fixed.REVISION_EPSILON)
    moved = moved | (F.coalesce("previous_volume", F.lit(0)) != F.coalesce("_volume", F.lit(0)))
    j = old.join(new, BAR).filter(moved)
    return j.drop(*[f"_{c}" for c in ("open", "high", "low", "close", "volume")]).withColumn("reason", F.lit(reason))


def upsert_live(existing: DataFrame, day_bars: DataFrame) -> DataFrame:
    """Live bars over stored ones: open kept, range widened, close and volume replaced."""
    j = _paired(existing, day_bars)
    o, n = F.col("o"), F.col("n")
    keep = n.isNull() | _blocked(o, n)
    out = {
        "open": F.coalesce(F.nullif(o["open"], F.lit(0.0)), n["open"]),
        "high": F.greatest(o["high"], n["high"], n["close"]),
        "low": F.least(o["low"], n["low"], n["close"]),
        "close": n["close"],
        "volume": n["volume"],
        "value": F.coalesce(F.nullif(n["value"], F.lit(0.0)), o["value"]),
        "source": n["source"],
    }
    return j.select(*BAR, *[F.when(keep, o[c]).when(o.isNull(), n[c]).otherwise(v).alias(c) for c, v in out.items()])


def refreshed_quotes(stocks: DataFrame, day_bars: DataFrame, key: list[str] = KEY) -> DataFrame:
    """stocks with last_price, last_volume and last_date of their newest live bar; others keep what they had."""
    newest = day_bars.groupBy(*key).agg(F.max(F.struct(F.col("date").alias("last_date"), F.col("close").alias("last_price"), F.col("volume").alias("last_volume"))).alias("_n"))
    fields = ["last_price", "last_volume", "last_date"]
    now = {c: F.coalesce(F.col(f"_n.{c}"), F.col(c)) if c in stocks.columns else F.col(f"_n.{c}") for c in fields}
    rest = [c for c in stocks.columns if c not in fields]
    return stocks.join(newest, key, "left").select(*rest, *[v.alias(c) for c, v in now.items()])


def batch_accounting(written: DataFrame) -> DataFrame:
    """Row and security counts per import batch (distinct securities first, so
    that no batch is counted distinct in one task)."""
    per_stock = written.groupBy("batch_id", *KEY).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    return per_stock.groupBy("batch_id").agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("stock_count"), F.min("a").alias("first_date"), F.max("b").alias("last_date")
    )


def rewrite_partitions(merged: DataFrame, path: str) -> None:
    """Write bars partitioned by exchange and year, replacing only those partitions."""
    out = merged.withColumn("year", F.year("date"))
    (
        out.repartition("exchange", "year", F.pmod(F.hash("symbol"), F.lit(64)))
        .sortWithinPartitions("exchange", "year", "symbol", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("exchange", "year")
        .parquet(path)
    )
