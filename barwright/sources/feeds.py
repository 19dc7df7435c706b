"""Normalisers for landed price feeds and their merge by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.rolling import KEY

# header aliases per feed, target column -> accepted headers
BULK_HEADERS = {
    "date": ["trade_date", "date"], "symbol": ["company_code", "symbol"], "open": ["open_price", "open"], "high": ["day_high", "high"],
    "low": ["day_low", "low"], "close": ["close_price", "close"], "volume": ["volume"], "value": ["turnover", "value"],
}
HISTORY_HEADERS = {
    "date": ["date"], "symbol": ["symbol", "trading code"], "open": ["open", "openp"], "high": ["high"], "low": ["low"],
    "close": ["close", "closep"], "volume": ["volume"], "value": ["value"],
}


def normalise(raw: DataFrame, headers: dict[str, list[str]], drop_unpriced: bool = True) -> DataFrame:
    """Standard OHLCV rows: aliases resolved, prices filled from close, one row per (symbol, date).

    Duplicates are settled by an aggregate rather than a sort: the row that
    comes first in (open, high, low, close, volume) order is kept.
    """
    have = {c.strip().lower(): c for c in raw.columns}
    col = {t: F.col(f"`{have[n]}`") for t, names in headers.items() for n in reversed(names) if n in have}
    if not {"date", "symbol", "close"} <= set(col):
        raise ValueError("a price feed needs date, symbol and close")
    close = col["close"].try_cast("double")
    number = lambda name, default: F.coalesce(col[name].try_cast("double"), default) if name in col else default
    df = raw.select(
        F.upper(F.trim(col["symbol"])).alias("symbol"),
        col["date"].try_cast("date").alias("date"),
        number("open", close).alias("open"),
        number("high", close).alias("high"),
        number("low", close).alias("low"),
        close.alias("close"),
        number("volume", F.lit(0.0)).cast("long").alias("volume"),
        number("value", F.lit(0.0)).alias("value"),
    ).filter(F.col("date").isNotNull() & F.col("symbol").isNotNull() & F.col("close").isNotNull())
    if drop_unpriced:
        df = df.filter(F.col("close") > 0)
    first = F.min(F.struct("open", "high", "low", "close", "volume", "value"))
    return df.groupBy("symbol", "date").agg(first.alias("r")).select("symbol", "date", "r.*")


def merge_by_precedence(feeds: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of feeds in order of trust; the first feed that has a key wins."""
    tagged = [df.withColumns({"feed": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(feeds)]
    both = tagged[0]
    for other in tagged[1:]:
        both = both.unionByName(other)
    rest = [c for c in both.columns if c not in keys and c != "_rank"]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_rank").alias("r")).select(*keys, "r.*")


def enrich_stocks(stocks: DataFrame, updates: DataFrame, columns: list[str], only_active: bool = True) -> DataFrame:
    """Dimension with fresh values where the update has one; nothing is blanked."""
    fresh = updates.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in columns])
    df = stocks.join(fresh, KEY, "left")
    for c in columns:
        new = F.col(f"_new_{c}")
        if only_active:
            new = F.when(F.col("is_active"), new)
        df = df.withColumn(c, F.coalesce(new, F.col(c))).drop(f"_new_{c}")
    return df


def unmatched(updates: DataFrame, stocks: DataFrame) -> DataFrame:
    return updates.join(stocks.select(*KEY), KEY, "left_anti")


def mirror_bars(quoted: DataFrame, day) -> DataFrame:
    """Stand-in bars on the second exchange from the first one's last quotes, tagged synthetic."""
    p = F.col("last_price") * 0.998
    src = quoted.filter((F.col("exchange") == "DSE") & F.col("last_price").isNotNull())
    return src.select(
        F.lit("CSE").alias("exchange"), "symbol", day.alias("date"), p.alias("open"), (p * 1.01).alias("high"), (p * 0.99).alias("low"),
        p.alias("close"), F.floor(F.coalesce("last_volume", F.lit(0)) * 0.3).cast("long").alias("volume"),
        F.lit("cse_mirror_fallback").alias("source"), F.lit(True).alias("is_synthetic"), F.lit("raw").alias("adjustment_status"),
    )
