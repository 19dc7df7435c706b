"""Market-wide daily context: index return, breadth, sector return, beta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import flags_overlap
from barwright.functions.rolling import KEY, change, history, trailing

HORIZONS = (5, 20)


def daily_returns(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """One-day returns of clean bars of active securities, with their sector."""
    if "quality_flags" in bars.columns:
        bars = bars.filter(~flags_overlap(F.col("quality_flags"), fixed.TRAINING_EXCLUDE_FLAGS))
    active = stocks.filter("is_active").select(*KEY, "sector")
    return (
        bars.select(*KEY, "date", "close")
        .join(active, KEY)
        .withColumn("ret", change(F.col("close"), history()))
    )


def exchange_context(returns: DataFrame) -> DataFrame:
    """Equal-weight index return and breadth per exchange and day.

    The daily table has one row per exchange and calendar day, so the
    compounding windows run over a calendar-bounded input.
    """
    ret = F.col("ret")
    daily = returns.groupBy("exchange", "date").agg(
        F.coalesce(F.avg(ret), F.lit(0.0)).alias("index_ret_1d"),
        F.coalesce(F.avg(F.when(ret.isNotNull(), F.when(ret > 0, 1.0).otherwise(0.0))), F.lit(0.5)).alias("breadth"),
    )
    w = Window.partitionBy("exchange").orderBy("date")
    one = F.col("index_ret_1d")
    for n in HORIZONS:
        frame = trailing(w, n)
        daily = daily.withColumn(
            f"index_ret_{n}d",
            F.coalesce(
                F.when(F.count(one).over(frame) >= max(2, n // 2), F.product(one + 1.0).over(frame) - 1.0), F.lit(0.0)
            ),
        )
    return daily


def sector_context(returns: DataFrame) -> DataFrame:
    """Equal-weight return of the peers of a sector; unlabelled stocks have no peers."""
    return (
        returns.filter(F.col("sector") != "")
        .groupBy("exchange", "sector", "date")
        .agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("sector_ret_1d"))
    )


def usable_sectors(stocks: DataFrame) -> DataFrame:
    """Exchanges whose sector labels cover at least 90 % of active securities."""
    return (
        stocks.filter("is_active")
        .groupBy("exchange")
        .agg((F.count_if(F.col("sector") != "") / F.count(F.lit(1)) >= 0.90).alias("sector_usable"))
    )


def beta_pairs(returns: DataFrame, context: DataFrame, days: int = 90) -> DataFrame:
    """Aligned stock and index returns of each security's trailing window."""
    last = returns.groupBy(*KEY).agg(F.max("date").alias("last_date"))
    return (
        returns.join(last, KEY)
        .filter(F.col("date") >= F.date_sub("last_date", days))
        .join(context.select("exchange", "date", "index_ret_1d"), ["exchange", "date"])
        .filter(F.col("ret").isNotNull() & F.col("index_ret_1d").isNotNull())
        .select(*KEY, "date", F.col("ret").alias("stock_ret"), F.col("index_ret_1d").alias("index_ret"))
    )


def beta(pairs: DataFrame) -> DataFrame:
    var = F.var_samp("index_ret")
    return pairs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.when(
            (F.count(F.lit(1)) >= 20) & (var > 1e-12), F.bround(F.covar_samp("stock_ret", "index_ret") / var, 3)
        ).alias("beta_90d"),
    )


def rolling_beta(returns: DataFrame, context: DataFrame, days: int = 90) -> DataFrame:
    """The same beta at every bar of the history."""
    j = returns.join(context.select("exchange", "date", "index_ret_1d"), ["exchange", "date"]).filter(
        F.col("ret").isNotNull()
    )
    w = Window.partitionBy(*KEY).orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    var = F.var_samp("index_ret_1d").over(w)
    return j.select(
        *KEY, "date",
        F.when(
            (F.count(F.lit(1)).over(w) >= 20) & (var > 1e-12), F.covar_samp("ret", "index_ret_1d").over(w) / var
        ).alias("beta_90d"),
    )


def breadth_above_sma50(ind: DataFrame) -> DataFrame:
    """Share of securities closing above their 50-session average per exchange and day."""
    return (
        ind.filter(F.col("sma_50").isNotNull())
        .groupBy("exchange", "date")
        .agg(F.avg(F.when(F.col("close") > F.col("sma_50"), 1.0).otherwise(0.0)).alias("breadth_50"))
    )


def index_proxy(context: DataFrame) -> DataFrame:
    """Compounded equal-weight return per exchange, daily moves clipped at 50 %."""
    r = F.least(F.greatest(F.col("index_ret_1d"), F.lit(-0.5)), F.lit(0.5))
    return context.groupBy("exchange").agg(
        F.bround((F.exp(F.sum(F.log1p(r))) - 1.0) * 100.0, 3).alias("index_return_pct"), F.count(F.lit(1)).alias("days")
    )
