"""Feature frames for the learned estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions import recurrence
from barwright.functions.expr import ratio
from barwright.functions.rolling import KEY, ahead, guarded, history
from barwright.operators import context as ctx
from barwright.operators.indicators import indicators, latest, volatility_regime


def technical(bars: DataFrame) -> DataFrame:
    """Indicator frame plus per-security features; same partitioning and sort."""
    df = indicators(bars)
    w = history(recurrence.BLOCK, "date")
    c, o, h, l = (F.col(x) for x in ("close", "open", "high", "low"))
    v = F.col("volume").cast("double")
    r1 = F.coalesce(F.col("return_1d"), F.lit(0.0))
    sign = F.signum(r1)
    df = df.withColumns(
        {
            "volume_ratio": ratio(v, F.col("volume_sma_20")),
            "dist_sma20": ratio(c, F.col("sma_20")) - 1.0,
            "dist_sma50": ratio(c, F.col("sma_50")) - 1.0,
            "intraday_return": ratio(c, o) - 1.0,
            "overnight_gap": ratio(o, F.col("prev_close")) - 1.0,
            "range_atr": ratio(h - l, F.col("atr_14")),
            "close_location": ratio(c - l, h - l),
            "volume_acceleration": ratio(v, guarded(F.avg, v, w, 5, 3)),
            "turnover_acceleration": ratio(c * v, guarded(F.avg, c * v, w, 20, 10)),
            "turnover_ratio": F.coalesce(ratio(F.col("value"), guarded(F.avg, F.col("value"), w, 20, 10)), F.lit(1.0)),
            "_sign": sign,
        }
    )
    # signed run length: distance to the last row where the sign changed
    turn = F.when(~F.col("_sign").eqNullSafe(F.lag("_sign").over(w)), F.col("rn"))
    df = df.withColumn("_turn", turn).withColumn("_start", F.max("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("up_down_streak", F.col("_sign") * (F.col("rn") - F.col("_start") + 1)).drop("_turn", "_start", "_sign")
    return volatility_regime(df)


def with_context(df: DataFrame, returns: DataFrame, stocks: DataFrame) -> DataFrame:
    """Left-join sector label, exchange and sector context, with neutral defaults.

    The exchange and sector contexts are broadcast: exchanges times sectors times
    the days of the calendar bound them whatever the number of bars, and the bars
    stay where their one exchange by security has put them.
    """
    ex = F.broadcast(ctx.exchange_context(returns))
    usable = F.broadcast(ctx.usable_sectors(stocks).filter("sector_usable").select("exchange"))
    sec = F.broadcast(ctx.sector_context(returns).join(usable, "exchange"))
    df = (
        df.join(stocks.select(*KEY, "sector"), KEY, "left")
        .join(ex, ["exchange", "date"], "left")
        .join(sec, ["exchange", "sector", "date"], "left")
    )
    defaults = {"index_ret_1d": 0.0, "index_ret_5d": 0.0, "index_ret_20d": 0.0, "sector_ret_1d": 0.0, "breadth": 0.5}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def relative_strength(df: DataFrame) -> DataFrame:
    r1, r5, r20 = (F.coalesce(F.col(f"return_{n}d"), F.lit(0.0)) for n in (1, 5, 20))
    return df.withColumns(
        {
            "rel_ret_1d": r1 - F.col("index_ret_1d"),
            "rel_ret_5d": r5 - F.col("index_ret_5d"),
            "rel_ret_20d": r20 - F.col("index_ret_20d"),
            "stock_sector_rel_1d": r1 - F.col("sector_ret_1d"),
            "sector_index_rel_1d": F.col("sector_ret_1d") - F.col("index_ret_1d"),
            "trend_regime": F.when(F.col("index_ret_20d") > 0, 1.0).otherwise(0.0),
        }
    )


def with_market(df: DataFrame, returns: DataFrame, stocks: DataFrame) -> DataFrame:
    return relative_strength(with_context(df, returns, stocks))


def with_labels(df: DataFrame) -> DataFrame:
    """Forward labels; null where the outcome is not known yet."""
    w = history(recurrence.BLOCK, "date")
    df = df.withColumns(
        {
            "fwd_ret_1": ahead(F.col("close"), w, 1),
            "fwd_ret_10": ahead(F.col("close"), w, 10),
            "next_volume": F.lead("volume").over(w),
        }
    )
    f1, f10 = F.col("fwd_ret_1"), F.col("fwd_ret_10")
    return df.withColumns(
        {
            "label": F.when(f10.isNotNull(), F.when(f10 > 0, 1.0).otherwise(0.0)),
            "direction_label": F.when(f1 < -fixed.FLAT_RETURN, 0).when(f1 > fixed.FLAT_RETURN, 2).when(f1.isNotNull(), 1),
        }
    )


def feature_frame(bars: DataFrame, stocks: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Features and labels of every bar, or of every bar of the members.

    Context joins the narrow bars, before the windows widen them, so the wide
    frame is never moved again after its one exchange by security. It is that of
    the whole market, whoever the members are; the windows are each security's own.
    """
    own = bars if members is None else bars.join(members.select(*KEY), KEY, "left_semi")
    placed = with_context(own, ctx.daily_returns(bars, stocks), stocks)
    return relative_strength(with_labels(technical(placed)))


def latest_vector(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Latest feature row per security with neutral market defaults.

    Rows with an unknown technical feature or under 40 bars are rejected.
    """
    frame = with_market(latest(technical(bars)), ctx.daily_returns(bars, stocks), stocks)
    known = F.lit(True)
    for c in fixed.TECHNICAL_FEATURES:
        known = known & F.col(c).isNotNull()
    return (
        frame.filter(known & (F.col("n_rows") >= fixed.MIN_HISTORY))
        .withColumn("vol_regime", F.coalesce(F.col("vol_regime"), F.lit(1.0)))
        .select(*KEY, "sector", F.col("date").alias("as_of"), "close", "n_rows", *fixed.NEXT_CLOSE_FEATURES, "turnover_ratio")
    )
