"""Technical indicators over each security's bar history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwright.functions import recurrence
from barwright.functions.rolling import KEY, change, guarded, history, mean, trailing

SNAPSHOT = [
    "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "rsi_14", "macd", "macd_signal", "macd_hist",
    "bb_upper", "bb_middle", "bb_lower", "atr_14", "volume_sma_20", "support", "resistance",
]


def scan(bars: DataFrame, excluded_flags: list[str] | None = None) -> DataFrame:
    """Bars ready for computing: numbers coerced, unusable rows left out."""
    from barwright.functions.expr import flags_overlap

    if excluded_flags:
        bars = bars.filter(~flags_overlap(F.col("quality_flags"), excluded_flags))
    numeric = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume", "value")}
    return bars.withColumns(numeric).filter(F.col("close").isNotNull() & ~F.isnan("close"))


def total_of(c: str, step: int, times: int, w: WindowSpec) -> Column:
    """Sum over step * times rows of a column that holds sums over `step` rows."""
    parts = [F.coalesce(F.lag(c, step * i).over(w) if i else F.col(c), F.lit(0)) for i in range(times)]
    return sum(parts[1:], parts[0])


def with_moving_averages(df: DataFrame, beside: dict[str, Column]) -> DataFrame:
    """EMA family and RSI; needs the block column, a row's place in it and the first and previous close."""
    # deviation from the first close keeps a flat history exactly flat
    d, step = F.col("close") - F.col("_base"), F.col("close") - F.col("prev_close")
    # Wilder averages start at the first known step with its full weight
    weight = F.when(F.col("rn") == 2, 1.0).otherwise(1.0 / 14)
    fast, slow, line = 11.0 / 13, 25.0 / 27, 0.8
    df = recurrence.solve(
        df,
        {
            "_e12": (d * (2.0 / 13), fast),
            "_e26": (d * (2.0 / 27), slow),
            "_e9": (d, line),
            "_gain": (F.greatest(step, F.lit(0.0)) * weight, 13.0 / 14),
            "_loss": (F.greatest(-step, F.lit(0.0)) * weight, 13.0 / 14),
        },
        beside,
    )

    def smoothed(name: str, share: float, decay: float) -> Column:
        # average of an average: sum over i of line^(t-i) * decay^i is (decay^(t+1) - line^(t+1)) / (decay - line),
        # so the signal line needs no second pass over the rows
        return (F.col(name) * decay - F.col("_e9") * (line * share)) * ((1.0 - line) / (decay - line))

    signal = smoothed("_e12", 2.0 / 13, fast) - smoothed("_e26", 2.0 / 27, slow)
    df = df.withColumns({"macd": F.col("_e12") - F.col("_e26"), "macd_signal": signal})
    strength = F.when(F.col("_loss") == 0, F.when(F.col("_gain") > 0, 100.0).otherwise(50.0)).otherwise(
        100.0 - F.lit(100.0) / (F.lit(1.0) + F.try_divide("_gain", "_loss"))
    )
    return df.withColumns(
        {
            "ema_12": F.col("_base") + F.col("_e12"),
            "ema_26": F.col("_base") + F.col("_e26"),
            "macd_hist": F.col("macd") - F.col("macd_signal"),
            "rsi_14": F.when(F.col("rn") >= 15, strength),
        }
    ).drop("_base", "_e12", "_e26", "_e9", "_gain", "_loss")


def indicators(bars: DataFrame) -> DataFrame:
    """All indicators for every bar: one exchange by security, one sort.

    A frame of n rows costs n steps a row, and each pass over the rows copies them. So wide frames are put together
    from narrow ones (200 rows from four times 50, 50 from five times 10, 40 from two times 20), and columns are added in
    few passes.
    """
    w = history(recurrence.BLOCK, "date")
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    volume = F.col("volume").cast("double")
    df = recurrence.with_blocks(bars)
    prev = F.lag("close").over(w)
    ten, twenty = trailing(w, 10), trailing(w, 20)
    df = df.withColumns(
        {
            **recurrence.edges(),
            "prev_close": prev,
            "n_rows": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "_base": F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "return_1d": change(close, w, 1),
            "return_2d": change(close, w, 2),
            "return_3d": change(close, w, 3),
            "return_5d": change(close, w, 5),
            "return_20d": change(close, w, 20),
            "sma_20": mean(close, w, 20),
            "volume_sma_20": mean(volume, w, 20),
            "_std": guarded(F.stddev_samp, close, w, 20, 10),
            "_low": F.min("low").over(twenty),
            "_high": F.max("high").over(twenty),
            "_sum_10": F.sum("close").over(ten),
            "_n_10": F.count("close").over(ten),
        }
    )
    df = df.withColumn("_range", F.greatest(high - low, F.abs(high - F.col("prev_close")), F.abs(low - F.col("prev_close"))))
    df = df.withColumns(
        {
            **recurrence.place(),
            "bb_middle": F.col("sma_20"),
            "bb_upper": F.col("sma_20") + 2.0 * F.col("_std"),
            "bb_lower": F.col("sma_20") - 2.0 * F.col("_std"),
            "atr_14": F.avg("_range").over(trailing(w, 14)),
            "volatility_20": guarded(F.stddev_samp, F.col("return_1d"), w, 20, 20) * math.sqrt(252.0),
            "support": F.least("_low", F.lag("_low", 20).over(w)),
            "resistance": F.greatest("_high", F.lag("_high", 20).over(w)),
            "_sum_50": total_of("_sum_10", 10, 5, w),
            "_n_50": total_of("_n_10", 10, 5, w),
        }
    ).drop("_std", "_range", "_low", "_high", "_sum_10", "_n_10")
    sums = {"_sum_200": total_of("_sum_50", 50, 4, w), "_n_200": total_of("_n_50", 50, 4, w)}
    df = with_moving_averages(df, sums)
    return df.withColumns(
        {
            "sma_50": F.when(F.col("_n_50") >= 25, F.col("_sum_50") / F.col("_n_50")),
            "sma_200": F.when(F.col("_n_200") >= 100, F.col("_sum_200") / F.col("_n_200")),
        }
    ).drop("_sum_50", "_n_50", "_sum_200", "_n_200")


def latest(df: DataFrame) -> DataFrame:
    """Last row of every security; a history under 5 rows has no indicators."""
    return df.filter((F.col("rn") == F.col("n_rows")) & (F.col("n_rows") >= 5))


def snapshot(bars: DataFrame) -> DataFrame:
    """Technical snapshot per security."""
    return latest(indicators(bars)).select(*KEY, F.col("date").alias("as_of"), "close", "volume", *SNAPSHOT)


def refresh(bars: DataFrame, changed: DataFrame) -> DataFrame:
    """Snapshot of only those securities that have new bars."""
    return snapshot(bars.join(changed.select(*KEY).distinct(), KEY, "left_semi"))


def volatility_regime(df: DataFrame) -> DataFrame:
    """0 / 1 / 2 by the security's own trailing year of volatility.

    The current value is itself in the frame, so it lies at or below the
    linear-interpolation quantile p of n values exactly when no more than
    floor((n - 1) * p) of them are smaller: counting replaces sorting.
    """
    w = trailing(history(recurrence.BLOCK, "date"), 252)
    df = df.withColumn("_seen", F.collect_list("volatility_20").over(w))
    v, n = F.col("volatility_20"), F.size("_seen")
    df = df.withColumn("_less", F.when(n >= 60, F.size(F.filter("_seen", lambda x: x < v)))).withColumn("_n", n).drop("_seen")
    within = lambda p: F.col("_less") <= F.floor((F.col("_n") - 1) * F.lit(p))
    return df.withColumn(
        "vol_regime",
        F.when(F.col("_n") < 60, F.lit(None).cast("double"))
        .when(v.isNull(), 2.0)
        .when(within(0.33), 0.0)
        .when(within(0.67), 1.0)
        .otherwise(2.0),
    ).drop("_less", "_n")
