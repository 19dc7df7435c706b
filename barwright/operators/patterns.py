"""Chart patterns and the rule score, for any bar of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import recurrence
from barwright.functions.expr import clip, ratio
from barwright.functions.rolling import KEY, history


def with_previous(ind: DataFrame) -> DataFrame:
    w = history(recurrence.BLOCK, "date")
    return ind.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("sma_50", "sma_200", "macd", "macd_signal")})


def _hit(test: Column, name: str, direction: str | Column, strength) -> Column:
    strength = F.lit(strength) if isinstance(strength, float) else strength
    direction = F.lit(direction) if isinstance(direction, str) else direction
    return F.when(
        test,
        F.struct(
            F.lit(name).alias("name"), direction.alias("direction"), F.bround(clip(strength, 0.0, 1.0), 3).alias("strength")
        ),
    )


def hits() -> Column:
    """Array of pattern structs of the current row, in reporting order."""
    c = F.col
    close, rsi = c("close"), c("rsi_14")
    volume_ratio = ratio(c("volume"), c("volume_sma_20"))
    near_low = (c("support") != 0) & (close <= c("support") * 1.02)
    near_high = (c("resistance") != 0) & (close >= c("resistance") * 0.98)
    low_first = (close - c("support")) <= (c("resistance") - close)
    golden = (c("prev_sma_50") <= c("prev_sma_200")) & (c("sma_50") > c("sma_200"))
    death = (c("prev_sma_50") >= c("prev_sma_200")) & (c("sma_50") < c("sma_200"))
    up = (c("prev_macd") <= c("prev_macd_signal")) & (c("macd") > c("macd_signal"))
    down = (c("prev_macd") >= c("prev_macd_signal")) & (c("macd") < c("macd_signal"))
    found = [
        _hit(golden, "Golden Cross", "bullish", 0.85),
        _hit(death, "Death Cross", "bearish", 0.85),
        _hit(rsi < 30, "RSI Oversold", "bullish", (F.lit(30.0) - rsi) / 30.0 + 0.5),
        _hit(rsi > 70, "RSI Overbought", "bearish", (rsi - 70.0) / 30.0 + 0.5),
        _hit(up, "MACD Bullish Cross", "bullish", 0.7),
        _hit(down, "MACD Bearish Cross", "bearish", 0.7),
        _hit(close <= c("bb_lower"), "BB Lower Touch", "bullish", 0.65),
        _hit((close >= c("bb_upper")) & (close > c("bb_lower")), "BB Upper Touch", "bearish", 0.65),
        _hit(
            (c("volume_sma_20") > 0) & (volume_ratio >= 2.0),
            "Volume Spike",
            F.when(close >= c("prev_close"), "bullish").otherwise("bearish"),
            volume_ratio / 4.0,
        ),
        _hit((close > c("sma_20")) & (c("sma_20") > c("sma_50")), "Uptrend Stack", "bullish", 0.55),
        _hit((close < c("sma_20")) & (c("sma_20") < c("sma_50")), "Downtrend Stack", "bearish", 0.55),
        _hit(near_low & (~near_high | low_first), "Near Support", "bullish", 0.5),
        _hit(near_high & (~near_low | ~low_first), "Near Resistance", "bearish", 0.5),
    ]
    # no two hits share a name, so leaving out the nulls as a set keeps all others in order, in compiled code
    return F.array_except(F.array(*found), F.array(F.lit(None)).cast("array<struct<name:string,direction:string,strength:double>>"))


def with_patterns(ind: DataFrame) -> DataFrame:
    """Pattern array per bar, empty while the history is under 30 bars."""
    df = with_previous(ind)
    none = F.array().cast("array<struct<name:string,direction:string,strength:double>>")
    return df.withColumn("patterns", F.when(F.col("n_rows") >= 30, hits()).otherwise(none))


def pattern_rows(with_pattern_array: DataFrame) -> DataFrame:
    # a plain explode would build every bar's array a second time, to drop bars whose array is empty
    rows = with_pattern_array.select(*KEY, F.col("date").alias("as_of"), F.explode_outer("patterns").alias("p")).filter("p IS NOT NULL")
    return rows.select(*KEY, "as_of", "p.name", "p.direction", "p.strength")


def pattern_points(patterns: Column) -> Column:
    sign = lambda d: F.when(d == "bullish", 1.0).when(d == "bearish", -1.0).otherwise(0.0)
    return F.aggregate(patterns, F.lit(0.0), lambda acc, p: acc + p["strength"] * sign(p["direction"]) * 12.0)


def score_parts(board: Column) -> list[tuple[Column, Column]]:
    """(points, reason) pairs; a null input gives 0 points and no reason."""
    c = F.col
    rsi, close, r20 = c("rsi_14"), c("close"), c("return_20d") * 100.0
    none = F.lit(None).cast("string")
    up = (close > c("sma_20")) & (c("sma_20") > c("sma_50"))
    down = (close < c("sma_20")) & (c("sma_20") < c("sma_50"))
    volume_up = (c("volume_sma_20") > 0) & (ratio(c("volume"), c("volume_sma_20")) > 1.5) & (c("return_5d") > 0)
    whole = lambda fmt, v: F.format_string(fmt, F.bround(v))
    tenth = lambda fmt, v: F.format_string(fmt, F.bround(v, 1))
    return [
        (
            F.when(rsi < 35, 18).when(rsi > 65, -18).when(rsi.isNotNull(), 4).otherwise(0),
            F.when(rsi < 35, whole("RSI oversold (%.0f)", rsi)).when(rsi > 65, whole("RSI elevated (%.0f)", rsi)),
        ),
        (
            F.when(c("macd_hist") > 0, 10).when(c("macd_hist").isNotNull(), -8).otherwise(0),
            F.when(c("macd_hist") > 0, "MACD histogram positive").when(c("macd_hist").isNotNull(), "MACD histogram negative"),
        ),
        (
            F.when(up, 15).when(down, -15).otherwise(0),
            # fixed values: texts a user sees
            F.when(up, "Short-term uptrend stack").when(down, "Short-term downtrend stack"),
        ),
        (
            F.when((r20 > 0) & (r20 < 12), 8).when(r20 > 25, -6).when(r20 < -15, 5).otherwise(0),
            F.when((r20 > 0) & (r20 < 12), tenth("Healthy 20d momentum (%.1f%%)", r20))
            .when(r20 > 25, "Extended 20d rally — chase risk")
            .when(r20 < -15, "Deep 20d pullback — mean-reversion watch"),
        ),
        (F.when(volume_up, 8).otherwise(0), F.when(volume_up, "Rising price on above-average volume").otherwise(none)),
    ]


def with_score(df: DataFrame) -> DataFrame:
    """Rule score in [-100, 100] and its reasons; needs patterns and board."""
    board, patterns = F.col("board"), F.col("patterns")
    parts = score_parts(board)
    total = sum((p for p, _ in parts[1:]), parts[0][0]).cast("double") + pattern_points(patterns)
    total = total + F.when(board == "Z", -25.0).when(board == "A", 5.0).otherwise(0.0)
    strong = F.transform(F.filter(patterns, lambda p: p["strength"] * 12.0 >= 6.0), lambda p: p["name"])
    reasons = F.concat(
        F.array_compact(F.array(*[r for _, r in parts])),
        strong,
        F.array_compact(F.array(F.when(board == "Z", F.lit("Z-group risk penalty")))),
    )
    return df.withColumns({"rule_score": clip(total, -100.0, 100.0), "reasons": reasons})
