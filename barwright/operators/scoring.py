"""Full-universe analysis: score, action, risk, confidence and rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.expr import clip
from barwright.functions.rolling import KEY
from barwright.operators import analogue, patterns
from barwright.operators.indicators import indicators


# what a score, its patterns and its reasons read from a security's last bar
LAST_BAR = [
    "date", "n_rows", "close", "prev_close", "volume", "volume_sma_20", "sma_20", "sma_50", "sma_200", "prev_sma_50", "prev_sma_200",
    "macd", "macd_signal", "macd_hist", "prev_macd", "prev_macd_signal", "rsi_14", "bb_lower", "bb_upper", "support", "resistance",
    "volatility_20", "return_5d", "return_20d",
]


def action_from(score: Column) -> Column:
    return (
        F.when(score >= 25, "BUY").when(score <= -25, "SELL").when(F.abs(score) >= 12, "WATCH").otherwise("HOLD")
    )


def risk_from(vol: Column, board: Column) -> Column:
    return (
        F.when(board == "Z", "high").when(vol.isNull(), "medium").when(vol < 0.25, "low").when(vol > 0.45, "high").otherwise("medium")
    )


def with_pe(score: Column, pe: Column) -> Column:
    bonus = F.when((pe > 0) & (pe < 12), 6.0).when(pe > 30, -8.0).otherwise(0.0)
    return clip(score + bonus, -100.0, 100.0)


def blended(rule: Column, probability: Column) -> Column:
    """Rule score mixed with a model probability; the rule score alone without one."""
    mixed = clip(rule * 0.7 + (probability - 0.5) * 60.0, -100.0, 100.0)
    return F.when(probability.isNull(), rule).otherwise(mixed)


def scored_history(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Rule score, P/E adjustment, action and risk at every bar."""
    df = patterns.with_patterns(indicators(bars)).join(stocks.select(*KEY, "board", "pe_ratio"), KEY, "left")
    df = patterns.with_score(df)
    score = with_pe(F.col("rule_score"), F.col("pe_ratio"))
    return df.withColumns({"score": score, "action": action_from(score), "risk_level": risk_from(F.col("volatility_20"), F.col("board"))})


def analysis(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """One analysis row per security at its latest bar."""
    ind = analogue.with_paths(patterns.with_previous(indicators(bars)))
    # only setups and last bars say something here, and only some of a last bar's columns
    ind = analogue.path_summary(ind.filter(F.col("_path").isNotNull() | (F.col("rn") == F.col("n_rows"))))
    row = F.struct(*LAST_BAR)
    # the last bar and the episode statistics come out of one aggregation over
    # rows that are already partitioned by security
    last = ind.groupBy(*KEY).agg(F.max_by(row, "date").alias("_now"), *analogue.setup_statistics())
    last = last.select(*KEY, "_now.*", *[c for c in last.columns if c not in KEY and c != "_now"])
    none = F.array().cast("array<struct<name:string,direction:string,strength:double>>")
    now = (
        last.filter(F.col("n_rows") >= 5)
        .withColumn("patterns", F.when(F.col("n_rows") >= 30, patterns.hits()).otherwise(none))
        .join(stocks.select(*KEY, "board", "pe_ratio", "sector"), KEY, "left")
    )
    df = patterns.with_score(now)
    pe, hit, n = F.col("pe_ratio"), F.col("hit_rate"), F.coalesce("samples", F.lit(0))
    score = with_pe(F.col("rule_score"), pe)
    enough = F.col("n_rows") >= 30
    base = F.least(F.lit(0.92), F.lit(0.35) + F.abs(score) / 150.0 + F.when(n > 10, 0.15).otherwise(0.0))
    confidence = F.when(hit.isNull(), base).otherwise(F.least(F.lit(0.95), (base + hit) / 2.0 + 0.15))
    risk = risk_from(F.col("volatility_20"), F.col("board"))
    df = df.withColumns(
        {
            "_score": score,
            "action": F.when(enough, action_from(score)).otherwise("HOLD"),
            "risk_level": F.when(enough, risk).otherwise("high"),
            "_confidence": confidence,
        }
    )
    safe = (
        enough
        & (F.col("action") == "BUY")
        & (F.col("risk_level") != "high")
        & (F.col("board") != "Z")
        & (F.col("_score") >= 28)
        & (F.col("_confidence") >= 0.4)
        & (hit.isNull() | (hit >= 0.35))
    )
    pe_reason = F.when((pe > 0) & (pe < 12), F.format_string("Attractive P/E (%.1f)", F.bround(pe, 1))).when(
        pe > 30, F.format_string("Elevated P/E (%.1f)", F.bround(pe, 1))
    )
    reasons = F.slice(F.concat(F.col("reasons"), F.array_compact(F.array(pe_reason))), 1, 6)
    history_parts = F.array_compact(
        F.array(
            F.when(
                F.col("maturity_days") > 0,
                F.format_string(
                    "Historically, similar setups matured (~+5%%) in ~%d days (hit rate %.0f%% over %d samples).",
                    F.col("maturity_days"), F.bround(hit * 100.0), n,
                ),
            ),
            F.when(F.col("peak_days") > 0, F.format_string("Median days to local peak after setup: ~%d.", F.col("peak_days"))),
            F.when(
                F.col("return_p25").isNotNull(),
                F.format_string(
                    "Peak-return range across those episodes: %.1f%% to %.1f%% (typical downside within the same window: %.1f%%).",
                    F.bround("return_p25", 1), F.bround("return_p75", 1), F.bround("downside_return", 1),
                ),
            ),
        )
    )
    parts = F.concat(reasons, history_parts)
    # fixed values: texts a user sees
    rationale = F.when(~enough, "Insufficient history (need ~30+ sessions).").otherwise(
        F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("Neutral posture.")
    )
    return df.select(
        *KEY, "sector", "board", F.col("date").alias("as_of"), "n_rows", "close",
        "action",
        F.when(enough, F.bround("_score", 2)).otherwise(0.0).alias("score"),
        F.when(enough, F.bround("_confidence", 3)).otherwise(0.1).alias("confidence"),
        "risk_level",
        F.coalesce(safe, F.lit(False)).alias("is_safe_buy"),
        F.col("maturity_days").alias("maturity_days_est"),
        F.col("peak_days").alias("peak_days_est"),
        F.bround("avg_return", 2).alias("expected_return_pct"),
        F.bround("hit_rate", 3).alias("probability"),
        rationale.alias("rationale"),
        F.size("patterns").alias("pattern_count"),
        "patterns",
        n.alias("samples"),
        "rsi_14", "macd_hist", "sma_20", "sma_50", "volatility_20", "return_20d", "pe_ratio",
    )


def with_model_score(result: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Blend a model probability (security, as_of) into analysis rows and re-gate them."""
    p = F.when(F.col("n_rows") >= 80, F.col("ml_probability"))
    df = result.join(probabilities.select(*KEY, "ml_probability"), KEY, "left")
    score = F.when(p.isNull(), F.col("score")).otherwise(F.bround(blended(F.col("score"), p), 2))
    action = F.when(p.isNull(), F.col("action")).otherwise(action_from(blended(F.col("score"), p)))
    df = df.withColumns({"_s": score, "_a": action, "ml_score": F.bround(p * 100.0, 2)})
    keep = F.col("is_safe_buy") & (p.isNull() | ((F.col("_a") == "BUY") & (F.col("_s") >= 28) & (F.col("confidence") >= 0.4)))
    return df.withColumns({"score": F.col("_s"), "action": F.col("_a"), "is_safe_buy": keep}).drop("_s", "_a", "ml_probability")
