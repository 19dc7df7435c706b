"""Screener: ranked lists, summaries, sentiment and sector views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import ratio, sentiment_label, sentiment_score
from barwright.functions.rolling import KEY
from barwright.operators.listing import enabled, latest_by, top_per_group


def newest(analysis: DataFrame, exchanges: list[str] = fixed.EXCHANGES) -> DataFrame:
    """Rows of the most recent analysis date on enabled exchanges."""
    as_of = analysis.select(F.max("as_of")).scalar()
    return enabled(analysis.filter(F.col("as_of") == as_of), exchanges)


def potential_shares(analysis: DataFrame, n: int = 20, min_score: float = 25) -> DataFrame:
    return newest(analysis).filter(F.col("score") >= min_score).orderBy(F.desc("score"), F.desc("confidence"), *KEY).limit(n)


def safe_buys(analysis: DataFrame, n: int = 10) -> DataFrame:
    return newest(analysis).filter(F.col("is_safe_buy") & (F.col("action") == "BUY")).orderBy(F.desc("score"), *KEY).limit(n)


def sell_candidates(analysis: DataFrame, n: int = 10) -> DataFrame:
    return newest(analysis).filter(F.col("action") == "SELL").orderBy("score", *KEY).limit(n)


def best_per_sector(analysis: DataFrame, n: int = 3, min_score: float = 20) -> DataFrame:
    df = newest(analysis).filter(F.col("score") >= min_score)
    df = df.withColumn("sector", F.when(F.col("sector") == "", "Other").otherwise(F.coalesce("sector", F.lit("Other"))))
    return top_per_group(df, ["sector"], [F.desc("score"), *map(F.asc, KEY)], n)


def digest(analysis: DataFrame) -> DataFrame:
    """Rows of the daily digest: 8 potential, 5 safe, 5 sell."""
    line = F.format_string("%s (%s) score=%.0f", "symbol", "exchange", F.bround("score"))
    parts = [
        potential_shares(analysis, 8).select(F.lit("potential").alias("section"), *KEY, line.alias("line")),
        safe_buys(analysis, 5).select(F.lit("safe").alias("section"), *KEY, F.substring("rationale", 1, 120).alias("line")),
        sell_candidates(analysis, 5).select(F.lit("sell").alias("section"), *KEY, line.alias("line")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def watchlist_brief(watchlist: DataFrame, analysis: DataFrame) -> DataFrame:
    """One line per watched security, also for those without an analysis."""
    now = latest_by(analysis.select(*KEY, "as_of", "action", "score", "confidence", "rationale"), KEY, "as_of")
    df = watchlist.join(now, KEY, "left")
    line = F.when(F.col("action").isNull(), "analysis is not available yet.").otherwise(
        F.concat(
            F.format_string("%s (score %.0f, confidence %.0f%%) - ", "action", F.bround("score"), F.bround(F.col("confidence") * 100.0)),
            F.substring("rationale", 1, 180),
        )
    )
    return df.select("user_id", *KEY, F.coalesce("action", F.lit("UNAVAILABLE")).alias("action"), line.alias("line"))


def watchlist_counts(brief: DataFrame) -> DataFrame:
    return brief.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("stocks"))


def summary(analysis: DataFrame) -> DataFrame:
    a = F.col("action")
    return newest(analysis).groupBy("as_of").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(a == x).alias(x.lower()) for x in fixed.ACTIONS],
        F.count_if("is_safe_buy").alias("research_candidates"),
    )


def market_snapshot(changes: DataFrame) -> DataFrame:
    """Advancers, decliners and unchanged per exchange and day."""
    c = F.col("change_pct")
    return changes.filter(c.isNotNull()).groupBy("exchange", "as_of").agg(
        F.count_if(c > 0).alias("advancers"), F.count_if(c < 0).alias("decliners"), F.count_if(c == 0).alias("unchanged")
    )


def sentiment(snapshots: DataFrame) -> DataFrame:
    a, d, u = F.col("advancers"), F.col("decliners"), F.col("unchanged")
    score = sentiment_score(a, d, u)
    return snapshots.withColumns(
        {"score": score, "label": sentiment_label(a, d, u), "needle_deg": F.bround(score * 0.9, 2)}
    )


def sector_heatmap(analysis: DataFrame, quoted: DataFrame) -> DataFrame:
    """Latest analyses by sector with a 0-100 heat value."""
    now = latest_by(analysis.select(*KEY, "as_of", "action", "score"), KEY, "as_of")
    df = now.join(quoted.filter("is_active").select(*KEY, "sector", "last_change_pct"), KEY)
    label = F.when(F.col("sector") == "", "Unclassified").otherwise(F.coalesce("sector", F.lit("Unclassified")))
    g = df.groupBy(label.alias("sector")).agg(
        F.count(F.lit(1)).alias("stocks"),
        F.count_if(F.col("action") == "BUY").alias("buy"),
        F.count_if(F.col("action") == "SELL").alias("sell"),
        F.bround(F.avg(F.col("score").cast("decimal(10,2)")).cast("double"), 1).alias("avg_score"),
        F.bround(F.avg("last_change_pct"), 2).alias("avg_change"),
    )
    return g.withColumn("heat", F.greatest(F.lit(0), F.least(F.lit(100), F.bround((F.col("avg_score") + 100.0) / 2.0).cast("long"))))


def sector_pe(stocks: DataFrame) -> DataFrame:
    return stocks.filter(F.col("pe_ratio") > 0).groupBy("sector").agg(F.bround(F.avg("pe_ratio"), 2).alias("sector_pe"))


def liquid_universe(bars: DataFrame, as_of, n: int = fixed.LIQUID_TOP_N, days: int = 45) -> DataFrame:
    """Top securities by mean volume in the trailing window as of a day."""
    recent = bars.filter(F.col("date").between(F.date_sub(as_of, days), as_of))
    g = recent.groupBy(*KEY).agg(F.avg("volume").alias("avg_volume"))
    return g.orderBy(F.desc("avg_volume"), *KEY).limit(n)


def traded_value_universe(
    bars: DataFrame, stocks: DataFrame, as_of, least_value: float, n: int = 40, rows: int = 60, least_rows: int = 40
) -> DataFrame:
    """Securities by mean traded value of their last clean bars before a day."""
    from barwright.functions.expr import flags_overlap

    past = bars.filter((F.col("date") <= as_of) & (F.col("source") != "unknown"))
    last = top_per_group(past, KEY, [F.desc("date")], rows)
    clean = last.filter(~flags_overlap(F.col("quality_flags"), fixed.STRICT_EXCLUDE_FLAGS))
    value = F.greatest(F.coalesce("value", F.lit(0.0)), F.coalesce(F.col("close") * F.col("volume"), F.lit(0.0)))
    g = clean.groupBy(*KEY).agg(F.count(F.lit(1)).alias("clean_rows"), F.avg(value).alias("avg_traded_value"))
    ok = g.filter((F.col("clean_rows") >= least_rows) & (F.col("avg_traded_value") >= least_value))
    eligible = stocks.filter(F.col("is_active") & (F.col("board") != "Z")).select(*KEY)
    return ok.join(eligible, KEY, "left_semi").orderBy(F.desc("avg_traded_value"), *KEY).limit(n)


def prediction_volume(analysis: DataFrame, n: int = 7) -> DataFrame:
    """Row counts of the latest analysis dates."""
    return analysis.groupBy("as_of").agg(F.count(F.lit(1)).alias("rows_written")).orderBy(F.desc("as_of")).limit(n)


def expected_change(analysis: DataFrame, quoted: DataFrame) -> DataFrame:
    from barwright.functions.expr import peak_price, tick_price

    df = analysis.join(quoted.select(*KEY, "last_price"), KEY)
    peak = peak_price(F.col("last_price"), F.col("expected_return_pct"))
    return df.select(
        *KEY, "as_of", "last_price", "expected_return_pct", peak.alias("peak_price"), tick_price(F.col("last_price")).alias("tick_price"),
        ratio(peak, F.col("last_price")).alias("peak_ratio"),
    )
