"""Data-quality flags, gaps and provenance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.quantiles import exact_quantiles
from barwright.functions.rolling import KEY, history


def bar_violations() -> list[Column]:
    """Per-bar rule codes as nullable strings."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    priced = h.isNotNull() & l.isNotNull() & (h >= 0) & (l >= 0)
    sane = priced & (h >= l)
    rules = [
        (F.coalesce(F.col(x) <= 0, F.lit(True)), f"non_positive_{x}") for x in ("open", "high", "low", "close")
    ]
    rules += [
        (v < 0, "negative_volume"),
        (priced & (h < l), "high_below_low"),
        (sane & (o > 0) & ~o.between(l, h), "open_out_of_range"),
        (sane & (c > 0) & ~c.between(l, h), "close_out_of_range"),
    ]
    return [F.when(test, F.lit(code)) for test, code in rules]


def with_bar_flags(bars: DataFrame) -> DataFrame:
    return bars.withColumn("quality_flags", F.array_compact(F.array(*bar_violations())))


def with_history_facts(bars: DataFrame) -> DataFrame:
    """Gap length, jump size and stale-run length per bar.

    The stale run counts bars whose close repeats the previous close with
    volume; the first bar of the plateau is not part of the run.
    """
    w = history()
    df = bars.withColumns({"prev_date": F.lag("date").over(w), "prev_close": F.lag("close").over(w)})
    repeats = (F.col("close") == F.col("prev_close")) & (F.col("volume") > 0)
    df = df.withColumns(
        {
            "gap_days": F.date_diff("date", "prev_date"),
            "jump_pct": F.when(
                (F.col("prev_close") > 0) & (F.col("close") > 0),
                F.abs(F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100.0,
            ),
            "_repeats": F.coalesce(repeats, F.lit(False)),
        }
    )
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_island", F.count(F.when(~F.col("_repeats"), 1)).over(running))
    island = Window.partitionBy(*KEY, "_island")
    return df.withColumn(
        "stale_run", F.when(F.col("_repeats"), F.count(F.when(F.col("_repeats"), 1)).over(island)).otherwise(F.lit(0))
    ).drop("_repeats", "_island")


def full_scan(bars: DataFrame) -> DataFrame:
    """Recompute every flag of every bar; one exchange by security."""
    df = with_history_facts(bars)
    extra = [
        F.when(F.col("gap_days") > fixed.GAP_CALENDAR_DAYS, F.lit("gap_before")),
        F.when(F.col("jump_pct") >= fixed.ABNORMAL_JUMP_PCT, F.lit("abnormal_jump")),
        F.when(F.col("stale_run") >= fixed.STALE_RUN_MIN_LENGTH, F.lit("stale_quote_run")),
    ]
    return df.withColumn("quality_flags", F.array_sort(F.array_compact(F.array(*bar_violations(), *extra))))


def gaps(bars: DataFrame) -> DataFrame:
    return with_history_facts(bars).filter(F.col("gap_days") > fixed.GAP_CALENDAR_DAYS).select(
        *KEY, F.col("prev_date").alias("gap_start"), F.col("date").alias("gap_end"), F.col("gap_days").alias("days_missing")
    )


def scan_totals(flagged: DataFrame) -> DataFrame:
    """Long table of counts: rows, flagged rows, gaps and one row per flag.

    One pass, one row per partial aggregate: nothing is exploded per bar.
    """
    totals = flagged.agg(
        F.count(F.lit(1)).alias("rows_scanned"),
        F.count_if(F.size("quality_flags") > 0).alias("rows_flagged"),
        F.count_if(F.col("gap_days") > fixed.GAP_CALENDAR_DAYS).alias("gaps_found"),
        *[
            F.count_if(F.array_contains("quality_flags", f)).alias(f)
            for f in [*fixed.STRICT_EXCLUDE_FLAGS, "gap_before", "stale_quote_run"]
        ],
    )
    names = totals.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("total")) for n in names]))
    return totals.select(pairs.alias("p")).select("p.measure", "p.total")


def flag_histogram(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("quality_flags").alias("flag")).groupBy("flag").count()


def usable_for_training(flagged: DataFrame, strict: bool = False) -> DataFrame:
    from barwright.functions.expr import flags_overlap

    excluded = fixed.STRICT_EXCLUDE_FLAGS if strict else fixed.TRAINING_EXCLUDE_FLAGS
    return flagged.filter(~flags_overlap(F.col("quality_flags"), excluded))


def chronology_errors(bars: DataFrame) -> DataFrame:
    """Null or repeated dates per security; an empty result means the history is sound."""
    return (
        bars.groupBy(*KEY, "date")
        .count()
        .filter(F.col("date").isNull() | (F.col("count") > 1))
        .groupBy(*KEY)
        .agg(F.count_if(F.col("date").isNull()).alias("null_dates"), F.count_if(F.col("date").isNotNull()).alias("repeated_dates"))
    )


def assert_chronological(bars: DataFrame) -> DataFrame:
    """Fail the job when a history is broken, without a pass over the result."""
    bad = chronology_errors(bars).limit(1).count()
    if bad:
        raise ValueError("null or repeated dates in a bar history")
    return bars


def provenance_report(bars: DataFrame) -> DataFrame:
    """Rows by source with synthetic, unknown and flagged counts per exchange."""
    return bars.groupBy("exchange", "source").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("is_synthetic").alias("synthetic_rows"),
        F.count_if(F.col("source") == "unknown").alias("unknown_rows"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged_rows"),
        F.max("date").alias("latest_date"),
    )


def provenance_by_stock(bars: DataFrame) -> DataFrame:
    """Latest bar facts and counts by source and adjustment per security."""
    latest = F.max_by(F.struct("source", "is_synthetic", "adjustment_status", "quality_flags"), "date")
    return (
        bars.groupBy(*KEY)
        .agg(
            F.max("date").alias("latest_date"),
            latest.alias("l"),
            F.count_if(F.col("source") == "unknown").alias("unknown_rows"),
            F.count_if(F.col("source") != "unknown").alias("known_rows"),
            F.count_if(F.col("adjustment_status") == "raw").alias("raw_rows"),
        )
        .select(
            *KEY, "latest_date", F.col("l.source").alias("latest_source"), F.col("l.is_synthetic").alias("is_synthetic"),
            F.col("l.adjustment_status").alias("latest_adjustment"),
            F.array_join("l.quality_flags", ",").alias("latest_flags"), "known_rows", "unknown_rows", "raw_rows",
        )
    )


def research_summary(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Readiness facts per exchange with the 90 % sector-coverage gate."""
    s = (
        stocks.filter("is_active")
        .groupBy("exchange")
        .agg(F.count(F.lit(1)).alias("active_stocks"), F.count_if(F.col("sector") == "").alias("blank_sectors"))
    )
    b = bars.filter(~F.col("is_synthetic")).groupBy("exchange").agg(
        F.count(F.lit(1)).alias("price_rows"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged_rows"),
        F.count_if((F.col("source") == "unknown") | (F.col("adjustment_status") == "unknown")).alias("unknown_rows"),
    )
    covered = (F.col("active_stocks") - F.col("blank_sectors")) / F.col("active_stocks")
    return s.join(b, "exchange", "left").select(
        "exchange", "active_stocks", "blank_sectors", F.bround(covered * 100.0, 2).alias("coverage_pct"),
        (covered >= 0.90).alias("sector_usable"), "price_rows", "flagged_rows", "unknown_rows",
    )


def stock_quality(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Thin-data assessment of every active security.

    The liquidity cut is the nearest-rank 10th percentile of recent traded
    value inside an exchange, found without ranking an exchange in one task.
    """
    live = bars.filter(~F.col("is_synthetic"))
    last = live.groupBy("exchange").agg(F.max("date").alias("latest"))
    dates = live.select("exchange", "date").distinct()
    cutoff = F.date_sub(F.col("latest"), 60)
    expected = (
        dates.join(last, "exchange").filter(F.col("date") >= cutoff).groupBy("exchange").agg(F.count(F.lit(1)).alias("expected"))
    )
    per_stock = (
        live.join(last, "exchange")
        .groupBy(*KEY)
        .agg(
            F.count_if(F.col("date") >= cutoff).alias("recent_sessions"),
            F.count(F.lit(1)).alias("history_days"),
            F.avg(F.when(F.col("date") >= cutoff, F.col("value"))).alias("avg_value"),
        )
    )
    active = stocks.filter("is_active").select(*KEY)
    facts = active.join(per_stock, KEY, "left")
    ranked = facts.filter(F.col("recent_sessions") > 0).withColumn("traded", F.coalesce("avg_value", F.lit(0.0)))
    cut = exact_quantiles(ranked, ["exchange"], "traded", [0.10], discrete=True).select(
        "exchange", F.when(F.col("n") >= 10, F.get("q", F.lit(0))).alias("cut")
    )
    df = facts.join(expected, "exchange", "left").join(cut, "exchange", "left").join(last, "exchange", "left")
    reasons = F.when(
        F.col("latest").isNull(), F.array(F.lit("No price history is available yet"))
    ).otherwise(
        F.array_compact(
            F.array(
                # fixed values: texts a user sees
                F.when(F.coalesce("history_days", F.lit(0)) < 80, F.lit("Too little price history")),
                F.when(
                    F.coalesce("recent_sessions", F.lit(0)) < F.ceil(F.col("expected") * 0.8),
                    F.lit("Not traded regularly in the last 60 days"),
                ),
                F.when(F.coalesce("avg_value", F.lit(0.0)) <= F.col("cut"), F.lit("Recent traded value is in the lowest 10%")),
            )
        )
    )
    return df.select(
        *KEY, F.coalesce("recent_sessions", F.lit(0)).alias("recent_sessions"),
        F.coalesce("history_days", F.lit(0)).alias("history_days"), "avg_value",
        (F.size(reasons) > 0).alias("limited"), F.array_join(reasons, "; ").alias("reasons"),
    )
