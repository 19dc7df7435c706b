"""Historical-analogue estimates from a security's own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import recurrence
from barwright.functions.expr import clip, confidence_label, tick_price
from barwright.functions.rolling import KEY, history


def with_paths(with_prev: DataFrame, horizon: int = 40) -> DataFrame:
    """The next 40 closes on rows that are past setups, null elsewhere."""
    w = history(recurrence.BLOCK, "date").rowsBetween(1, horizon)
    c = F.col
    crossed = (c("prev_macd") <= c("prev_macd_signal")) & (c("macd") > c("macd_signal"))
    i = c("rn") - 1
    setup = (
        (F.coalesce(c("rsi_14") < 40, F.lit(False)) | F.coalesce(crossed, F.lit(False)))
        & (c("n_rows") >= 80)
        & (i >= 40)
        & (i < c("n_rows") - 40)
        & (c("close") > 0)
    )
    return with_prev.withColumn("_path", F.collect_list("close").over(w)).withColumn("_path", F.when(setup, F.col("_path")))


def path_summary(with_path: DataFrame, target: float = 0.05) -> DataFrame:
    c = F.col
    df = with_path.withColumn("_best", F.array_max("_path"))
    reached = F.array_position(F.transform("_path", lambda x: x >= c("close") * (1.0 + target)), True)
    return df.withColumns(
        {
            "maturity_days": F.when(reached > 0, reached),
            "peak_days": F.array_position("_path", c("_best")),
            "peak_ret": (c("_best") / c("close") - 1.0) * 100.0,
            "trough_ret": (F.array_min("_path") / c("close") - 1.0) * 100.0,
        }
    ).drop("_path", "_best")


def with_episodes(with_prev: DataFrame, target: float = 0.05, horizon: int = 40) -> DataFrame:
    """Summary of the next 40 closes on rows that are past setups, null elsewhere."""
    return path_summary(with_paths(with_prev, horizon), target)


def setup_episodes(with_prev: DataFrame) -> DataFrame:
    """One row per past setup."""
    df = path_summary(with_paths(with_prev).filter(F.col("_path").isNotNull())).filter(F.col("peak_days").isNotNull())
    return df.select(*KEY, "date", "maturity_days", "peak_days", "peak_ret", "trough_ret")


def setup_statistics() -> list[Column]:
    """Medians, hit rate and ranges over the episodes of a security.

    A security has at most one episode per calendar day, so these exact
    percentiles hold a bounded list.
    """
    n = F.count("peak_days")
    return [
        F.bround(F.percentile("maturity_days", 0.5)).cast("long").alias("maturity_days"),
        F.bround(F.percentile("peak_days", 0.5)).cast("long").alias("peak_days"),
        F.try_divide(F.count("maturity_days"), n).alias("hit_rate"),
        F.avg("peak_ret").alias("avg_return"),
        n.alias("samples"),
        F.when(n >= 10, F.percentile("peak_ret", 0.25)).alias("return_p25"),
        F.when(n >= 10, F.percentile("peak_ret", 0.75)).alias("return_p75"),
        F.when(n >= 10, F.avg("trough_ret")).alias("downside_return"),
    ]


def setup_summary(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(*KEY).agg(*setup_statistics())


def sorted_percentile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolation percentile of a sorted array."""
    pos = (F.size(sorted_values) - 1) * F.lit(p)
    low = F.floor(pos).cast("int")
    high = F.least(low + 1, F.size(sorted_values) - 1)
    a, b = F.get(sorted_values, low), F.get(sorted_values, high)
    return a + (b - a) * (pos - low)


def trading_days(start: Column, end: Column) -> Column:
    """Sunday-to-Thursday days in (start, end]; holidays are not removed."""
    # days since a Sunday, so that a week's first five positions are sessions
    at = lambda d: F.unix_date(d) + 4  # noqa: E731  1970-01-01 was a Thursday
    upto = lambda n: F.floor((n + 1) / 7) * 5 + F.least(F.pmod(n + 1, F.lit(7)), F.lit(5))
    return F.greatest(upto(at(end)) - upto(at(start)), F.lit(0)).cast("int")


def close_arrays(bars: DataFrame) -> DataFrame:
    """Closes of a security in date order: one array, bounded by the calendar."""
    return bars.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("date", "close"))).alias("h"), F.max("date").alias("last_date")
    ).select(*KEY, "last_date", F.transform("h", lambda x: x["date"]).alias("dates"), F.transform("h", lambda x: x["close"]).alias("closes"))


def price_at_date(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Estimated close for (security, target_date) requests.

    A recorded date returns its close; a future date the median forward
    return over all past starts at the same session distance.
    """
    df = requests.join(close_arrays(bars), KEY)
    n = F.size("closes")
    target, last_date = F.col("target_date"), F.col("last_date")
    spot = F.array_position("dates", target)
    steps = F.greatest(trading_days(last_date, target), F.lit(1))
    df = df.withColumns(
        {
            "last_close": F.element_at("closes", -1),
            "_spot": spot,
            "horizon": F.when(spot > 0, 0).otherwise(steps),
            "mode": F.when(n < 30, "insufficient")
            .when(spot > 0, "actual")
            .when(target < last_date, "missing")
            .when(steps > 180, "too_far")
            .otherwise("forecast"),
        }
    )
    starts = F.when(n > F.col("horizon"), F.sequence(F.lit(0), n - F.col("horizon") - 1)).otherwise(F.array().cast("array<int>"))
    fwd = F.transform(
        F.filter(starts, lambda i: F.get("closes", i) > 0), lambda i: F.get("closes", i + F.col("horizon")) / F.get("closes", i) - 1.0
    )
    df = df.withColumn("_fwd", F.when(F.col("mode") == "forecast", F.sort_array(fwd)))
    daily = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("closes", i) / F.get("closes", i - 1) - 1.0)
    recent = F.slice(daily, F.greatest(F.size(daily) - 59, F.lit(1)), 60)
    df = df.withColumn("_recent", F.when((F.col("mode") == "forecast") & (F.size("_fwd") < 8), recent))
    r, h = F.col("_recent"), F.col("horizon").cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mu = total(r) / F.size(r)
    spread = F.sqrt(total(F.transform(r, lambda x: (x - mu) * (x - mu))) / (F.size(r) - 1))
    sigma = F.when(spread == 0, 0.02).otherwise(spread) * F.sqrt(h)
    drift = F.pow(mu + 1.0, h) - 1.0
    few = F.size("_fwd") < 8
    pick = lambda p, k: F.when(few, drift - sigma * k).otherwise(sorted_percentile(F.col("_fwd"), p))
    df = df.withColumns(
        {
            "method": F.when(F.col("mode") == "forecast", F.when(few, "drift").otherwise("analogues")),
            "samples": F.when(F.col("mode") == "actual", 1).when(few, F.size("_recent")).otherwise(F.size("_fwd")),
            "med": pick(0.5, 0.0),
            "p25": pick(0.25, 0.675),
            "p75": pick(0.75, -0.675),
            "p10": pick(0.10, 1.2816),
        }
    )
    last = F.col("last_close")
    penalty = clip(F.lit(1.0) - F.abs(F.col("p75") - F.col("p25")) * 1.2, 0.35, 1.0)
    trust = clip(
        F.lit(0.22) + F.lit(0.55) * F.least(F.lit(1.0), F.col("samples") / 40.0) * F.exp(-h / 55.0) * penalty, 0.08, 0.88
    )
    confidence = F.when(F.col("mode") == "actual", 0.99).when(few, F.least(trust, F.lit(0.45))).otherwise(trust)
    down = F.col("p25") - F.greatest(F.lit(0.0), F.col("p25") - F.col("p10"))
    recorded = F.bround(F.element_at("closes", F.when(F.col("_spot") > 0, F.col("_spot").cast("int")).otherwise(1)), 2)
    actual, ahead = F.col("mode") == "actual", F.col("mode") == "forecast"
    return df.select(
        *KEY, "target_date", "mode", "last_date", "horizon", "method", F.when(actual | ahead, F.col("samples")).alias("samples"),
        F.when(actual, recorded).when(ahead, tick_price(last * (F.col("med") + 1.0))).alias("predicted_price"),
        F.when(actual, recorded).when(ahead, tick_price(last * (F.least("p25", "p75") + 1.0))).alias("price_low"),
        F.when(actual, recorded).when(ahead, tick_price(last * (F.greatest("p25", "p75") + 1.0))).alias("price_high"),
        F.when(ahead & (F.col("samples") >= 10), tick_price(last * (down + 1.0))).alias("price_downside"),
        F.when(ahead, F.bround(F.col("med") * 100.0, 2)).when(actual, F.bround((recorded / last - 1.0) * 100.0, 2)).alias("expected_return_pct"),
        F.when(actual | ahead, F.bround(confidence, 3)).alias("confidence"),
        F.when(actual | ahead, confidence_label(confidence)).alias("confidence_label"),
    )


def one_day(bars: DataFrame, least: int = 40) -> DataFrame:
    """Median next-day return, spread and sample count per security."""
    w = history()
    rets = bars.withColumns(
        {"_f": F.when(F.col("close") > 0, F.lead("close").over(w) / F.col("close") - 1.0), "rn_": F.row_number().over(w)}
    )
    g = rets.groupBy(*KEY).agg(
        F.percentile("_f", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.count("_f").alias("samples"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max_by("close", "date").alias("last_close"),
        F.max("date").alias("as_of"),
    )
    ok = (F.col("n_rows") >= least) & (F.col("samples") >= 10)
    return g.select(
        *KEY, "as_of", "last_close", "n_rows",
        F.when(ok, F.col("q")[1]).otherwise(0.0).alias("analogue_ret"),
        F.when(ok, F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.005))).otherwise(0.04).alias("spread"),
        F.when(ok, F.col("samples")).otherwise(0).alias("samples"),
    )
