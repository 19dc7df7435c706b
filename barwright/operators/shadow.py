"""Shadow candidates: forecasts that are generated and settled beside the served ones, and never served.

State is an append-only log of two tables under one path: `generated` (by target date and cycle) and `settled` (by cycle).
A cycle writes its own folders only, so a repeated cycle replaces what it wrote, and nothing of an earlier one changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.rolling import KEY
from barwright.operators import calendar, features, forecast, models, panel
from barwright.operators.joins import append_new

ANALOGUE, REGRESSION = "shadow_analogue", "shadow_regression"
FORECAST = [*KEY, "as_of", "last_close", "predicted_close", "predicted_return"]
GENERATED = "candidate string, exchange string, symbol string, as_of date, last_close double, predicted_close double, predicted_return double, target_date date, cycle date"
SETTLED = "candidate string, exchange string, symbol string, target_date date, actual_close double, cycle date"
ID = ["candidate", *KEY, "target_date"]
LEAST_TRAIN = 100
Predict = Callable[[DataFrame], DataFrame]


def analogue(learned: DataFrame | None = None) -> Predict:
    """The served blend without bias correction and without the naive gate."""
    return lambda bars: forecast.next_close(bars, learned).select(*FORECAST)


def regression(stocks: DataFrame, members: DataFrame, trees: int = 140) -> Predict:
    """Zero-inflated return, fitted anew at every cycle on the panel known then; no forecast while the panel is short."""

    def predict(bars: DataFrame) -> DataFrame:
        names = fixed.NEXT_CLOSE_FEATURES
        rows = panel.next_close_panel(bars, stocks, members)
        last = bars.groupBy(*KEY).agg(F.max("date").alias("as_of"), F.max_by("close", "date").alias("_close"), F.count(F.lit(1)).alias("_n"))
        last = last.filter((F.col("_n") >= fixed.MIN_HISTORY) & (F.col("_close") > 0)).join(members.select(*KEY), KEY, "left_semi")
        if rows.count() < LEAST_TRAIN:
            return forecast.next_close(bars.limit(0)).select(*FORECAST)
        fitted = models.fit_zero_inflated(rows, names, trees=trees)
        now = features.latest_vector(bars, stocks).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})
        said = models.predict_zero_inflated(fitted, now, names).select(*KEY, "predicted_return").join(last, KEY)
        r = F.col("predicted_return")
        return said.select(*KEY, "as_of", F.bround("_close", 4).alias("last_close"), F.bround(F.col("_close") * (r + 1.0), 4).alias("predicted_close"), F.bround(r, 6).alias("predicted_return"))

    return predict


def create(spark: SparkSession, path: str) -> None:
    """An empty log; one that exists is left as it is."""
    for table, schema in (("generated", GENERATED), ("settled", SETTLED)):
        keys = [c for c in ("target_date", "cycle") if table == "generated" or c == "cycle"]
        empty = spark.createDataFrame([], schema).drop(*keys)
        inner = "/".join(f"{c}=0001-01-01" for c in keys)
        empty.write.mode("ignore").parquet(f"{path}/{table}/{inner}")


def generated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENERATED).parquet(f"{path}/generated")


def settled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SETTLED).parquet(f"{path}/settled")


def run_cycle(spark: SparkSession, path: str, bars: DataFrame, active: DataFrame, cal: DataFrame, as_of: dt.date, candidates: dict[str, Predict]) -> dt.date:
    """Settle what is due, then forecast the next session for active securities; returns that session.

    bars: confirmed real ones; only those up to as_of are seen. A forecast of the same candidate, security and target on
    record from another cycle stays, and is not made again. Forecasts without a bar on the target day stay pending.
    """
    day = F.lit(as_of)
    following = calendar.nth_session(cal, 1).filter(F.col("date") == day).first()
    if following is None:
        raise ValueError(f"the calendar has no session after {as_of}")
    target = following["target_date"]
    known = bars.filter(F.col("date") <= day)
    own = F.col("cycle") == day

    actual = known.select(*KEY, F.col("date").alias("target_date"), F.col("close").alias("actual_close")).dropna(subset=["actual_close"])
    due = generated(spark, path).filter((F.col("target_date") <= day) & ~own).join(settled(spark, path).filter(~own), ID, "left_anti")
    due.join(actual, [*KEY, "target_date"]).select(*ID, "actual_close").write.mode("overwrite").parquet(f"{path}/settled/cycle={as_of}")

    made = None
    for name, predict in candidates.items():
        one = predict(known).join(active.select(*KEY), KEY, "left_semi").select(F.lit(name).alias("candidate"), *FORECAST)
        made = one if made is None else made.unionByName(one)
    at_target = generated(spark, path).filter((F.col("target_date") == F.lit(target)) & ~own)
    new = append_new(at_target, made.withColumn("target_date", F.lit(target)), ID)
    new.drop("target_date").write.mode("overwrite").parquet(f"{path}/generated/target_date={target}/cycle={as_of}")
    return target


def current(spark: SparkSession, path: str) -> DataFrame:
    """Every forecast with its actual close and the cycle that settled it; null while pending."""
    done = settled(spark, path).select(*ID, "actual_close", F.col("cycle").alias("settled_on"))
    return generated(spark, path).join(done, ID, "left")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Error, skill, direction and trend of each candidate over its settled forecasts."""
    return forecast.shadow_report(current(spark, path).filter(F.col("actual_close").isNotNull()))
