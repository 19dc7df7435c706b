"""Ordered counts over columns too long for one task.

Values are first collapsed to (value, counts) with map-side combine, then
summed in two levels: over value bins, and inside each bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_counts(df: DataFrame, groups: list[str], value: str, counts: list[str], width: float) -> DataFrame:
    """Per distinct value: each count, and `<count>_upto` = its sum over values <= this one."""
    flat = df.groupBy(*groups, value).agg(*[F.sum(c).alias(c) for c in counts])
    flat = flat.withColumn("_bin", F.floor(F.col(value) / width))
    bins = flat.groupBy(*groups, "_bin").agg(*[F.sum(c).alias(f"_b_{c}") for c in counts])
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*groups, "_bin", *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in counts])
    inside = Window.partitionBy(*groups, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    j = flat.join(bins, [*groups, "_bin"])
    j = j.withColumns({f"{c}_upto": F.col(f"_b_{c}") + F.sum(c).over(inside) for c in counts})
    return j.drop("_bin", *[f"_b_{c}" for c in counts])


def ranked_by_day(df: DataFrame, groups: list[str], day: str, ties: list[str], newest_first: bool = False) -> DataFrame:
    """1-based rank inside groups ordered by day and tie columns, with the group size.

    Days are counted first (calendar-bounded), rows are ranked inside a day.
    """
    per_day = df.groupBy(*groups, day).agg(F.count(F.lit(1)).alias("_n"))
    by_day = F.desc(day) if newest_first else F.asc(day)
    w = Window.partitionBy(*groups).orderBy(by_day)
    per_day = per_day.select(
        *groups, day,
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
    )
    inside = Window.partitionBy(*groups, day).orderBy(*ties)
    return df.join(per_day, [*groups, day]).withColumn("rank", F.col("_before") + F.row_number().over(inside)).drop("_before")


def area_under_curve(df: DataFrame, groups: list[str], truth: str, score: str, width: float = 1e-4) -> DataFrame:
    """ROC AUC with average ranks for ties; null where one class is missing."""
    marked = df.select(*groups, score, F.when(F.col(truth), 1).otherwise(0).alias("pos"), F.when(F.col(truth), 0).otherwise(1).alias("neg"))
    c = cumulative_counts(marked, groups, score, ["pos", "neg"], width)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    g = c.groupBy(*groups).agg(wins.alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return g.select(*groups, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def ks_distance(df: DataFrame, groups: list[str], value: str, first_sample: str, width: float = 1e-4) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p-value."""
    marked = df.select(*groups, value, F.when(F.col(first_sample), 1).otherwise(0).alias("a"), F.when(F.col(first_sample), 0).otherwise(1).alias("b"))
    c = cumulative_counts(marked, groups, value, ["a", "b"], width)
    total = marked.groupBy(*groups).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))
    g = c.join(total, groups).groupBy(*groups, "na", "nb").agg(F.max(gap).alias("statistic"))
    x = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("statistic")
    terms = [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x) for k in range(1, 101)]
    series = F.aggregate(F.array(*terms), F.lit(0.0), lambda acc, t: acc + t)
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    enough = (F.col("na") >= 5) & (F.col("nb") >= 5)
    return g.select(*groups, F.when(enough, F.col("statistic")).alias("ks"), F.when(enough, p).alias("ks_p"))
