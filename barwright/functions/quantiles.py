"""Exact order statistics of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20000
MARGIN = 0.001
# the margin is MARGIN * n ranks, the sketch errs by n / ACCURACY: with fewer rows than this the margin may not cover
# the error and rounding to whole ranks, so the bracket is the whole group, which holds fewer rows than this
BRACKETED_FROM = 5000


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], discrete: bool = False) -> DataFrame:
    """Columns: groups, n, q (array aligned with probs), null values ignored.

    A mergeable sketch brackets each wanted rank, every row is counted against
    the brackets with map-side combine, and only the values inside a bracket
    (about 0.2 % of a group, already collapsed to value and count) are ranked.
    Continuous quantiles interpolate linearly between neighbouring ranks.
    """
    if not groups:
        raise ValueError("name at least one group column")
    data = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    bounds = [max(p - MARGIN, 0.0) for p in probs] + [min(p + MARGIN, 1.0) for p in probs]
    brackets = data.groupBy(*groups).agg(
        F.percentile_approx("_v", F.array(*map(F.lit, bounds)), ACCURACY).alias("_at"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.count(F.lit(1)).alias("n"),
    )
    ends = []
    for j, p in enumerate(probs):
        whole = F.col("n") < BRACKETED_FROM
        lo = F.col("_min") if p <= MARGIN else F.when(whole, F.col("_min")).otherwise(F.get("_at", F.lit(j)))
        hi = F.col("_max") if p >= 1 - MARGIN else F.when(whole, F.col("_max")).otherwise(F.get("_at", F.lit(len(probs) + j)))
        pos = (F.col("n") - 1) * F.lit(p)
        first = F.ceil(F.col("n") * F.lit(p) - 1e-9) if discrete else F.floor(pos) + 1
        ends.append(
            F.struct(
                F.lit(j).alias("j"), lo.alias("lo"), hi.alias("hi"),
                F.greatest(first, F.lit(1)).cast("long").alias("k"), (pos - F.floor(pos)).alias("part"),
            )
        )
    wanted = brackets.select(*groups, "n", F.explode(F.array(*ends)).alias("e")).select(*groups, "n", "e.*")
    # one row a group and quantile; a shuffle by group would send a whole group to one task
    j = data.join(F.broadcast(wanted), groups)
    below = j.groupBy(*groups, "j").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"))
    inside = j.filter(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*groups, "j", "_v").agg(F.count(F.lit(1)).alias("c"))
    # the neighbour above the bracket is needed when a rank ends it
    above = j.filter(F.col("_v") > F.col("hi")).groupBy(*groups, "j").agg(F.min("_v").alias("_v"), F.lit(1).cast("long").alias("c"))
    ranked = inside.unionByName(above).join(below, [*groups, "j"]).join(wanted.select(*groups, "j", "k", "part", "n"), [*groups, "j"])
    w = Window.partitionBy(*groups, "j").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("upto", F.col("below") + F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("_v")))
    picked = ranked.groupBy(*groups, "j").agg(
        at(F.col("k")).alias("a"), at(F.least(F.col("k") + 1, F.col("n"))).alias("b"), F.first("part").alias("part"), F.first("n").alias("n"),
        F.max(F.col("below") - F.col("k")).alias("_over"),
    )
    # a rank outside its bracket would give a wrong value silently: stop instead
    missed = (F.col("_over") >= 0) | F.col("a").isNull() | F.col("b").isNull()
    picked = picked.withColumn("a", F.when(missed, F.raise_error(F.lit("a quantile's bracket misses its rank")).cast("double")).otherwise(F.col("a")))
    val = F.col("a") if discrete else F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return picked.groupBy(*groups).agg(
        F.first("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("j", val.alias("v")))), lambda s: s["v"]).alias("q"),
    )
