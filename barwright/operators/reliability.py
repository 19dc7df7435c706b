"""Reliability of captured predictions: capture, settlement, metrics, drift, reports."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import clip, confidence_label, evidence_label, ratio, schema_hash
from barwright.functions.quantiles import exact_quantiles
from barwright.functions.ranking import area_under_curve, ks_distance, ranked_by_day
from barwright.functions.rolling import KEY
from barwright.operators.joins import append_new
from barwright.operators.panel import balanced_accuracy, classification_columns, regression_metrics
from barwright.session import cut_lineage

RUIN = -1e4  # logarithm of what is left after a loss of everything: zero for every purpose
UNIQUE = ["family", "version", *KEY, "data_cutoff", "horizon"]


def capture(served: DataFrame, features: list[str], persistence: DataFrame, existing: DataFrame) -> DataFrame:
    """Immutable prediction rows; a second run of the same day adds nothing.

    served: family, version, KEY, data_cutoff, horizon, target_date,
    reference_close, predicted_return, predicted_class, probability, confidence.
    """
    df = served.join(persistence, KEY, "left").withColumns(
        {
            "schema_hash": schema_hash(F.array(*map(F.lit, features))),
            "rule_baseline_return": F.col("persistence_return"),
            "naive_baseline_return": F.lit(0.0),
            "confidence_label": confidence_label(F.col("confidence")),
            "settlement_status": F.lit("PENDING"),
        }
    ).drop("persistence_return")
    return append_new(existing, df, UNIQUE)


def daily_versions(states: DataFrame, groups: list[str], date: str, order: list[str], through: Column, day: str = "data_cutoff") -> DataFrame:
    """Each group's newest state (by date, then `order`) for every day up to `through`: an equality join stands in for
    the as-of join, and the table is bounded by groups times the calendar."""
    newest = states.groupBy(*groups, date).agg(F.max(F.struct(*order, *[c for c in states.columns if c not in (*groups, date, *order)])).alias("_s")).select(*groups, date, "_s.*")
    following = F.lead(date).over(Window.partitionBy(*[F.col(c) for c in groups] or [F.lit(0)]).orderBy(date))
    until = F.coalesce(F.date_sub(following, 1), through)
    return newest.withColumn("_until", until).filter(F.col("_until") >= F.col(date)).withColumn(day, F.explode(F.sequence(F.col(date), F.col("_until")))).drop("_until", date)


def capture_forward(analyses: DataFrame, versions: DataFrame, majority: DataFrame, sessions: DataFrame, features: list[str], existing: DataFrame) -> DataFrame:
    """Forward-return predictions on record: of every analysis with a model probability, under the version active then.

    analyses: KEY, data_cutoff, reference_close, score, ml_probability; versions: exchange, version, data_cutoff (of
    active models); majority: fold, train_end, naive_class; sessions: data_cutoff, target_date ten sessions on.
    Analyses of exchanges without a version, or without a close, are left out; a second run adds nothing.
    """
    last = analyses.select(F.max("data_cutoff")).scalar()
    active = daily_versions(versions.withColumnRenamed("data_cutoff", "trained_through"), ["exchange"], "trained_through", ["version"], last)
    naive = daily_versions(majority, [], "train_end", ["fold"], last).drop("fold")
    p = F.col("ml_probability")
    rows = analyses.filter(p.isNotNull() & F.col("reference_close").isNotNull()).join(active, ["exchange", "data_cutoff"])
    rows = rows.join(naive, "data_cutoff", "left").join(sessions, "data_cutoff", "left").withColumns(
        {
            "family": F.lit("forward_return"), "horizon": F.lit(10), "predicted_class": p > 0.5, "probability": p, "rule_baseline_class": F.col("score") > 0,
            "confidence": F.abs(p - 0.5) * 2.0, "schema_hash": schema_hash(F.array(*map(F.lit, features))), "settlement_status": F.lit("PENDING"),
        }
    )
    return append_new(existing, rows.withColumn("confidence_label", confidence_label(F.col("confidence"))), UNIQUE)


def persistence_returns(bars: DataFrame, as_of: Column) -> DataFrame:
    """Last one-session return as of a day, from the two newest bars."""
    from barwright.functions.rolling import history

    df = bars.filter(F.col("date") <= as_of).withColumn("_p", F.lag("close").over(history()))
    return df.groupBy(*KEY).agg((F.try_divide(F.max_by("close", "date"), F.max_by("_p", "date")) - 1.0).alias("persistence_return"))


def settle(predictions: DataFrame, bars: DataFrame, listed: DataFrame, through: Column, patience: int = 30) -> DataFrame:
    """PENDING rows become SETTLED or, after the patience, EXCLUDED with a reason."""
    actual = bars.select(*KEY, F.col("date").alias("target_date"), F.col("close").alias("_c"), F.col("volume").alias("_v"))
    known = listed.select(*KEY, F.lit(True).alias("_listed"))
    df = predictions.join(actual, [*KEY, "target_date"], "left").join(known, KEY, "left")
    due = (F.col("settlement_status") == "PENDING") & (F.col("target_date") <= through)
    late = F.date_diff(through, F.col("target_date")) >= patience
    priced = F.coalesce(F.col("_c"), F.lit(0.0)) != 0
    idle = priced & (F.col("_v") <= 0)
    reason = (
        F.when(F.col("_listed").isNull(), "stock_deleted")
        .when(~priced, F.when(late, "no_settlement_data_available"))
        .when(idle, F.when(late, "suspended_or_zero_volume"))
        .when(F.coalesce("reference_close", F.lit(0.0)) == 0, "invalid_reference_price")
    )
    ready = F.col("_listed").isNotNull() & priced & ~F.coalesce(idle, F.lit(False)) & (F.coalesce("reference_close", F.lit(0.0)) != 0)
    outcome = F.when(due & ready, F.col("_c") / F.col("reference_close") - 1.0)
    return df.withColumns(
        {
            "exclusion_reason": F.when(due, reason),
            "outcome_price": F.when(due & ready, F.col("_c")),
            "outcome_return": outcome,
            "outcome_class": outcome > 0,
            "settlement_status": F.when(due & ready, "SETTLED").when(due & reason.isNotNull(), "EXCLUDED").otherwise(F.col("settlement_status")),
        }
    ).drop("_c", "_v", "_listed")


def classifier_metrics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Metrics with F1, AUC, log loss and calibration error, and skill against both baselines.

    rows: outcome_class, predicted_class, probability, rule_class, naive_class.
    """
    y, said = F.coalesce("outcome_class", F.lit(False)), F.coalesce("predicted_class", F.lit(False))
    raw = F.coalesce("probability", F.lit(0.5))
    q = clip(raw, 1e-6, 1 - 1e-6)
    baseline = {name: F.col(f"{name}_class") for name in ("rule", "naive")}
    # model, loss and both baselines come out of one pass over the rows
    m = rows.groupBy(*groups).agg(
        *classification_columns(y, said, raw),
        F.bround(-F.avg(F.when(y, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))), 4).alias("log_loss"),
        *[balanced_accuracy(y, F.coalesce(c, F.lit(False)), c.isNotNull()).alias(f"_{name}") for name, c in baseline.items()],
    )
    auc = area_under_curve(rows.withColumn("_q", raw), groups, "outcome_class", "_q")
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when((p > 0) & (r > 0), F.bround(p * r * 2.0 / (p + r), 4)).otherwise(0.0)
    out = m.withColumn("f1", f1).join(auc.withColumn("roc_auc", F.bround("roc_auc", 4)), groups)
    out = out.join(calibration(rows, groups).groupBy(*groups).agg(F.bround(F.sum("gap"), 4).alias("calibration_error")), groups, "left")
    return out.withColumns({f"skill_vs_{n}": F.bround(F.col("balanced_accuracy") - F.col(f"_{n}"), 4) for n in baseline}).drop("_rule", "_naive")


def calibration(rows: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """Predicted against observed rate in equal-width bins; `gap` sums to the calibration error."""
    q = F.coalesce("probability", F.lit(0.5))
    b = rows.groupBy(*groups, F.least(F.floor(q * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(q).alias("avg_predicted"), F.avg(F.when(F.col("outcome_class"), 1.0).otherwise(0.0)).alias("actual_frequency")
    )
    total = b.groupBy(*groups).agg(F.sum("n").alias("_t"))
    gap = F.col("n") / F.col("_t") * F.abs(F.col("avg_predicted") - F.col("actual_frequency"))
    return b.join(total, groups).withColumn("gap", gap).drop("_t")


def regressor_metrics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Metrics with RMSE, median error, bias, symmetric error, correlation and skills.

    rows: outcome_return, predicted_return, rule_return, naive_return.
    """
    y, p = F.col("outcome_return"), F.col("predicted_return")
    err, mid = F.abs(p - y), (F.abs(p) + F.abs(y)) / 2.0
    m = regression_metrics(rows, groups, "outcome_return", "predicted_return")
    extra = rows.groupBy(*groups).agg(
        F.bround(F.sqrt(F.avg(err * err)), 6).alias("rmse"), F.bround(F.avg(p - y), 6).alias("bias"),
        F.bround(F.avg(F.when(mid > 1e-6, err / mid)) * 100.0, 4).alias("smape"),
        F.when((F.stddev_pop(y) > 1e-12) & (F.stddev_pop(p) > 1e-12), F.bround(F.corr(y, p), 4)).alias("correlation"),
    )
    median = exact_quantiles(rows.withColumn("_e", err), groups, "_e", [0.5]).select(*groups, F.bround(F.get("q", F.lit(0)), 6).alias("median_absolute_error"))
    out = m.join(extra, groups).join(median, groups)
    for name in ("rule", "naive"):
        b = regression_metrics(rows.filter(F.col(f"{name}_return").isNotNull()), groups, "outcome_return", f"{name}_return").select(*groups, F.col("mae").alias("_m"))
        out = out.join(b, groups, "left").withColumn(f"skill_vs_{name}", F.when(F.col("_m") > 1e-12, F.bround(F.lit(1.0) - F.col("mae") / F.col("_m"), 4))).drop("_m")
    return out


def economic(rows: DataFrame, groups: list[str], multipliers: tuple[float, ...] = (1.0, 1.5, 2.0), cost: float = 0.011) -> DataFrame:
    """Long-or-flat compounding after each multiple of the costs, with the drawdown, against always long.

    Growth is summed as logarithms inside each day in (symbol) order and
    carried over days, so a group is never walked in one task; the running
    maximum works the same way.
    """
    rows = rows.withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers))))  # one pass over the input for all
    groups, multiplier = [*groups, "multiplier"], F.col("multiplier")
    long = F.col("predicted_return") > 0
    net = F.when(long, F.col("outcome_return") - multiplier * cost).otherwise(0.0)
    growth = lambda r: F.when(r.isNotNull(), F.when(r > -1, F.log1p(r)).otherwise(RUIN))  # noqa: E731  nothing is left after a loss of everything
    df = rows.select(*groups, *[k for k in KEY if k not in groups], "target_date", growth(net).alias("g"), growth(F.col("outcome_return")).alias("b"), long.alias("long"))
    ties = [F.asc(k) for k in KEY]
    inside = Window.partitionBy(*groups, "target_date").orderBy(*ties).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_in", F.sum("g").over(inside))
    df = df.withColumn("_peak_in", F.max("_in").over(inside))
    days = df.groupBy(*groups, "target_date").agg(F.sum("g").alias("dg"), F.max("_in").alias("dpeak"))
    w = Window.partitionBy(*groups).orderBy("target_date")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_start", F.coalesce(F.sum("dg").over(prior), F.lit(0.0)))
    days = days.withColumn("_peak", F.max(F.col("_start") + F.col("dpeak")).over(prior))
    j = df.join(days.select(*groups, "target_date", "_start", "_peak"), [*groups, "target_date"])
    level = F.col("_start") + F.col("_in")
    peak = F.greatest(F.col("_peak"), F.col("_start") + F.col("_peak_in"))
    return j.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("long").alias("trades"), F.bround((F.exp(F.sum("g")) - 1.0) * 100.0, 4).alias("net_total_return_pct"),
        F.bround(F.min(F.exp(level - peak) - 1.0) * 100.0, 4).alias("max_drawdown_pct"),
        F.bround((F.exp(F.sum("b")) - 1.0) * 100.0, 4).alias("benchmark_return_pct"), F.bround(F.count_if("long") * cost * F.first("multiplier") * 100.0, 4).alias("cost_pct"),
    )


PRIME = 2**31 - 1  # draws are whole numbers below it
#: a draw of at least the k-th value counts the row k + 1 times: the Poisson distribution of mean 1
POISSON_STEPS = [int(x * PRIME) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])]


def round_factors(rounds: int) -> np.ndarray:
    """Three numbers of seven hex digits for each round, from its checksum."""
    digests = [hashlib.md5(f"round {b}".encode()).hexdigest() for b in range(rounds)]
    return np.array([[int(d[k : k + 7], 16) for k in (0, 7, 14)] for d in digests], np.int64).reshape(-1, 3).T


def bootstrap_interval(rows: DataFrame, groups: list[str], value: str, key: list[str], rounds: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling.

    Each row draws a count for each round from the checksum of its own key and that of the round, in whole numbers, so
    the result does not depend on partitioning and any engine can repeat it. A task adds its rows up to two numbers
    for each group and round; only those are shuffled.
    """
    one, two, three = round_factors(rounds)
    names = [f"_g{i}" for i in range(len(groups))]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                draw = (part["_h1"].to_numpy(np.int64)[:, None] * one + part["_h2"].to_numpy(np.int64)[:, None] * two + three) % PRIME
                weight = np.searchsorted(POISSON_STEPS, draw, side="right")
                for group, rows_ in part.reset_index(drop=True).groupby(names, dropna=False).indices.items():
                    group = group if isinstance(group, tuple) else (group,)
                    w = weight[rows_]
                    sums = np.stack([(part["_v"].to_numpy(float)[rows_, None] * w).sum(0), w.sum(0)])
                    total[group] = total[group] + sums if group in total else sums
        for group, (v, w) in total.items():
            labels = {n: np.full(rounds, g if isinstance(g, str) else None, object) for n, g in zip(names, group)}
            yield pd.DataFrame({**labels, "b": np.arange(rounds), "v": v, "w": w})

    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    picked = rows.filter(F.col(value).isNotNull()).select(*[F.col(g).cast("string").alias(n) for g, n in zip(groups, names)], F.col(value).cast("double").alias("_v"), *[F.conv(F.substring(digest, at, 7), 16, 10).cast("long").alias(n) for at, n in ((1, "_h1"), (8, "_h2"))])
    sums = picked.mapInPandas(reduce, ", ".join(f"{n} string" for n in names) + ", b int, v double, w double")
    means = sums.groupBy(*names, "b").agg(F.try_divide(F.sum("v"), F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = means.groupBy(*names).agg(q[0].alias("low"), q[1].alias("high"), F.count(F.lit(1)).alias("rounds"))
    types = dict(rows.select(*groups).dtypes)
    return out.select(*[F.col(n).cast(types[g]).alias(g) for n, g in zip(names, groups)], "low", "high", "rounds")


def status_from(n: Column, skill: Column, calibration_error: Column, flags: Column) -> tuple[Column, Column]:
    """(status, reasons array) of one assessment."""
    bad_cal = F.coalesce(calibration_error > fixed.HIGH_CALIBRATION_ERROR, F.lit(False))
    drifting = F.size(flags) > 0
    status = (
        F.when(n < 30, "insufficient_data")
        .when(skill.isNull(), "watch")
        .when(skill <= 0, F.when(n >= 60, "critical").otherwise("degraded"))
        .when((n < 60) | bad_cal | drifting, "watch")
        .otherwise("healthy")
    )
    reasons = F.array_compact(
        F.array(
            F.when(n < 30, F.format_string("too few settled predictions: %d of 30", n)),
            F.when((n >= 30) & skill.isNull(), F.format_string("skill could not be computed from %d predictions", n)),
            F.when((n >= 30) & (skill <= 0), F.format_string("skill %.4f is not positive over %d predictions", skill, n)),
            F.when((n >= 30) & (skill > 0) & (n < 60), F.format_string("skill %.4f is provisional with %d of 60 predictions", skill, n)),
            F.when((n >= 30) & skill.isNotNull() & bad_cal, F.format_string("calibration error %.4f is high", calibration_error)),
            F.when((n >= 30) & skill.isNotNull() & drifting, F.concat(F.lit("drift: "), F.array_join(flags, ", "))),
            F.when((n >= 60) & (skill > 0) & ~bad_cal & ~drifting, F.format_string("skill %.4f over %d predictions, no concerns", skill, n)),
        )
    )
    return status, reasons


def stability_index(rows: DataFrame, groups: list[str], value: str, is_current: str, buckets: int = 10) -> DataFrame:
    """PSI of current values over quantile buckets of the reference values."""
    probs = [i / buckets for i in range(buckets + 1)]
    edges = exact_quantiles(rows.filter(~F.col(is_current)), groups, value, probs).select(*groups, F.array_distinct("q").alias("edges"))
    v, e = F.col(value), F.col("edges")
    below = F.size(F.filter(e, lambda x: x <= v))
    bucket = F.when((v >= e[0]) & (v <= F.element_at(e, -1)), F.least(below, F.size(e) - 1))
    j = rows.join(edges, groups).withColumn("bucket", bucket)
    total = j.groupBy(*groups, "edges").agg(F.count_if(~F.col(is_current)).alias("nr"), F.count_if(is_current).alias("nc"))
    # every bucket counts, also an empty one
    grid = total.select(*groups, "nr", "nc", F.size("edges").alias("ne"), F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bucket"))
    counts = j.filter(F.col("bucket").isNotNull()).groupBy(*groups, "bucket").agg(F.count_if(~F.col(is_current)).alias("cr"), F.count_if(is_current).alias("cc"))
    share = lambda c, n: F.greatest(F.coalesce(c, F.lit(0)) / F.col(n), F.lit(1e-4))
    r, c = share("cr", "nr"), share("cc", "nc")
    ok = (F.max("nr") >= 5) & (F.max("nc") >= 5) & (F.max("ne") >= 3)
    return grid.join(counts, [*groups, "bucket"], "left").groupBy(*groups).agg(F.when(ok, F.bround(F.sum((c - r) * F.ln(c / r)), 4)).alias("psi"))


def halves(rows: DataFrame, groups: list[str]) -> DataFrame:
    """is_current marks the newer half of each group, by cut-off day."""
    r = ranked_by_day(rows, groups, "data_cutoff", [F.asc("exchange"), F.asc("symbol")])
    return r.withColumn("is_current", F.col("rank") > F.floor(F.col("group_size") / 2)).drop("rank")


def drift(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Split-half drift of predictions, outcomes, calibration and hit rate with flags."""
    # five statistics read the split rows: store them once
    used = ["data_cutoff", "predicted_return", "outcome_return", "outcome_class", "probability"]
    h = cut_lineage(halves(rows.select(*dict.fromkeys([*groups, *KEY, *used])), groups))
    psi = stability_index(h, groups, "predicted_return", "is_current")
    ks = ks_distance(h.withColumn("is_reference", ~F.col("is_current")), groups, "predicted_return", "is_reference")
    hit = F.when((F.col("predicted_return") >= 0) == (F.col("outcome_return") >= 0), 1.0).otherwise(0.0)
    up = F.when(F.col("outcome_class"), 1.0).otherwise(0.0)
    side = lambda x, cur: F.avg(F.when(F.col("is_current") if cur else ~F.col("is_current"), x))
    g = h.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.bround(side(hit, False), 4).alias("reference_hit_rate"), F.bround(side(hit, True), 4).alias("current_hit_rate"),
        F.bround(side(up, False), 4).alias("reference_up_rate"), F.bround(side(up, True), 4).alias("current_up_rate"),
    )
    cal = calibration(h, [*groups, "is_current"]).groupBy(*groups).agg(
        F.bround(F.sum(F.when(~F.col("is_current"), F.col("gap"))), 4).alias("reference_ece"), F.bround(F.sum(F.when(F.col("is_current"), F.col("gap"))), 4).alias("current_ece")
    )
    j = g.join(psi, groups, "left").join(ks.withColumns({"ks": F.bround("ks", 4), "ks_p": F.bround("ks_p", 4)}), groups, "left").join(cal, groups, "left")
    flags = F.array_compact(
        F.array(
            F.when(F.col("psi") > fixed.PSI_MAJOR, F.lit("prediction drift major")).when(F.col("psi") > fixed.PSI_MODERATE, F.lit("prediction drift moderate")),
            F.when(F.col("ks_p") < 0.05, F.lit("prediction distribution differs")),
            F.when(F.abs(F.col("current_up_rate") - F.col("reference_up_rate")) > 0.15, F.lit("class balance shifted")),
            F.when(F.col("current_ece") - F.col("reference_ece") > 0.1, F.lit("calibration worsened")),
            F.when(F.col("reference_hit_rate") - F.col("current_hit_rate") > 0.15, F.lit("hit rate degraded")),
        )
    )
    return j.withColumn("flags", F.when(F.col("n") >= 30, flags).otherwise(F.array().cast("array<string>")))


def schema_change(trained: Column, current: Column) -> dict[str, Column]:
    missing, added = F.array_sort(F.array_except(trained, current)), F.array_sort(F.array_except(current, trained))
    return {"missing": missing, "added": added, "changed": (F.size(missing) > 0) | (F.size(added) > 0)}


def recommendations(status: Column, calibration_error: Column, ref_hit: Column, cur_hit: Column, psi: Column, ref_ece: Column, cur_ece: Column) -> Column:
    """Actions from concrete findings, most specific first."""
    weak = status.isin("degraded", "critical")
    found = F.array_compact(
        F.array(
            F.when(calibration_error > fixed.HIGH_CALIBRATION_ERROR, F.lit("recalibrate_probabilities")),
            F.when(ref_hit - cur_hit > 0.15, F.lit("retrain_using_newer_data")),
            F.when(psi > fixed.PSI_MAJOR, F.lit("inspect_specific_feature")),
            F.when(cur_ece - ref_ece > 0.1, F.lit("reduce_confidence_or_abstain")),
            F.when(weak, F.lit("downgrade_to_experimental")),
            F.when(weak, F.lit("compare_against_simpler_baseline")),
        )
    )
    return F.when(status == "insufficient_data", F.array(F.lit("collect_more_outcomes"))).otherwise(
        F.when((status == "healthy") & (F.size(found) == 0), F.array(F.lit("continue_serving"))).otherwise(found)
    )


def windows(settled: DataFrame, groups: list[str], sizes: list[int] = fixed.WINDOW_SIZES) -> DataFrame:
    """Newest n settled rows per group for every window size, in one table.

    Only the largest window passes the exchange: the rank limit is applied
    inside each task first.
    """
    order = [F.desc("data_cutoff"), F.asc("exchange"), F.asc("symbol")]
    w = Window.partitionBy(*groups).orderBy(*order)
    newest = settled.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(sizes))
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda s: F.col("place") <= s)
    return newest.withColumn("window_size", F.explode(fits)).drop("place")


def assess(settled: DataFrame, groups: list[str]) -> DataFrame:
    """Assessment per group and window: metrics, drift, status and recommendations."""
    rows = windows(settled, groups)
    by = [*groups, "window_size"]
    m, d = classifier_metrics(rows, by), drift(rows, by)
    j = m.join(d.drop("n"), by)
    period = rows.groupBy(*by).agg(F.min("data_cutoff").alias("period_start"), F.max("data_cutoff").alias("period_end"))
    status, reasons = status_from(F.col("n"), F.col("skill_vs_naive"), F.col("calibration_error"), F.col("flags"))
    df = j.join(period, by).withColumns({"status": status, "reasons": F.array_join(reasons, "; ")})
    rec = recommendations(F.col("status"), *[F.col(c) for c in ("calibration_error", "reference_hit_rate", "current_hit_rate", "psi", "reference_ece", "current_ece")])
    return df.withColumn("recommendations", F.array_join(rec, ","))


def assess_scopes(settled: DataFrame, schemas: DataFrame) -> DataFrame:
    """Assessment of both families at once, by family, exchange, horizon, schema and window.

    settled: family, horizon and the settled rows of any number of families; schemas: exchange, since, schema_hash. Each
    prediction belongs to the schema that was valid on the day it was made; days before the first have none.
    """
    last = settled.select(F.max("data_cutoff")).scalar()
    daily = daily_versions(schemas, ["exchange"], "since", ["schema_hash"], last)
    rows = settled.join(daily, ["exchange", "data_cutoff"], "left").withColumn("schema_hash", F.coalesce("schema_hash", F.lit("unknown")))
    return assess(rows, ["family", "exchange", "horizon", "schema_hash"])


def exchange_divergence(assessed: DataFrame) -> DataFrame:
    """Windows whose two exchanges differ by more than 0.15 in skill."""
    pick = lambda e: F.max(F.when(F.col("exchange") == e, F.col("skill_vs_naive")))
    g = assessed.groupBy("window_size").agg(pick("DSE").alias("dse_skill"), pick("CSE").alias("cse_skill"))
    return g.withColumn("separate_models", F.coalesce(F.abs(F.col("dse_skill") - F.col("cse_skill")) > 0.15, F.lit(False)))


def confidence_bucket(c: Column) -> Column:
    v = F.coalesce(c, F.lit(0.0))
    return (
        # fixed values: texts a user sees
        F.when(v < 0.55, "Below 55%").when(v < 0.60, "55–59%").when(v < 0.65, "60–64%").when(v < 0.70, "65–69%").when(v < 0.80, "70–79%").otherwise("80%+")
    )


def diagnostics(settled: DataFrame) -> DataFrame:
    """Next-close results by confidence bucket, security and sector in one pass."""
    df = settled.select(
        confidence_bucket(F.col("confidence")).alias("bucket"), F.concat_ws(":", "exchange", "symbol").alias("stock"),
        F.when(F.coalesce("sector", F.lit("")) == "", "Unknown").otherwise(F.col("sector")).alias("sector"),
        (F.abs(F.col("predicted_price") - F.col("outcome_price")) / F.col("outcome_price") * 100.0).alias("ape"),
        F.when((F.col("predicted_return") >= 0) == (F.col("outcome_return") >= 0), 100.0).otherwise(0.0).alias("hit"),
        F.when(F.col("outcome_return") > 0, 100.0).otherwise(0.0).alias("win"),
    )
    cols = ["bucket", "stock", "sector"]
    g = df.groupingSets([[F.col(c)] for c in cols], *map(F.col, cols)).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.bround(F.avg("ape"), 3).alias("mape"), F.bround(F.avg("hit"), 1).alias("direction_hit_rate"),
        F.bround(F.avg("win"), 1).alias("win_rate"),
    )
    kind = F.when(F.col("gid") == 3, "confidence").when(F.col("gid") == 5, "stock").otherwise("sector")
    color = F.when((F.col("n") >= 20) & (F.col("direction_hit_rate") >= 53) & (F.col("mape") < 2), "GREEN").when((F.col("n") >= 20) & (F.col("direction_hit_rate") < 50), "RED").otherwise("YELLOW")
    return g.select(kind.alias("kind"), F.coalesce(*cols).alias("label"), "n", "mape", "direction_hit_rate", "win_rate", color.alias("status"))


def signal_status(analysis: DataFrame, quoted: DataFrame, levels: DataFrame, models: DataFrame, today: Column) -> DataFrame:
    """Edge verdict, freshness, liquidity and invalidation text per security.

    levels: KEY, support, resistance; models: exchange, deployed, skill, train_rows, live_n, live_skill.
    """
    df = analysis.join(quoted.select(*KEY, "last_volume"), KEY, "left").join(levels, KEY, "left").join(models, "exchange", "left")
    ml_ok = F.coalesce(F.col("deployed") & (F.col("skill") > 0) & (F.col("train_rows") >= 200), F.lit(False))
    live_ok = F.coalesce((F.col("live_n") >= 30) & (F.col("live_skill") > 0), F.lit(False))
    age = F.date_diff(today, F.col("as_of"))
    v = F.col("last_volume")
    level = F.when(F.col("action") == "BUY", F.col("support")).when(F.col("action") == "SELL", F.col("resistance"))
    text = (
        F.when((F.col("action") == "BUY") & (F.coalesce("support", F.lit(0.0)) != 0), F.format_string("closes back below support (~%.2f)", level))
        .when((F.col("action") == "SELL") & (F.coalesce("resistance", F.lit(0.0)) != 0), F.format_string("reclaims resistance (~%.2f)", level))
        .when(F.col("action").isin("BUY", "SELL"), "conditions reverse")
        .otherwise("neutral")
    )
    return df.select(
        *KEY, "action", (ml_ok | live_ok).alias("has_edge"), age.alias("age_days"), (age > fixed.STALE_DATA_DAYS).alias("is_stale"),
        F.when(F.coalesce(v, F.lit(0)) == 0, "unknown").when(v < 10000, "thin").when(v < 100000, "moderate").otherwise("active").alias("liquidity"), text.alias("invalidation"),
    )


def daily_report(assessed: DataFrame, stale_model: Column, data_flags: Column) -> DataFrame:
    """Evidence band, verdict and the three most urgent recommendations per assessment."""
    n, status = F.col("n"), F.col("status")
    evidence = evidence_label(n)
    solid = evidence.isin("Moderate", "Stronger evidence")
    verdict = (
        F.when(n == 0, "Experimental").when(status == "insufficient_data", "Promising").when(status == "healthy", F.when(solid, "Stable").otherwise("Promising"))
        .when(status == "watch", "Weak").otherwise("Declining")
    )
    found = F.array_compact(
        F.array(
            F.when(status.isin("degraded", "critical"), F.lit("pause_promotion")), F.when(data_flags, F.lit("fix_market_data")),
            F.when(F.col("calibration_error") > fixed.HIGH_CALIBRATION_ERROR, F.lit("adjust_confidence")), F.when(n < 60, F.lit("collect_more")), F.when(stale_model, F.lit("retraining_review")),
        )
    )
    recs = F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit("no_concerns")))
    return assessed.withColumns({"evidence": evidence, "verdict": verdict, "advice": F.array_join(recs, ",")})


def report_trend(reports: DataFrame) -> DataFrame:
    """Change against the previous report of the same series (one report a day).

    reports: exchange, report_date, version, live_n, live_precision, trained_today.
    """
    w = Window.partitionBy("exchange").orderBy("report_date")
    p = {c: F.lag(c).over(w) for c in ("version", "live_n", "live_precision")}
    diff = (F.col("live_precision") - p["live_precision"]) * 100.0
    trend = (
        F.when(p["live_n"].isNull(), F.lit(None).cast("string")).when(p["version"] != F.col("version"), "version_changed")
        .when((p["live_n"] == F.col("live_n")) & ~F.col("trained_today"), "no_new_evidence")
        .when(p["live_precision"].isNull() | F.col("live_precision").isNull(), "insufficient_history")
        .when(F.abs(diff) < 3.0, "stable").when(diff > 0, "improving").otherwise("declining")
    )
    return reports.withColumn("trend", trend)
