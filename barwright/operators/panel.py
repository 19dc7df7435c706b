"""Learning panels, walk-forward folds, weights, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import clip, ratio
from barwright.functions.rolling import KEY
from barwright.operators.features import feature_frame


def _known(columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def forward_panel(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Features with the 10-session label; histories under 80 bars and rows with gaps are left out."""
    f = feature_frame(bars, stocks)
    rows = f.filter((F.col("n_rows") >= 80) & _known([*fixed.FORWARD_FEATURES, "label"]))
    active = stocks.filter("is_active").select(*KEY)
    return rows.join(active, KEY, "left_semi").select(*KEY, "date", *fixed.FORWARD_FEATURES, "label")


def next_close_panel(bars: DataFrame, stocks: DataFrame, members: DataFrame) -> DataFrame:
    """Features with the three-class label for a member universe, tradable now and next session."""
    f = feature_frame(bars, stocks, members)
    ok = _known([*fixed.NEXT_CLOSE_FEATURES, "fwd_ret_1", "direction_label", "next_volume"])
    rows = f.filter((F.col("n_rows") >= 80) & ok & (F.col("volume_acceleration") > 0) & (F.col("next_volume") > 0))
    return rows.select(*KEY, "date", *fixed.NEXT_CLOSE_FEATURES, "fwd_ret_1", "direction_label")


def universe_or_fallback(liquid: DataFrame, quoted: DataFrame, least: int = 15, n: int = 80) -> DataFrame:
    """Active liquid members of each exchange, or its most traded securities where fewer than `least` are liquid."""
    active = quoted.filter("is_active").select(*KEY, "last_volume")
    marked = active.join(liquid.select(*KEY, F.lit(True).alias("_liquid")), KEY, "left")
    enough = marked.groupBy("exchange").agg((F.count("_liquid") >= least).alias("_enough"))
    place = F.row_number().over(Window.partitionBy("exchange").orderBy(F.desc_nulls_last("last_volume"), "symbol"))
    ranked = marked.withColumn("_place", place).join(enough, "exchange")
    return ranked.filter(F.when(F.col("_enough"), F.col("_liquid").isNotNull()).otherwise(F.col("_place") <= n)).select(*KEY)


def folds(panel: DataFrame, n_folds: int, embargo_days: int, least_train: float = 0.4) -> DataFrame:
    """Expanding walk-forward folds over the distinct dates (a calendar-bounded table)."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = panel.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    first = F.greatest(F.floor(F.col("n") * least_train), F.lit(1))
    k = F.explode(F.sequence(F.lit(0), F.lit(n_folds))).alias("k")
    step = (F.col("n") - 1 - first) / F.lit(float(n_folds))
    edges = days.filter((F.col("i") == 0) & (F.col("n") >= 20) & (first < F.col("n") - 1)).select("n", k).select(
        F.floor(first + F.col("k") * step).cast("int").alias("i")
    ).distinct()
    at = edges.join(days.select("i", "date"), "i")
    o = Window.partitionBy(F.lit(0)).orderBy("i")
    pairs = at.select("i", F.col("date").alias("test_start"), F.lead("date").over(o).alias("test_end"), F.row_number().over(o).alias("fold"))
    return pairs.filter(F.col("test_end").isNotNull()).select(
        "fold", F.date_sub("test_start", embargo_days).alias("train_end"), "test_start", "test_end"
    )


def split(panel: DataFrame, fold_table: DataFrame, rolling_days: int | None = None) -> DataFrame:
    """Panel rows labelled train or test per fold.

    Folds are a handful of rows; they are attached by a day table (day, fold,
    part) so that the join is an equality on the date.
    """
    days = panel.select("date").distinct()
    spans = F.array(
        F.struct(F.lit("train").alias("part"), (F.date_sub("train_end", rolling_days) if rolling_days else F.lit("0001-01-01").cast("date")).alias("a"), F.col("train_end").alias("b")),
        F.struct(F.lit("test").alias("part"), F.col("test_start").alias("a"), F.col("test_end").alias("b")),
    )
    first = days.select(F.min("date")).scalar()
    s = fold_table.select("fold", "train_end", F.explode(spans).alias("s")).select(
        "fold", "train_end", "s.part", F.explode(F.sequence(F.greatest("s.a", first), F.greatest("s.b", F.greatest("s.a", first)))).alias("date"), "s.b"
    ).filter(F.col("date") <= F.col("b"))
    return panel.join(s.select("fold", "train_end", "part", "date"), "date")


def rolling_window(panel: DataFrame, end: Column, days: int) -> DataFrame:
    return panel.filter((F.col("date") >= F.date_sub(end, days)) & (F.col("date") <= end))


def holdout(panel: DataFrame, days: int = 90) -> DataFrame:
    """Panel with is_holdout for the last calendar days."""
    last = panel.select(F.max("date")).scalar()
    return panel.withColumn("is_holdout", F.col("date") >= F.date_sub(last, days))


def clipped(panel: DataFrame, features: list[str], bound: float = 50.0) -> DataFrame:
    return panel.withColumns({c: clip(F.col(c), -bound, bound) for c in features})


def weights(train: DataFrame, label: str, reference: str, balanced: bool = True, half_life: int = 180) -> DataFrame:
    """Recency weight halved every 180 days, times the balanced class weight."""
    age = F.greatest(F.date_diff(F.col(reference), F.col("date")), F.lit(0))
    df = train.withColumn("weight", F.pow(F.lit(0.5), age / float(half_life)))
    if not balanced:
        return df
    group = [c for c in ("fold",) if c in train.columns]
    sizes = train.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.groupBy(*group).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    table = sizes.join(total, group) if group else sizes.withColumns({"_n": F.sum("_c").over(Window.partitionBy(F.lit(0))), "_k": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    # folds times classes: a shuffle by class would send half of all rows to one task
    return df.join(F.broadcast(table), [*group, label]).withColumn("weight", F.col("weight") * F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def baselines(parts: DataFrame) -> DataFrame:
    """Majority, zero, persistence and per-exchange predictions of every test row.

    parts: output of `split` over the forward panel.
    """
    train, test = parts.filter(F.col("part") == "train"), parts.filter(F.col("part") == "test")
    overall = train.groupBy("fold").agg(F.avg("label").alias("rate"))
    market = train.groupBy("fold", "exchange").agg(F.avg("label").alias("market_rate"))
    df = test.join(overall, "fold").join(market, ["fold", "exchange"], "left")
    r = F.coalesce("return_20d", F.lit(0.0))
    row = lambda name, cls, prob: F.struct(F.lit(name).alias("baseline"), cls.cast("int").alias("predicted"), prob.cast("double").alias("probability"))
    preds = F.array(
        row("majority_class", F.when(F.col("rate") > 0.5, 1).otherwise(0), F.col("rate")),
        row("zero_return", F.lit(0), F.lit(0.0)),
        row("persistence", F.when(r > 0, 1).otherwise(0), F.lit(0.5) + F.signum(r) * 0.25),
        row("simple_market", F.coalesce(F.bround("market_rate"), F.lit(0.0)), F.coalesce("market_rate", F.lit(0.5))),
    )
    return df.select("fold", *KEY, "date", "label", F.explode(preds).alias("b")).select("fold", *KEY, "date", "label", "b.*")


def balanced_accuracy(y: Column, p: Column, ok: Column | None = None) -> Column:
    """Mean of the hit rates of both classes over rows where ok holds."""
    ok = F.lit(True) if ok is None else ok
    pos, neg = F.count_if(ok & y), F.count_if(ok & ~y)
    return F.when((pos > 0) & (neg > 0), F.bround((ratio(F.count_if(ok & y & p), pos) + ratio(F.count_if(ok & ~y & ~p), neg)) / 2.0, 4))


def classification_columns(y: Column, p: Column, probability: Column | None) -> list[Column]:
    """Aggregates from boolean truth and prediction."""
    n = F.count(F.lit(1))
    tp, tn, pos, said = F.count_if(y & p), F.count_if(~y & ~p), F.count_if(y), F.count_if(p)
    cols = [
        n.alias("n"), F.bround((tp + tn) / n, 4).alias("accuracy"), balanced_accuracy(y, p).alias("balanced_accuracy"),
        F.bround(F.coalesce(ratio(tp, said), F.lit(0.0)), 4).alias("precision"), F.bround(F.coalesce(ratio(tp, pos), F.lit(0.0)), 4).alias("recall"),
        F.bround(pos / n, 4).alias("positive_rate_true"), F.bround(said / n, 4).alias("positive_rate_pred"),
    ]
    if probability is not None:
        d = probability - F.when(y, 1.0).otherwise(0.0)
        cols.append(F.bround(F.avg(d * d), 4).alias("brier"))
    return cols


def classification_metrics(rows: DataFrame, groups: list[str], truth: str = "label", predicted: str = "predicted", probability: str | None = "probability") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, Brier score and rates per group."""
    q = F.col(probability) if probability else None
    return rows.groupBy(*groups).agg(*classification_columns(F.col(truth) == 1, F.col(predicted) == 1, q))


def regression_metrics(rows: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth), F.col(predicted)
    err = F.abs(p - y)
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg(err), 6).alias("mae"),
        F.bround(F.avg(F.when(F.abs(y) > 1e-9, err / F.abs(y))) * 100.0, 4).alias("mape"),
        F.bround(F.avg(F.when((p >= 0) == (y >= 0), 1.0).otherwise(0.0)), 4).alias("direction_hit_rate"),
    )


def direction_metrics(rows: DataFrame, groups: list[str], truth: str = "direction_label", predicted: str = "predicted", top: str | None = "top_probability") -> DataFrame:
    """Three-class metrics from the confusion counts, and precision where the model is sure."""
    confusion = rows.groupBy(*groups, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0))
    per_class = confusion.select(*groups, F.explode(F.array(*[F.lit(k) for k in (0, 1, 2)])).alias("k"), "t", "p", "c").groupBy(*groups, "k").agg(
        F.sum(F.when((F.col("t") == F.col("k")) & (F.col("p") == F.col("k")), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("t") == F.col("k"), F.col("c")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("p") == F.col("k"), F.col("c")).otherwise(0)).alias("said"),
    )
    seen = (F.col("actual") > 0) | (F.col("said") > 0)
    macro = per_class.groupBy(*groups).agg(
        F.bround(F.avg(F.when(F.col("actual") > 0, F.col("tp") / F.col("actual"))), 4).alias("balanced_accuracy"),
        F.bround(F.avg(F.when(seen, 2.0 * F.col("tp") / (F.col("actual") + F.col("said")))), 4).alias("macro_f1"),
        F.bround(F.avg(F.when(seen, F.coalesce(ratio(F.col("tp"), F.col("said")), F.lit(0.0)))), 4).alias("macro_precision"),
    )
    out = confusion.groupBy(*groups).agg(F.sum("c").alias("n"), F.bround(hit / F.sum("c"), 4).alias("accuracy")).join(macro, groups)
    if top:
        sure = F.col(top) >= fixed.MIN_DIRECTION_CONFIDENCE
        right = F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)
        high = rows.groupBy(*groups).agg(
            F.bround(F.avg(F.when(sure, 1.0).otherwise(0.0)), 4).alias("coverage"), F.bround(F.avg(F.when(sure, right)), 4).alias("high_confidence_precision")
        )
        out = out.join(high, groups)
    return out


def skills(model: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Balanced-accuracy difference and Brier skill of a model against each baseline."""
    b = base.select(*keys, "baseline", F.col("balanced_accuracy").alias("_ba"), F.col("brier").alias("_br"))
    return model.join(b, keys).select(
        *keys, "baseline", F.bround(F.col("balanced_accuracy") - F.col("_ba"), 4).alias("balanced_skill"),
        F.when(F.col("_br") > 1e-12, F.bround(F.lit(1.0) - F.col("brier") / F.col("_br"), 4)).alias("brier_skill"),
    )


def regression_skill(model: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    b = base.select(*keys, F.col("mae").alias("_m"))
    return model.join(b, keys).select(*keys, "mae", F.when(F.col("_m") > 1e-12, F.bround(F.lit(1.0) - F.col("mae") / F.col("_m"), 4)).alias("skill"))


def pooling(evaluations: DataFrame, least: int, need_same_sign: bool) -> DataFrame:
    """Whether two exchanges may share one model, with the reason.

    evaluations: exchange, n, skill (one row per exchange).
    """
    pick = lambda c, e: F.max(F.when(F.col("exchange") == e, F.col(c)))
    e = evaluations.agg(
        pick("n", "DSE").alias("dn"), pick("n", "CSE").alias("cn"), pick("skill", "DSE").alias("ds"), pick("skill", "CSE").alias("cs")
    )
    d, c = F.col("ds"), F.col("cs")
    sign = ((d > 0) != (c > 0)) if need_same_sign else F.lit(False)
    reason = (
        F.when(F.col("dn").isNull() | F.col("cn").isNull(), "too little data")
        .when((F.col("dn") < least) | (F.col("cn") < least), "insufficient rows")
        .when(d.isNull() | c.isNull(), "skill undefined")
        .when(sign, "one passes and the other does not")
        .when(F.abs(d - c) > 0.15, "skill diverges")
        .otherwise("consistent")
    )
    return e.select((reason == "consistent").alias("justified"), reason.alias("reason"))


def retrain_needed(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """Exchanges whose newest labelled day is past the active model's cut-off."""
    cut = panel.groupBy("exchange").agg(F.max("date").alias("candidate_cutoff"))
    active = registry.filter("is_active").groupBy("exchange").agg(F.max("data_cutoff").alias("active_cutoff"))
    j = cut.join(active, "exchange", "left")
    return j.withColumn("retrain", F.coalesce(F.col("candidate_cutoff") > F.col("active_cutoff"), F.lit(True)))
