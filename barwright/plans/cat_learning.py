"""Learning queries (survey 2.11, ML rows)."""

from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.rolling import KEY
from barwright.operators import features as feat
from barwright.operators import candidates, models, screen
from barwright.operators import panel as pn
from barwright.plans.oracle import define
from barwright.plans.registry import query
from barwright.session import cut_lineage

_known = lambda cols: " AND ".join(f"{c} IS NOT NULL" for c in cols)
define(
    "panel", "feat stocks",
    f"SELECT * FROM feat SEMI JOIN (SELECT exchange, symbol FROM stocks WHERE is_active) USING (exchange, symbol) WHERE n_rows >= 80 AND {_known([*fixed.FORWARD_FEATURES, 'label'])}",
)
_PANEL = "exchange s, symbol s, date d, " + ", ".join(f"{c} f" for c in fixed.FORWARD_FEATURES) + ", label f"


@query("ml_01_forward_return_panel", _PANEL, "SELECT * FROM panel", "panel")
def _(m):
    return pn.forward_panel(m.bars, m.stocks)


# the fallback is an exchange's own: with few liquid securities it takes the most traded active ones
define(
    "members", "liquid quoted",
    """
SELECT exchange, symbol FROM (
  SELECT q.exchange, q.symbol, l.symbol IS NOT NULL AS liq, count(l.symbol) OVER (PARTITION BY q.exchange) >= 15 AS enough,
         row_number() OVER (PARTITION BY q.exchange ORDER BY q.last_volume DESC NULLS LAST, q.symbol) AS place
  FROM (SELECT * FROM quoted WHERE is_active) q LEFT JOIN liquid l ON l.exchange = q.exchange AND l.symbol = q.symbol)
WHERE CASE WHEN enough THEN liq ELSE place <= 80 END""",
)
define(
    "panel3", "feat members",
    f"SELECT * FROM feat SEMI JOIN members USING (exchange, symbol) WHERE n_rows >= 80 AND {_known([*fixed.NEXT_CLOSE_FEATURES, 'fwd_ret_1', 'direction_label', 'next_volume'])} AND volume_acceleration > 0 AND next_volume > 0",
)


def panel3(m):
    liquid = screen.liquid_universe(m.bars, F.lit("2001-06-30").cast("date"))
    members = pn.universe_or_fallback(liquid, m.quoted)
    return pn.next_close_panel(m.bars, m.stocks, members)


@query(
    "ml_02_next_close_panel", "exchange s, symbol s, date d, " + ", ".join(f"{c} f" for c in fixed.NEXT_CLOSE_FEATURES) + ", fwd_ret_1 f, direction_label i",
    "SELECT * FROM panel3", "panel3",
)
def _(m):
    return panel3(m)


# fold operators run on a light panel: return, label and exchange of every bar
_WIN = "OVER (PARTITION BY exchange, symbol ORDER BY date)"
define(
    "light", "bars",
    f"SELECT *, CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END AS label FROM (SELECT exchange, symbol, date, close / lag(close, 20) {_WIN} - 1 AS return_20d, lead(close, 10) {_WIN} / close - 1 AS f FROM bars) WHERE return_20d IS NOT NULL AND f IS NOT NULL",
)


def light(m):
    from barwright.functions.rolling import ahead, change, history

    w = history()
    c = F.col("close")
    df = m.bars.select(*KEY, "date", change(c, w, 20).alias("return_20d"), ahead(c, w, 10).alias("f")).dropna()
    return df.withColumn("label", F.when(F.col("f") > 0, 1.0).otherwise(0.0))


define(
    "folds", "light",
    """
SELECT row_number() OVER (ORDER BY i) AS fold, test_start - 14 AS train_end, test_start, test_end FROM (
SELECT i, d.date AS test_start, lead(d.date) OVER (ORDER BY i) AS test_end FROM (SELECT DISTINCT CAST(floor(greatest(floor(n * 0.4), 1) + k * ((n - 1 - greatest(floor(n * 0.4), 1)) / 5)) AS BIGINT) AS i
  FROM (SELECT count(DISTINCT date) AS n FROM light), range(0, 6) r(k)) JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS j FROM (SELECT DISTINCT date FROM light)) d ON d.j = i) WHERE test_end IS NOT NULL""",
)


def _folds(m, panel):
    """A handful of rows that several branches read: stored once."""
    return cut_lineage(pn.folds(panel, 5, 14))


@query("ml_03_walk_forward_folds", "fold i, train_end d, test_start d, test_end d", "SELECT * FROM folds", "folds")
def _(m):
    return _folds(m, light(m))


@query(
    "ml_03_fold_sizes", "fold i, part s, rows i",
    "SELECT fold, 'train' AS part, count(*) AS rows FROM light JOIN folds ON date <= train_end GROUP BY fold UNION ALL SELECT fold, 'test', count(*) FROM light JOIN folds ON date BETWEEN test_start AND test_end GROUP BY fold",
    "light folds",
)
def _(m):
    p = light(m)
    return pn.split(p, _folds(m, p)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "ml_04_rolling_window", "exchange s, rows i, first_day d",
    "SELECT exchange, count(*) AS rows, min(date) AS first_day FROM light WHERE date BETWEEN DATE '2000-12-31' - 730 AND DATE '2000-12-31' GROUP BY exchange", "light",
)
def _(m):
    p = pn.rolling_window(light(m), F.lit("2000-12-31").cast("date"), 730)
    return p.groupBy("exchange").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"))


@query(
    "ml_05_final_holdout", "is_holdout b, rows i, first_day d, last_day d",
    "SELECT date >= (SELECT max(date) FROM light) - 90 AS is_holdout, count(*) AS rows, min(date) AS first_day, max(date) AS last_day FROM light GROUP BY 1", "light",
)
def _(m):
    p = pn.holdout(light(m))
    return p.groupBy("is_holdout").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query(
    "ml_06_fold_medians", "fold i, rsi_14 f, volume_ratio f",
    """
SELECT fold, quantile_cont(greatest(-50, least(50, rsi_14)), 0.5) FILTER (rsi_14 IS NOT NULL) AS rsi_14, quantile_cont(greatest(-50, least(50, volume_ratio)), 0.5) FILTER (volume_ratio IS NOT NULL) AS volume_ratio
FROM tech JOIN folds ON date <= train_end GROUP BY fold""",
    "tech folds",
)
def _(m):
    from barwright.functions.quantiles import exact_quantiles

    p = light(m)
    rows = pn.split(feat.technical(m.bars).select(*KEY, "date", "rsi_14", "volume_ratio"), _folds(m, p)).filter(F.col("part") == "train")
    rows = cut_lineage(pn.clipped(rows, ["rsi_14", "volume_ratio"]))
    one = lambda c: exact_quantiles(rows, ["fold"], c, [0.5]).select("fold", F.get("q", F.lit(0)).alias(c))
    return one("rsi_14").join(one("volume_ratio"), "fold")


@query(
    "ml_07_sample_weights", "fold i, label f, rows i, total_weight f",
    """
SELECT fold, label, count(*) AS rows, sum(pow(0.5, greatest(train_end - date, 0) / 180.0) * n / (2 * c)) AS total_weight
FROM (SELECT *, count(*) OVER (PARTITION BY fold) AS n, count(*) OVER (PARTITION BY fold, label) AS c FROM light JOIN folds ON date <= train_end) GROUP BY fold, label""",
    "light folds",
)
def _(m):
    p = light(m)
    rows = pn.split(p, _folds(m, p)).filter(F.col("part") == "train")
    w = pn.weights(rows, "label", "train_end")
    return w.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total_weight"))


define(
    "base", "light folds",
    """
SELECT t.fold, t.label, b.baseline, b.predicted, b.probability FROM (
SELECT l.*, f.fold, o.rate, x.market_rate FROM light l JOIN folds f ON l.date BETWEEN f.test_start AND f.test_end
JOIN (SELECT fold, avg(label) AS rate FROM light JOIN folds ON date <= train_end GROUP BY fold) o ON o.fold = f.fold
LEFT JOIN (SELECT fold, exchange, avg(label) AS market_rate FROM light JOIN folds ON date <= train_end GROUP BY fold, exchange) x ON x.fold = f.fold AND x.exchange = l.exchange) t,
LATERAL (SELECT unnest([{'baseline': 'majority_class', 'predicted': CASE WHEN rate > 0.5 THEN 1 ELSE 0 END, 'probability': rate},
  {'baseline': 'zero_return', 'predicted': 0, 'probability': 0.0}, {'baseline': 'persistence', 'predicted': CASE WHEN return_20d > 0 THEN 1 ELSE 0 END, 'probability': 0.5 + sign(return_20d) * 0.25},
  {'baseline': 'simple_market', 'predicted': CAST(round_even(market_rate, 0) AS INTEGER), 'probability': market_rate}], recursive := true)) b""",
)


def _base(m):
    p = light(m)
    return pn.baselines(pn.split(p, _folds(m, p)))


@query(
    "ml_10_baselines", "fold i, baseline s, rows i, predicted_up i, mean_probability f",
    "SELECT fold, baseline, count(*) AS rows, sum(predicted) AS predicted_up, avg(probability) AS mean_probability FROM base GROUP BY ALL", "base",
)
def _(m):
    return _base(m).groupBy("fold", "baseline").agg(F.count(F.lit(1)).alias("rows"), F.sum("predicted").alias("predicted_up"), F.avg("probability").alias("mean_probability"))


_CLS = """count(*) AS n, round_even(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
  CASE WHEN count(DISTINCT label) = 2 THEN round_even((avg(CASE WHEN predicted = 1 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) + avg(CASE WHEN predicted = 0 THEN 1.0 ELSE 0.0 END) FILTER (label = 0)) / 2, 4) END AS balanced_accuracy,
  round_even(coalesce(avg(label) FILTER (predicted = 1), 0), 4) AS precision, round_even(coalesce(avg(CASE WHEN predicted = 1 THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 0), 4) AS recall,
  round_even(avg(label), 4) AS positive_rate_true, round_even(avg(predicted), 4) AS positive_rate_pred, round_even(avg((probability - label) * (probability - label)), 4) AS brier"""
CLS = "n i, accuracy f, balanced_accuracy f, precision f, recall f, positive_rate_true f, positive_rate_pred f, brier f"


@query("ml_11_classification_metrics", f"fold i, baseline s, {CLS}", f"SELECT fold, baseline, {_CLS} FROM base GROUP BY fold, baseline", "base")
def _(m):
    return pn.classification_metrics(_base(m), ["fold", "baseline"])


define(
    "preds", "bars",
    f"SELECT exchange, symbol, date, p, a FROM (SELECT *, close / lag(close) {_WIN} - 1 AS p, lead(close) {_WIN} / close - 1 AS a FROM bars) WHERE p IS NOT NULL AND a IS NOT NULL",
)


def preds(m):
    from barwright.functions.rolling import ahead, change, history

    w = history()
    return m.bars.select(*KEY, "date", change(F.col("close"), w).alias("p"), ahead(F.col("close"), w).alias("a")).dropna()


_REG = "count(*) AS n, round_even(avg(abs({0} - a)), 6) AS mae, round_even(avg(CASE WHEN abs(a) > 1e-9 THEN abs({0} - a) / abs(a) END) * 100, 4) AS mape, round_even(avg(CASE WHEN ({0} >= 0) = (a >= 0) THEN 1.0 ELSE 0.0 END), 4) AS direction_hit_rate"


@query("ml_12_regression_metrics", "exchange s, n i, mae f, mape f, direction_hit_rate f", f"SELECT exchange, {_REG.format('p')} FROM preds GROUP BY exchange", "preds")
def _(m):
    return pn.regression_metrics(preds(m), ["exchange"], "a", "p")


define(
    "dirs", "preds",
    "SELECT *, CASE WHEN a < -0.005 THEN 0 WHEN a > 0.005 THEN 2 ELSE 1 END AS t, CASE WHEN p < -0.01 THEN 2 WHEN p > 0.01 THEN 0 ELSE 1 END AS g, 0.4 + least(0.5, abs(p) * 8) AS top FROM preds",
)


@query(
    "ml_13_direction_metrics", "exchange s, n i, accuracy f, balanced_accuracy f, macro_f1 f, macro_precision f, coverage f, high_confidence_precision f",
    """
SELECT * FROM (SELECT exchange, count(*) AS n, round_even(avg(CASE WHEN t = g THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round_even(avg(CASE WHEN top >= 0.65 THEN 1.0 ELSE 0.0 END), 4) AS coverage,
  round_even(avg(CASE WHEN t = g THEN 1.0 ELSE 0.0 END) FILTER (top >= 0.65), 4) AS high_confidence_precision FROM dirs GROUP BY exchange)
JOIN (SELECT exchange, round_even(avg(tp / actual), 4) AS balanced_accuracy, round_even(avg(2.0 * tp / (actual + said)), 4) AS macro_f1, round_even(avg(coalesce(tp / said, 0)), 4) AS macro_precision
  FROM (SELECT exchange, k, count(*) FILTER (t = k AND g = k)::DOUBLE AS tp, count(*) FILTER (t = k) AS actual, nullif(count(*) FILTER (g = k), 0) AS said FROM dirs, range(0, 3) r(k) GROUP BY exchange, k) GROUP BY exchange) USING (exchange)""",
    "dirs",
)
def _(m):
    p, a = F.col("p"), F.col("a")
    rows = preds(m).withColumns(
        {
            "direction_label": F.when(a < -0.005, 0).when(a > 0.005, 2).otherwise(1),
            "predicted": F.when(p < -0.01, 2).when(p > 0.01, 0).otherwise(1),
            "top_probability": F.least(F.abs(p) * 8.0, F.lit(0.5)) + 0.4,
        }
    )
    return pn.direction_metrics(rows, ["exchange"])


@query(
    "ml_14_skill", "fold i, baseline s, balanced_skill f, brier_skill f",
    f"""
SELECT m.fold, b.baseline, round_even(m.balanced_accuracy - b.balanced_accuracy, 4) AS balanced_skill, CASE WHEN b.brier > 1e-12 THEN round_even(1 - m.brier / b.brier, 4) END AS brier_skill
FROM (SELECT fold, {_CLS} FROM base WHERE baseline = 'persistence' GROUP BY fold) m JOIN (SELECT fold, baseline, {_CLS} FROM base GROUP BY fold, baseline) b USING (fold)""",
    "base",
)
def _(m):
    rows = pn.classification_metrics(_base(m), ["fold", "baseline"])
    return pn.skills(rows.filter(F.col("baseline") == "persistence").drop("baseline"), rows, ["fold"])


@query(
    "ml_14_regression_skill", "exchange s, mae f, skill f",
    f"SELECT exchange, m.mae, round_even(1 - m.mae / b.mae, 4) AS skill FROM (SELECT exchange, {_REG.format('p')} FROM preds GROUP BY exchange) m JOIN (SELECT exchange, {_REG.format('0.0')} FROM preds GROUP BY exchange) b USING (exchange)",
    "preds",
)
def _(m):
    rows = preds(m).withColumn("zero", F.lit(0.0))
    return pn.regression_skill(pn.regression_metrics(rows, ["exchange"], "a", "p"), pn.regression_metrics(rows, ["exchange"], "a", "zero"), ["exchange"])


_EVAL = "fold i, kind s, n i, accuracy f, balanced_accuracy f, brier f, balanced_skill f"


FORWARD = (fixed.FORWARD_FEATURES, "label", 2)
DIRECTION = (fixed.NEXT_CLOSE_FEATURES, "direction_label", 3)


def _forward(m, windows, kinds=candidates.KINDS):
    """Test predictions of forward-return candidates on five folds, with their training table."""
    panel = candidates.stored(pn.forward_panel(m.bars, m.stocks), "forward-panel")
    table = candidates.training_table(panel, pn.folds(panel, 5, 14), windows, *FORWARD)
    return candidates.binary_metrics(candidates.predictions(table, *FORWARD, kinds, candidates.FORWARD_BOOSTING), table)


def _direction(m):
    """Three-class candidates: kinds by windows on three folds."""
    panel = candidates.stored(panel3(m), "next-close-panel")
    table = candidates.training_table(panel, pn.folds(panel, 3, 3), candidates.WINDOWS, *DIRECTION)
    return candidates.direction_metrics(candidates.predictions(table, *DIRECTION), table)


@query("ml_08_candidate_kinds", _EVAL)
def _(m):
    return _forward(m, (730,))


_DIRECTION = "n i, accuracy f, balanced_accuracy f, macro_f1 f, macro_precision f, coverage f, high_confidence_precision f"


@query("ml_08_direction_candidates", f"kind s, rolling_days i, fold i, {_DIRECTION}, balanced_skill f")
def _(m):
    return _direction(m)


@query("ml_16_direction_selection", f"kind s, rolling_days i, folds i, {_DIRECTION}, skill_vs_naive f, recent_fold_skill f, is_best b, status s")
def _(m):
    return candidates.select_direction(_direction(m))


def _next_close(m):
    panel = candidates.stored(panel3(m), "next-close-panel")
    return candidates.evaluate_next_close(panel, pn.folds(panel, 5, 3))


@query("ml_09_next_close_folds", "fold i, predictor s, n i, mae f, mape f, direction_hit_rate f")
def _(m):
    return _next_close(m)[0]


@query("ml_09_next_close_skill", "predictor s, n i, mae f, mape f, direction_hit_rate f, skill_vs_it f")
def _(m):
    return _next_close(m)[1]


@query("ml_09_zero_inflated_return", "exchange s, n i, mae f, direction_hit_rate f")
def _(m):
    panel = cut_lineage(panel3(m))
    parts = pn.split(panel, pn.folds(panel, 5, 3))
    out = None
    for r in parts.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b")).filter("a > 0 AND b > 0").orderBy("fold").collect():
        rows = parts.filter(F.col("fold") == r["fold"])
        fitted = models.fit_zero_inflated(rows.filter(F.col("part") == "train"), fixed.NEXT_CLOSE_FEATURES)
        e = models.predict_zero_inflated(fitted, rows.filter(F.col("part") == "test"), fixed.NEXT_CLOSE_FEATURES)
        out = e if out is None else out.unionByName(e)
    return pn.regression_metrics(out, ["exchange"], "fwd_ret_1", "predicted_return")


@query("ml_15_walk_forward_evaluation", _EVAL)
def _(m):
    return _forward(m, (None,), ("logistic",))


@query("ml_16_candidate_selection", "kind s, rolling_days i, skill_vs_naive f, folds i, is_best b, status s")
def _(m):
    return models.gate(models.select_candidate(_forward(m, candidates.WINDOWS)))


@query(
    "ml_17_pooling_decision", "justified b, reason s",
    f"""
SELECT CASE WHEN (d > 0) <> (c > 0) THEN 'one passes and the other does not' WHEN abs(d - c) > 0.15 THEN 'skill diverges' ELSE 'consistent' END AS reason, NOT ((d > 0) <> (c > 0)) AND abs(d - c) <= 0.15 AS justified
FROM (SELECT max(skill) FILTER (exchange = 'DSE') AS d, max(skill) FILTER (exchange = 'CSE') AS c FROM (SELECT exchange, round_even(1 - m.mae / b.mae, 4) AS skill FROM (SELECT exchange, {_REG.format('p')} FROM preds GROUP BY exchange) m JOIN (SELECT exchange, {_REG.format('0.0')} FROM preds GROUP BY exchange) b USING (exchange)))""",
    "preds",
)
def _(m):
    rows = preds(m).withColumn("zero", F.lit(0.0))
    model = pn.regression_metrics(rows, ["exchange"], "a", "p")
    s = pn.regression_skill(model, pn.regression_metrics(rows, ["exchange"], "a", "zero"), ["exchange"])
    return pn.pooling(s.join(model.select("exchange", "n"), "exchange"), 300, True)


@query("ml_18_final_fit_class_returns", "direction_label i, class_return f, rows i, calibration s")
def _(m):
    return models.final_fit(cut_lineage(panel3(m)), "logistic", 730)[2]


@query("ml_18_calibrated_scores", "exchange s, symbol s, date d, top_probability f, p_down f, p_flat f, p_up f, calibration s")
def _(m):
    """The final model, calibrated where it could be, on each member's newest complete row."""
    panel = cut_lineage(panel3(m))
    fitted, calibrator, classes = models.final_fit(panel, "logistic", 730)
    newest = panel.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in panel.columns if c not in KEY]), "date").alias("r")).select(*KEY, "r.*")
    scored = models.direction_probabilities(fitted, newest, fixed.NEXT_CLOSE_FEATURES)
    out = models.calibrated(calibrator, scored) if calibrator is not None else scored.withColumn("top_probability", F.array_max("p3"))
    p = [F.get("p3", F.lit(k)).alias(n) for k, n in enumerate(("p_down", "p_flat", "p_up"))]
    return out.select(*KEY, "date", "top_probability", *p, classes.select(F.first("calibration")).scalar().alias("calibration"))


@query("ml_18_holdout_report", f"exchange s, {CLS}")
def _(m):
    return models.holdout_report(candidates.stored(pn.forward_panel(m.bars, m.stocks), "forward-panel"), "logistic")


def registry(m):
    """Model registry rows: orders stand in for training runs."""
    o = m.table("orders")
    k = F.col("o_custkey")
    skill = (F.col("o_totalprice") % 100) / 1000.0 - 0.05
    return o.select(
        F.lit("forward_return").alias("model_name"), F.when(k % 2 == 0, "DSE").otherwise("CSE").alias("scope"), F.col("o_orderkey").alias("version"),
        F.to_date("o_orderdate").alias("data_cutoff"), skill.alias("skill"), F.lit(False).alias("is_active"),
    )


define(
    "registry", "",
    """
SELECT 'forward_return' AS model_name, CASE WHEN o_custkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS scope, o_orderkey AS version, CAST(o_orderdate AS DATE) AS data_cutoff,
       (o_totalprice % 100) / 1000.0 - 0.05 AS skill FROM orders""",
)
_NEWEST_OK = "SELECT scope, arg_max(version, (data_cutoff, version)) FILTER (skill > 0) AS active FROM registry GROUP BY scope"


@query(
    "ml_19_deployment_gate_and_registry", "scope s, version i, data_cutoff d, is_active b",
    f"SELECT r.scope, version, data_cutoff, version = active AS is_active FROM registry r JOIN ({_NEWEST_OK}) USING (scope)", "registry",
)
def _(m):
    runs = registry(m)
    best = runs.filter(F.col("skill") > 0).groupBy("model_name", "scope").agg(F.max_by("version", F.struct("data_cutoff", "version")).alias("version"))
    # the candidate passes the gate by its overall and its newest fold's skill; each scope has an older active model
    candidate = runs.join(best, ["model_name", "scope", "version"], "left_semi").drop("is_active")
    new = models.gate(candidate.withColumns({"skill_vs_naive": F.col("skill"), "recent_fold_skill": F.col("skill")}))
    first = runs.groupBy("model_name", "scope").agg(F.min_by("version", F.struct("data_cutoff", "version")).alias("_first"))
    old = runs.join(best, ["model_name", "scope", "version"], "left_anti").join(first, ["model_name", "scope"])
    old = old.withColumn("is_active", F.col("version") == F.col("_first"))
    cols = ["model_name", "scope", "version", "data_cutoff", "skill", "is_active"]
    return models.register(old.select(*cols), new.select(*cols))


@query(
    "ml_20_retrain_needed", "exchange s, candidate_cutoff d, active_cutoff d, retrain b",
    f"""
SELECT l.exchange, candidate_cutoff, active_cutoff, coalesce(candidate_cutoff > active_cutoff, true) AS retrain FROM (SELECT exchange, max(date) AS candidate_cutoff FROM light GROUP BY exchange) l
LEFT JOIN (SELECT r.scope, max(data_cutoff) AS active_cutoff FROM registry r JOIN ({_NEWEST_OK}) x ON x.scope = r.scope AND r.version = x.active GROUP BY r.scope) a ON a.scope = l.exchange""",
    "light registry",
)
def _(m):
    runs = registry(m)
    best = runs.filter(F.col("skill") > 0).groupBy("scope").agg(F.max_by("data_cutoff", F.struct("data_cutoff", "version")).alias("data_cutoff"))
    return pn.retrain_needed(light(m), best.select(F.col("scope").alias("exchange"), "data_cutoff", F.lit(True).alias("is_active")))


@query("ml_21_batch_scoring", "exchange s, symbol s, as_of d, ml_probability f")
def _(m):
    panel = candidates.stored(pn.forward_panel(m.bars, m.stocks), "forward-panel")
    end = panel.select(F.max("date")).scalar()
    model = models.fit_binary(panel.withColumn("train_end", end), fixed.FORWARD_FEATURES, "logistic")
    return models.score_latest(model, feat.latest_vector(m.bars, m.stocks), fixed.FORWARD_FEATURES)
