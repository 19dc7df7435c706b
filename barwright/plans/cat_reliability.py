"""Reliability queries (survey 2.11 RL rows, 2.13)."""

from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import schema_hash
from barwright.functions.rolling import KEY, ahead, change, history
from barwright.operators import listing
from barwright.operators import reliability as rel
from barwright.operators import scoring
from barwright.operators.features import feature_frame
from barwright.operators.indicators import snapshot
from barwright.plans.cat_forecast import forecasts
from barwright.plans.oracle import W, define
from barwright.plans.registry import query

# settled predictions: the last return is the forecast, the next one the outcome
define(
    "rl", "bars",
    f"""
SELECT *, p > 0 AS predicted_class, 1 / (1 + exp(-40 * p)) AS probability, a > 0 AS outcome_class, coalesce(r5 > 0, NULL) AS rule_class, true AS naive_class, 0.0 AS naive_return, p2 AS rule_return,
  close * (1 + p) AS predicted_price, nc AS outcome_price, 0.5 + least(0.45, abs(p) * 5) AS confidence
FROM (SELECT exchange, symbol, date AS data_cutoff, nxt AS target_date, close, nc, close / pc - 1 AS p, nc / close - 1 AS a, close / p5 - 1 AS r5, pc / ppc - 1 AS p2
  FROM (SELECT *, lead(date) OVER {W} AS nxt, lead(close) OVER {W} AS nc, lag(close) OVER {W} AS pc, lag(close, 2) OVER {W} AS ppc, lag(close, 5) OVER {W} AS p5 FROM bars)) WHERE p IS NOT NULL AND a IS NOT NULL""",
)


def predictions(m):
    w = history()
    c = F.col("close")
    df = m.bars.select(
        *KEY, F.col("date").alias("data_cutoff"), F.lead("date").over(w).alias("target_date"), c, F.lead("close").over(w).alias("outcome_price"),
        change(c, w).alias("predicted_return"), ahead(c, w).alias("outcome_return"), change(c, w, 5).alias("r5"),
        (F.try_divide(F.lag("close").over(w), F.lag("close", 2).over(w)) - 1.0).alias("rule_return"),
    ).filter(F.col("predicted_return").isNotNull() & F.col("outcome_return").isNotNull())
    p = F.col("predicted_return")
    return df.withColumns(
        {
            "predicted_class": p > 0, "probability": F.lit(1.0) / (F.lit(1.0) + F.exp(p * -40.0)), "outcome_class": F.col("outcome_return") > 0,
            "rule_class": F.col("r5") > 0, "naive_class": F.lit(True), "naive_return": F.lit(0.0), "predicted_price": c * (p + 1.0),
            "confidence": F.least(F.abs(p) * 5.0, F.lit(0.45)) + 0.5,
        }
    )


_HASH_NC = "substring(sha256('" + ",".join(sorted(fixed.NEXT_CLOSE_FEATURES)) + "'), 1, 16)"
define(
    "captured", "forecasts bars",
    f"""
SELECT f.exchange, f.symbol, f.as_of AS data_cutoff, f.target_date, f.last_close AS reference_close, f.predicted_return, {_HASH_NC} AS schema_hash, p.persistence AS rule_baseline_return,
  CASE WHEN confidence >= 0.8 THEN 'Very high' WHEN confidence >= 0.6 THEN 'High' WHEN confidence >= 0.4 THEN 'Moderate' WHEN confidence >= 0.2 THEN 'Low' ELSE 'Very low' END AS confidence_label
FROM forecasts f LEFT JOIN (SELECT exchange, symbol, arg_max(close, date) / arg_max(pc, date) - 1 AS persistence FROM (SELECT *, lag(close) OVER {W} AS pc FROM bars WHERE date <= DATE '2001-10-12') GROUP BY ALL) p
  ON p.exchange = f.exchange AND p.symbol = f.symbol
WHERE as_of = DATE '2001-10-12' AND NOT f.symbol LIKE '%7'""",
)


def _captured(m):
    day = F.lit("2001-10-12").cast("date")
    served = forecasts(m).filter(F.col("as_of") == day).select(
        F.lit("next_close").alias("family"), F.lit("v1").alias("version"), *KEY, F.col("as_of").alias("data_cutoff"), F.lit(1).alias("horizon"), "target_date",
        F.col("last_close").alias("reference_close"), "predicted_return", "confidence",
    )
    on_record = served.filter(F.col("symbol").endswith("7")).select(*rel.UNIQUE)
    return rel.capture(served, fixed.NEXT_CLOSE_FEATURES, rel.persistence_returns(m.bars, day), on_record)


@query(
    "rl_01_prediction_capture",
    "exchange s, symbol s, data_cutoff d, target_date d, reference_close f, predicted_return f, schema_hash s, rule_baseline_return f, confidence_label s", "SELECT * FROM captured", "captured",
)
def _(m):
    return _captured(m)


_HASH_FORWARD = "substring(sha256('" + ",".join(sorted(fixed.FORWARD_FEATURES)) + "'), 1, 16)"


@query(
    "rl_01_forward_return_capture",
    "exchange s, symbol s, version i, data_cutoff d, target_date d, reference_close f, probability f, predicted_class b, rule_baseline_class b, naive_class b, confidence f, confidence_label s, schema_hash s",
    f"""
SELECT *, CASE WHEN confidence >= 0.8 THEN 'Very high' WHEN confidence >= 0.6 THEN 'High' WHEN confidence >= 0.4 THEN 'Moderate' WHEN confidence >= 0.2 THEN 'Low' ELSE 'Very low' END AS confidence_label, {_HASH_FORWARD} AS schema_hash
FROM (SELECT s.*, c.target_date, n.naive_class, v.version, s.probability > 0.5 AS predicted_class, s.rule_score > 0 AS rule_baseline_class, abs(s.probability - 0.5) * 2 AS confidence
  FROM (SELECT exchange, symbol, as_of AS data_cutoff, close AS reference_close, 1 / (1 + exp(-40 * return_5d)) AS probability, score AS rule_score FROM analysis WHERE return_5d IS NOT NULL AND NOT symbol LIKE '%7') s
  ASOF JOIN (SELECT scope, data_cutoff, max(version) AS version FROM registry WHERE skill > 0 GROUP BY ALL) v ON v.scope = s.exchange AND v.data_cutoff <= s.data_cutoff
  ASOF LEFT JOIN (SELECT train_end, avg(label) > 0.5 AS naive_class FROM light JOIN folds ON date <= train_end GROUP BY train_end) n ON n.train_end <= s.data_cutoff
  LEFT JOIN (SELECT c.date, t.date AS target_date FROM cal c JOIN cal t ON t.is_session AND t.session_no = c.session_no + 10) c ON c.date = s.data_cutoff)""",
    "analysis registry light folds cal",
)
def _(m):
    """Every security's newest analysis; securities whose code ends in 7 are on record already."""
    from barwright.operators import calendar as cal
    from barwright.operators import panel as pn
    from barwright.plans.cat_learning import light, registry
    from barwright.plans.cat_ledger import market_calendar
    from barwright.plans.cat_signals import snapshot_probability

    closes = m.bars.groupBy(*KEY).agg(F.max_by("close", "date").alias("reference_close"))
    analyses = scoring.analysis(m.bars, m.stocks).select(*KEY, F.col("as_of").alias("data_cutoff"), "score").join(closes, KEY).join(snapshot_probability(m), KEY)
    versions = registry(m).filter(F.col("skill") > 0).select(F.col("scope").alias("exchange"), "version", "data_cutoff")
    rows = light(m)
    parts = pn.split(rows, pn.folds(rows, 5, 14)).filter("part = 'train'")
    majority = parts.groupBy("fold", "train_end").agg((F.avg("label") > 0.5).alias("naive_class"))
    sessions = cal.nth_session(market_calendar(m), 10).withColumnRenamed("date", "data_cutoff")
    none = m.spark.createDataFrame([], "family string, version long, exchange string, symbol string, data_cutoff date, horizon int")
    first = rel.capture_forward(analyses, versions, majority, sessions, fixed.FORWARD_FEATURES, none)
    return rel.capture_forward(analyses, versions, majority, sessions, fixed.FORWARD_FEATURES, first.filter(F.col("symbol").endswith("7")))


define(
    "pendings", "bars",
    f"SELECT exchange, symbol, date AS data_cutoff, date + 7 AS target_date, CASE WHEN day(date) = 1 THEN 0 ELSE close END AS reference_close FROM bars",
)


@query(
    "rl_02_outcome_settlement", "exchange s, symbol s, target_date d, settlement_status s, exclusion_reason s, outcome_return f",
    """
SELECT p.exchange, p.symbol, p.target_date, CASE WHEN due AND ok THEN 'SETTLED' WHEN due AND reason IS NOT NULL THEN 'EXCLUDED' ELSE 'PENDING' END AS settlement_status, CASE WHEN due THEN reason END AS exclusion_reason,
  CASE WHEN due AND ok THEN close / reference_close - 1 END AS outcome_return
FROM (SELECT p.*, b.close, p.target_date <= DATE '2001-10-31' AS due, k.symbol IS NOT NULL AND b.close IS NOT NULL AND p.reference_close <> 0 AS ok,
  CASE WHEN k.symbol IS NULL THEN 'stock_deleted' WHEN b.close IS NULL THEN CASE WHEN DATE '2001-10-31' - p.target_date >= 30 THEN 'no_settlement_data_available' END WHEN p.reference_close = 0 THEN 'invalid_reference_price' END AS reason
  FROM pendings p LEFT JOIN bars b ON b.exchange = p.exchange AND b.symbol = p.symbol AND b.date = p.target_date
  LEFT JOIN (SELECT exchange, symbol FROM stocks WHERE is_active) k ON k.exchange = p.exchange AND k.symbol = p.symbol) p""",
    "pendings bars stocks",
)
def _(m):
    day = F.col("date")
    p = m.bars.select(
        *KEY, day.alias("data_cutoff"), F.date_add(day, 7).alias("target_date"), F.when(F.dayofmonth(day) == 1, 0.0).otherwise(F.col("close")).alias("reference_close"),
        F.lit("PENDING").alias("settlement_status"),
    )
    return rel.settle(p, m.bars, m.stocks.filter("is_active"), F.lit("2001-10-31").cast("date"))


def _cls(pred, y="y"):
    return f"(avg(CASE WHEN {pred} THEN 1.0 ELSE 0.0 END) FILTER (outcome_class) + avg(CASE WHEN {pred} THEN 0.0 ELSE 1.0 END) FILTER (NOT outcome_class)) / 2"


def _metrics_sql(src, by):
    keys = ", ".join(by)
    return f"""
SELECT *, round_even(balanced_accuracy - rba, 4) AS skill_vs_rule, round_even(balanced_accuracy - nba, 4) AS skill_vs_naive,
  CASE WHEN precision > 0 AND recall > 0 THEN round_even(2 * precision * recall / (precision + recall), 4) ELSE 0 END AS f1 FROM (
SELECT {keys}, count(*) AS n, round_even(avg(CASE WHEN predicted_class = outcome_class THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round_even({_cls('predicted_class')}, 4) AS balanced_accuracy,
  round_even(coalesce(avg(CASE WHEN outcome_class THEN 1.0 ELSE 0.0 END) FILTER (predicted_class), 0), 4) AS precision, round_even(coalesce(avg(CASE WHEN predicted_class THEN 1.0 ELSE 0.0 END) FILTER (outcome_class), 0), 4) AS recall,
  round_even(avg(pow(probability - CASE WHEN outcome_class THEN 1 ELSE 0 END, 2)), 4) AS brier,
  round_even(-avg(ln(CASE WHEN outcome_class THEN greatest(1e-6, least(1 - 1e-6, probability)) ELSE 1 - greatest(1e-6, least(1 - 1e-6, probability)) END)), 4) AS log_loss,
  round_even((avg(CASE WHEN rule_class THEN 1.0 ELSE 0.0 END) FILTER (outcome_class AND rule_class IS NOT NULL) + avg(CASE WHEN rule_class THEN 0.0 ELSE 1.0 END) FILTER (NOT outcome_class AND rule_class IS NOT NULL)) / 2, 4) AS rba,
  round_even({_cls('naive_class')}, 4) AS nba FROM {src} GROUP BY {keys})
LEFT JOIN (SELECT {keys}, round_even((sum(CASE WHEN outcome_class THEN r END) - count(*) FILTER (outcome_class) * (count(*) FILTER (outcome_class) + 1) / 2) / (count(*) FILTER (outcome_class) * count(*) FILTER (NOT outcome_class)), 4) AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY probability) + (count(*) OVER (PARTITION BY {keys}, probability) - 1) / 2 AS r FROM {src}) GROUP BY {keys}) USING ({keys})
LEFT JOIN (SELECT {keys}, round_even(sum(gap), 4) AS calibration_error FROM ({_cal_sql(src, by)}) GROUP BY {keys}) USING ({keys})"""


def _cal_sql(src, by):
    keys = ", ".join(by)
    return f"""SELECT {keys}, bin, n, ap AS avg_predicted, af AS actual_frequency, n / sum(n) OVER (PARTITION BY {keys}) * abs(ap - af) AS gap FROM (
  SELECT {keys}, least(floor(probability * 10), 9) AS bin, count(*) AS n, avg(probability) AS ap, avg(CASE WHEN outcome_class THEN 1.0 ELSE 0.0 END) AS af FROM {src} GROUP BY {keys}, least(floor(probability * 10), 9))"""


@query(
    "rl_03_classifier_metrics",
    "exchange s, n i, accuracy f, balanced_accuracy f, precision f, recall f, brier f, f1 f, log_loss f, roc_auc f, calibration_error f, skill_vs_rule f, skill_vs_naive f",
    _metrics_sql("rl", ["exchange"]), "rl",
)
def _(m):
    return rel.classifier_metrics(predictions(m), ["exchange"])


@query("rl_04_calibration", "exchange s, bin i, n i, avg_predicted f, actual_frequency f, gap f", _cal_sql("rl", ["exchange"]), "rl")
def _(m):
    return rel.calibration(predictions(m), ["exchange"])


_E = "abs(p - a)"


@query(
    "rl_05_regressor_metrics", "exchange s, n i, mae f, mape f, direction_hit_rate f, rmse f, median_absolute_error f, bias f, smape f, correlation f, skill_vs_rule f, skill_vs_naive f",
    f"""
SELECT exchange, count(*) AS n, round_even(avg({_E}), 6) AS mae, round_even(avg(CASE WHEN abs(a) > 1e-9 THEN {_E} / abs(a) END) * 100, 4) AS mape, round_even(avg(CASE WHEN (p >= 0) = (a >= 0) THEN 1.0 ELSE 0.0 END), 4) AS direction_hit_rate,
  round_even(sqrt(avg({_E} * {_E})), 6) AS rmse, round_even(quantile_cont({_E}, 0.5), 6) AS median_absolute_error, round_even(avg(p - a), 6) AS bias,
  round_even(avg(CASE WHEN (abs(p) + abs(a)) / 2 > 1e-6 THEN {_E} / ((abs(p) + abs(a)) / 2) END) * 100, 4) AS smape, round_even(corr(a, p), 4) AS correlation,
  round_even(1 - round_even(avg({_E}), 6) / round_even(avg(abs(p2 - a)), 6), 4) AS skill_vs_rule, round_even(1 - round_even(avg({_E}), 6) / round_even(avg(abs(a)), 6), 4) AS skill_vs_naive
FROM rl GROUP BY exchange""",
    "rl",
)
def _(m):
    return rel.regressor_metrics(predictions(m), ["exchange"])


@query(
    "rl_06_economic_diagnostics", "exchange s, multiplier f, n i, trades i, net_total_return_pct f, max_drawdown_pct f, benchmark_return_pct f, cost_pct f",
    """
SELECT exchange, mult AS multiplier, count(*) AS n, count(*) FILTER (p > 0) AS trades, round_even((exp(sum(g)) - 1) * 100, 4) AS net_total_return_pct, round_even(min(exp(lv - pk) - 1) * 100, 4) AS max_drawdown_pct,
  round_even((exp(sum(ln(1 + a))) - 1) * 100, 4) AS benchmark_return_pct, round_even(count(*) FILTER (p > 0) * 0.011 * mult * 100, 4) AS cost_pct
FROM (SELECT *, max(lv) OVER (PARTITION BY exchange, mult ORDER BY target_date, symbol) AS pk FROM (
  SELECT *, sum(g) OVER (PARTITION BY exchange, mult ORDER BY target_date, symbol) AS lv FROM (
    SELECT *, ln(1 + CASE WHEN p > 0 THEN a - 0.011 * mult ELSE 0 END) AS g FROM rl, (SELECT unnest([1.0, 1.5, 2.0]) AS mult)))) GROUP BY exchange, mult""",
    "rl",
)
def _(m):
    return rel.economic(predictions(m), ["exchange"])


_SEVEN = "CAST('0x' || substr(md5({0}), {1}, 7) AS BIGINT)"
_WEIGHT = " + ".join(f"(u >= {t})::INT" for t in rel.POISSON_STEPS)


@query(
    "rl_07_bootstrap_interval", "exchange s, low f, high f, rounds i",
    f"""
SELECT exchange, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, count(*) AS rounds FROM (
  SELECT exchange, b, sum(v * w) / sum(w) AS mean FROM (SELECT exchange, b, v, {_WEIGHT} AS w FROM (
    SELECT exchange, b, v, (h1 * f1 + h2 * f2 + f3) % {rel.PRIME} AS u
    FROM (SELECT exchange, CASE WHEN predicted_class = outcome_class THEN 1 ELSE 0 END AS v, {_SEVEN.format("exchange || '|' || symbol || '|' || CAST(data_cutoff AS VARCHAR)", 1)} AS h1,
      {_SEVEN.format("exchange || '|' || symbol || '|' || CAST(data_cutoff AS VARCHAR)", 8)} AS h2 FROM rl),
    (SELECT range AS b, {_SEVEN.format("'round ' || range", 1)} AS f1, {_SEVEN.format("'round ' || range", 8)} AS f2, {_SEVEN.format("'round ' || range", 15)} AS f3 FROM range(1000)))) GROUP BY exchange, b) GROUP BY exchange""",
    "rl",
)
def _(m):
    rows = predictions(m).withColumn("correct", F.when(F.col("predicted_class") == F.col("outcome_class"), 1.0).otherwise(0.0))
    return rel.bootstrap_interval(rows, ["exchange"], "correct", [*KEY, "data_cutoff"])


_HALF = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY data_cutoff, exchange, symbol) > floor(count(*) OVER (PARTITION BY {0}) / 2) AS cur FROM {1}"


def _psi_sql(src, by):
    keys = ", ".join(by)
    deciles = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
    edges = f"(SELECT {keys}, list_sort(list_distinct(quantile_cont(p, {deciles}))) AS edges FROM ({src}) WHERE NOT cur GROUP BY {keys})"
    placed = f"""(SELECT h.*, edges, CASE WHEN p >= edges[1] AND p <= edges[-1] THEN least(len(list_filter(edges, lambda x: x <= h.p)), len(edges) - 1) END AS b
      FROM ({src}) h JOIN {edges} USING ({keys}))"""
    grid = f"(SELECT {keys}, nr, nc, unnest(range(1, n_edges)) AS k FROM (SELECT {keys}, count(*) FILTER (NOT cur) AS nr, count(*) FILTER (cur) AS nc, max(len(edges)) AS n_edges FROM {placed} GROUP BY {keys}))"
    counts = f"(SELECT {keys}, b AS k, count(*) FILTER (NOT cur) AS cr, count(*) FILTER (cur) AS cc FROM {placed} WHERE b IS NOT NULL GROUP BY {keys}, b)"
    return f"""SELECT {keys}, round_even(sum((c - r) * ln(c / r)), 4) AS psi FROM (
  SELECT {keys}, greatest(coalesce(cr, 0) / nr, 1e-4) AS r, greatest(coalesce(cc, 0) / nc, 1e-4) AS c FROM {grid} LEFT JOIN {counts} USING ({keys}, k)) GROUP BY {keys}"""


def _ks_sql(src, by):
    keys = ", ".join(by)
    return f"""SELECT {keys}, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum([2.0 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * x * x) FOR k IN range(1, 101)]), 0), 1) END AS ks_p
FROM (SELECT {keys}, max(abs(fa - fb)) AS ks, sqrt(max(na) * max(nb) / (max(na) + max(nb))) * max(abs(fa - fb)) AS x
FROM (SELECT {keys}, p, sum(a) OVER (PARTITION BY {keys})::DOUBLE AS na, sum(b) OVER (PARTITION BY {keys})::DOUBLE AS nb, sum(a) OVER w / sum(a) OVER (PARTITION BY {keys}) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY {keys}) AS fb
  FROM (SELECT {keys}, p, count(*) FILTER (NOT cur) AS a, count(*) FILTER (cur) AS b FROM ({src}) GROUP BY {keys}, p) WINDOW w AS (PARTITION BY {keys} ORDER BY p)) GROUP BY {keys})"""


@query("rl_09_population_stability", "exchange s, psi f", _psi_sql(_HALF.format("exchange", "rl"), ["exchange"]), "rl")
def _(m):
    h = rel.halves(predictions(m), ["exchange"])
    return rel.stability_index(h, ["exchange"], "predicted_return", "is_current")


@query("rl_10_ks_distance", "exchange s, ks f, ks_p f", _ks_sql(_HALF.format("exchange", "rl"), ["exchange"]), "rl")
def _(m):
    from barwright.functions.ranking import ks_distance

    h = rel.halves(predictions(m), ["exchange"]).withColumn("is_reference", ~F.col("is_current"))
    return ks_distance(h, ["exchange"], "predicted_return", "is_reference")


def _drift_sql(src, by):
    keys = ", ".join(by)
    half = _HALF.format(keys, src)
    rate = lambda x, c: f"round_even(avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END) FILTER ({c}), 4)"
    flags = ", ".join(
        f"CASE WHEN {test} THEN '{name}' {more} END"
        for test, name, more in (
            ("psi > 0.25", "prediction drift major", "WHEN psi > 0.1 THEN 'prediction drift moderate'"), ("ks_p < 0.05", "prediction distribution differs", ""),
            ("abs(current_up_rate - reference_up_rate) > 0.15", "class balance shifted", ""), ("current_ece - reference_ece > 0.1", "calibration worsened", ""),
            ("reference_hit_rate - current_hit_rate > 0.15", "hit rate degraded", ""),
        )
    )
    return f"""SELECT *, CASE WHEN n >= 30 THEN [f FOR f IN [{flags}] IF f IS NOT NULL] ELSE [] END AS flags FROM (
SELECT * FROM (SELECT {keys}, count(*) AS n, {rate('(p >= 0) = (a >= 0)', 'NOT cur')} AS reference_hit_rate, {rate('(p >= 0) = (a >= 0)', 'cur')} AS current_hit_rate,
  {rate('outcome_class', 'NOT cur')} AS reference_up_rate, {rate('outcome_class', 'cur')} AS current_up_rate FROM ({half}) GROUP BY {keys})
LEFT JOIN ({_psi_sql(half, by)}) USING ({keys}) LEFT JOIN (SELECT {keys}, round_even(ks, 4) AS ks, round_even(ks_p, 4) AS ks_p FROM ({_ks_sql(half, by)})) USING ({keys})
LEFT JOIN (SELECT {keys}, round_even(sum(gap) FILTER (NOT cur), 4) AS reference_ece, round_even(sum(gap) FILTER (cur), 4) AS current_ece FROM ({_cal_sql(f"({half})", [*by, "cur"])}) GROUP BY {keys}) USING ({keys}))"""


@query(
    "rl_11_split_half_drift", "exchange s, n i, psi f, ks f, reference_hit_rate f, current_hit_rate f, reference_up_rate f, current_up_rate f, reference_ece f, current_ece f, ks_p f, flag_text s",
    f"SELECT *, array_to_string(flags, ', ') AS flag_text FROM ({_drift_sql('rl', ['exchange'])})", "rl",
)
def _(m):
    return rel.drift(predictions(m), ["exchange"]).withColumn("flag_text", F.array_join("flags", ", "))


define(
    "rlw", "rl",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY data_cutoff DESC, exchange, symbol) AS place FROM rl), (SELECT unnest([30, 90, 180, 365]) AS window_size) WHERE place <= window_size""",
)
_BY = ["exchange", "window_size"]


@query(
    "rl_13_assessment_metrics",
    "exchange s, window_size i, n i, accuracy f, balanced_accuracy f, roc_auc f, log_loss f, calibration_error f, skill_vs_naive f, psi f, ks f, reference_hit_rate f, current_hit_rate f, period_start d, period_end d",
    f"""
SELECT * FROM ({_metrics_sql('rlw', _BY)}) JOIN (SELECT * EXCLUDE (n) FROM ({_drift_sql('rlw', _BY)})) USING (exchange, window_size)
JOIN (SELECT exchange, window_size, min(data_cutoff) AS period_start, max(data_cutoff) AS period_end FROM rlw GROUP BY ALL) USING (exchange, window_size)""",
    "rlw",
)
def _(m):
    return rel.assess(predictions(m), ["exchange"])


# both families: the next close from one session's return, ten sessions ahead from five; the schema of an exchange is that
# of its newest model with positive skill: even versions hold the forward features, odd ones the next-close features
define(
    "rls", "rl bars registry",
    f"""
SELECT s.*, coalesce(v.schema_hash, 'unknown') AS schema_hash FROM (
  SELECT 'next_close' AS family, 1 AS horizon, exchange, symbol, data_cutoff, p, a, r5 > 0 AS rule_class FROM rl
  UNION ALL SELECT 'forward_return', 10, exchange, symbol, date, p5, a10, p1 > 0 FROM (
    SELECT exchange, symbol, date, close / lag(close, 5) OVER {W} - 1 AS p5, lead(close, 10) OVER {W} / close - 1 AS a10, close / lag(close) OVER {W} - 1 AS p1 FROM bars) WHERE p5 IS NOT NULL AND a10 IS NOT NULL) s
ASOF LEFT JOIN (SELECT scope, data_cutoff, CASE WHEN max(version) % 2 = 0 THEN {_HASH_FORWARD} ELSE {_HASH_NC} END AS schema_hash FROM registry WHERE skill > 0 GROUP BY ALL) v
  ON v.scope = s.exchange AND v.data_cutoff <= s.data_cutoff""",
)
define(
    "rlsw", "rls",
    """
SELECT *, p > 0 AS predicted_class, 1 / (1 + exp(-40 * p)) AS probability, a > 0 AS outcome_class, true AS naive_class
FROM (SELECT *, row_number() OVER (PARTITION BY family, exchange, horizon, schema_hash ORDER BY data_cutoff DESC, exchange, symbol) AS place FROM rls), (SELECT unnest([30, 90, 180, 365]) AS window_size) WHERE place <= window_size""",
)
_SCOPE = ["family", "exchange", "horizon", "schema_hash", "window_size"]


def _families(m):
    """Settled predictions of both families."""
    w, c = history(), F.col("close")
    shared = [*KEY, "data_cutoff", "predicted_return", "outcome_return", "rule_class"]
    near = predictions(m).select(F.lit("next_close").alias("family"), F.lit(1).alias("horizon"), *shared)
    far = m.bars.select(
        F.lit("forward_return").alias("family"), F.lit(10).alias("horizon"), *KEY, F.col("date").alias("data_cutoff"), change(c, w, 5).alias("predicted_return"),
        ahead(c, w, 10).alias("outcome_return"), (change(c, w) > 0).alias("rule_class"),
    ).filter(F.col("predicted_return").isNotNull() & F.col("outcome_return").isNotNull())
    p = F.col("predicted_return")
    return near.unionByName(far).withColumns({"predicted_class": p > 0, "probability": F.lit(1.0) / (F.lit(1.0) + F.exp(p * -40.0)), "outcome_class": F.col("outcome_return") > 0, "naive_class": F.lit(True)})


@query(
    "rl_13_assessment_scopes",
    "family s, exchange s, horizon i, schema_hash s, window_size i, n i, accuracy f, balanced_accuracy f, roc_auc f, log_loss f, calibration_error f, skill_vs_naive f, psi f, ks f, reference_hit_rate f, current_hit_rate f, period_start d, period_end d",
    f"""
SELECT * FROM ({_metrics_sql('rlsw', _SCOPE)}) JOIN (SELECT * EXCLUDE (n) FROM ({_drift_sql('rlsw', _SCOPE)})) USING ({', '.join(_SCOPE)})
JOIN (SELECT {', '.join(_SCOPE)}, min(data_cutoff) AS period_start, max(data_cutoff) AS period_end FROM rlsw GROUP BY ALL) USING ({', '.join(_SCOPE)})""",
    "rlsw",
)
def _(m):
    from barwright.plans.cat_learning import registry

    rows = _families(m)
    hashed = F.when(F.col("version") % 2 == 0, schema_hash(F.array(*map(F.lit, fixed.FORWARD_FEATURES)))).otherwise(schema_hash(F.array(*map(F.lit, fixed.NEXT_CLOSE_FEATURES))))
    newest = registry(m).filter(F.col("skill") > 0).groupBy(F.col("scope").alias("exchange"), F.col("data_cutoff").alias("since")).agg(F.max("version").alias("version"))
    return rel.assess_scopes(rows, newest.select("exchange", "since", hashed.alias("schema_hash")))


# assessments on record: one at each month's and each quarter's last settled day
define(
    "assessments", "rls",
    """
SELECT family, exchange, horizon, span, max(data_cutoff) AS assessed_on, count(*) AS n, avg(CASE WHEN (p > 0) = (a > 0) THEN 1.0 ELSE 0.0 END) AS accuracy
FROM (SELECT *, unnest(['month', 'quarter']) AS span FROM rls) GROUP BY family, exchange, horizon, span, date_trunc(span, data_cutoff)""",
)


def _assessments(m):
    span = F.explode(F.array(F.lit("month"), F.lit("quarter"))).alias("span")
    rows = _families(m).select("family", "exchange", "horizon", "data_cutoff", (F.col("predicted_class") == F.col("outcome_class")).alias("hit"), span)
    start = F.when(F.col("span") == "month", F.trunc("data_cutoff", "month")).otherwise(F.trunc("data_cutoff", "quarter"))
    return rows.groupBy("family", "exchange", "horizon", "span", start.alias("start")).agg(
        F.max("data_cutoff").alias("assessed_on"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("accuracy")
    )


_ASSESSMENT = "family s, exchange s, horizon i, span s, assessed_on d, n i, accuracy f"


@query(
    "prj_09_latest_by_scope", _ASSESSMENT,
    "SELECT * FROM assessments QUALIFY row_number() OVER (PARTITION BY family, exchange, horizon, span ORDER BY assessed_on DESC) = 1", "assessments",
)
def _(m):
    return listing.latest_by(_assessments(m), ["family", "exchange", "horizon", "span"], "assessed_on", "n")


@query(
    "prj_09_history_of_scope", _ASSESSMENT,
    "SELECT * FROM assessments WHERE family = 'forward_return' AND exchange = 'CSE' AND span = 'month' ORDER BY assessed_on DESC LIMIT 20", "assessments",
)
def _(m):
    rows = _assessments(m).filter("family = 'forward_return' AND exchange = 'CSE' AND span = 'month'")
    return listing.page(rows, [F.desc("assessed_on")], 20)


def _assess_sql():
    some = lambda *cases: "[r FOR r IN [" + ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in cases) + "] IF r IS NOT NULL]"
    reasons = some(
        ("n < 30", "format('too few settled predictions: {:d} of 30', n)"),
        ("n >= 30 AND s IS NULL", "format('skill could not be computed from {:d} predictions', n)"),
        ("n >= 30 AND s <= 0", "printf('skill %.4f is not positive over %d predictions', s, n)"),
        ("n >= 30 AND s > 0 AND n < 60", "printf('skill %.4f is provisional with %d of 60 predictions', s, n)"),
        ("n >= 30 AND s IS NOT NULL AND bad_cal", "printf('calibration error %.4f is high', calibration_error)"),
        ("n >= 30 AND s IS NOT NULL AND len(flags) > 0", "'drift: ' || array_to_string(flags, ', ')"),
        ("n >= 60 AND s > 0 AND NOT bad_cal AND len(flags) = 0", "printf('skill %.4f over %d predictions, no concerns', s, n)"),
    )
    weak = "status IN ('degraded', 'critical')"
    recs = some(
        ("calibration_error > 0.15", "'recalibrate_probabilities'"), ("reference_hit_rate - current_hit_rate > 0.15", "'retrain_using_newer_data'"),
        ("psi > 0.25", "'inspect_specific_feature'"), ("current_ece - reference_ece > 0.1", "'reduce_confidence_or_abstain'"),
        (weak, "'downgrade_to_experimental'"), (weak, "'compare_against_simpler_baseline'"),
    )
    return f"""
SELECT *, array_to_string({reasons}, '; ') AS reasons,
  CASE WHEN status = 'insufficient_data' THEN 'collect_more_outcomes' WHEN status = 'healthy' AND len({recs}) = 0 THEN 'continue_serving' ELSE array_to_string({recs}, ',') END AS recommendations
FROM (SELECT *, CASE WHEN n < 30 THEN 'insufficient_data' WHEN s IS NULL THEN 'watch' WHEN s <= 0 THEN CASE WHEN n >= 60 THEN 'critical' ELSE 'degraded' END
    WHEN n < 60 OR bad_cal OR len(flags) > 0 THEN 'watch' ELSE 'healthy' END AS status
  FROM (SELECT *, skill_vs_naive::DOUBLE AS s, coalesce(calibration_error > 0.15, false) AS bad_cal
    FROM ({_metrics_sql('rlw', _BY)}) JOIN (SELECT * EXCLUDE (n) FROM ({_drift_sql('rlw', _BY)})) USING (exchange, window_size)))"""


@query("rl_08_assessment_status", "exchange s, window_size i, n i, status s, reasons s, recommendations s", _assess_sql(), "rlw")
def _(m):
    return rel.assess(predictions(m), ["exchange"])


@query(
    "rl_12_exchange_divergence", "window_size i, dse_skill f, cse_skill f, separate_models b",
    f"SELECT window_size, max(skill_vs_naive) FILTER (exchange = 'DSE') AS dse_skill, max(skill_vs_naive) FILTER (exchange = 'CSE') AS cse_skill, abs(max(skill_vs_naive) FILTER (exchange = 'DSE') - max(skill_vs_naive) FILTER (exchange = 'CSE')) > 0.15 AS separate_models FROM ({_metrics_sql('rlw', _BY)}) GROUP BY window_size",
    "rlw",
)
def _(m):
    rows = rel.windows(predictions(m), ["exchange"])
    return rel.exchange_divergence(rel.classifier_metrics(rows, _BY))


@query(
    "rl_14_next_close_diagnostics", "kind s, label s, n i, mape f, direction_hit_rate f, win_rate f, status s",
    """
SELECT *, CASE WHEN n >= 20 AND direction_hit_rate >= 53 AND mape < 2 THEN 'GREEN' WHEN n >= 20 AND direction_hit_rate < 50 THEN 'RED' ELSE 'YELLOW' END AS status FROM (
SELECT kind, label, count(*) AS n, round_even(avg(abs(predicted_price - outcome_price) / outcome_price * 100), 3) AS mape, round_even(avg(CASE WHEN (p >= 0) = (a >= 0) THEN 100.0 ELSE 0.0 END), 1) AS direction_hit_rate,
  round_even(avg(CASE WHEN a > 0 THEN 100.0 ELSE 0.0 END), 1) AS win_rate
FROM (SELECT r.*, unnest([{'kind': 'confidence', 'label': CASE WHEN confidence < 0.55 THEN 'Below 55%' WHEN confidence < 0.6 THEN '55–59%' WHEN confidence < 0.65 THEN '60–64%' WHEN confidence < 0.7 THEN '65–69%' WHEN confidence < 0.8 THEN '70–79%' ELSE '80%+' END},
   {'kind': 'stock', 'label': r.exchange || ':' || r.symbol}, {'kind': 'sector', 'label': CASE WHEN coalesce(s.sector, '') = '' THEN 'Unknown' ELSE s.sector END}], recursive := true)
  FROM rl r LEFT JOIN stocks s ON s.exchange = r.exchange AND s.symbol = r.symbol) GROUP BY kind, label)""",
    "rl stocks",
)
def _(m):
    return rel.diagnostics(predictions(m).join(m.stocks.select(*KEY, "sector"), KEY, "left"))


@query(
    "rl_15_signal_status", "exchange s, symbol s, action s, has_edge b, age_days i, is_stale b, liquidity s, invalidation s",
    """
SELECT a.exchange, a.symbol, a.action, (k.skill > 0 AND k.train_rows >= 200) OR (k.live_n >= 30 AND k.live_skill > 0) AS has_edge, DATE '2001-11-05' - a.as_of AS age_days, DATE '2001-11-05' - a.as_of > 4 AS is_stale, CASE WHEN coalesce(q.last_volume, 0) = 0 THEN 'unknown' WHEN q.last_volume < 10000 THEN 'thin' WHEN q.last_volume < 100000 THEN 'moderate' ELSE 'active' END AS liquidity,
  CASE a.action WHEN 'BUY' THEN format('closes back below support (~{:.2f})', a.support) WHEN 'SELL' THEN format('reclaims resistance (~{:.2f})', a.resistance) ELSE 'neutral' END AS invalidation
FROM analysis a JOIN quoted q ON q.exchange = a.exchange AND q.symbol = a.symbol JOIN (SELECT exchange, round_even(avg(CASE WHEN outcome_class THEN 1.0 ELSE 0.0 END) - 0.5, 4) AS skill, count(*) AS train_rows,
  count(*) FILTER (data_cutoff >= DATE '2001-06-01') AS live_n, round_even(avg(CASE WHEN predicted_class = outcome_class THEN 1.0 ELSE 0.0 END) FILTER (data_cutoff >= DATE '2001-06-01') - 0.5, 4) AS live_skill
  FROM rl GROUP BY exchange) k ON k.exchange = a.exchange""",
    "analysis quoted rl",
)
def _(m):
    live = F.col("data_cutoff") >= F.lit("2001-06-01").cast("date")
    share = lambda test: F.when(test, 1.0).otherwise(0.0)
    right = share(F.col("predicted_class") == F.col("outcome_class"))
    facts = predictions(m).groupBy("exchange").agg(
        F.lit(True).alias("deployed"), F.bround(F.avg(share(F.col("outcome_class"))) - 0.5, 4).alias("skill"), F.count(F.lit(1)).alias("train_rows"),
        F.count_if(live).alias("live_n"), F.bround(F.avg(F.when(live, right)) - 0.5, 4).alias("live_skill"),
    )
    levels = snapshot(m.bars).select(*KEY, "support", "resistance")
    return rel.signal_status(scoring.analysis(m.bars, m.stocks), m.quoted, levels, facts, F.lit("2001-11-05").cast("date"))


@query(
    "rl_16_daily_report_facts", "exchange s, window_size i, evidence s, n i, verdict s, advice s",
    f"""
SELECT *, CASE WHEN n = 0 THEN 'Experimental' WHEN status = 'insufficient_data' THEN 'Promising' WHEN status = 'healthy' THEN CASE WHEN n >= 100 THEN 'Stable' ELSE 'Promising' END
    WHEN status = 'watch' THEN 'Weak' ELSE 'Declining' END AS verdict,
  CASE WHEN len(found) > 0 THEN array_to_string(found[1:3], ',') ELSE 'no_concerns' END AS advice
FROM (SELECT *, CASE WHEN n >= 300 THEN 'Stronger evidence' WHEN n >= 100 THEN 'Moderate' WHEN n >= 30 THEN 'Limited' ELSE 'Very limited' END AS evidence,
  [r FOR r IN [CASE WHEN status IN ('degraded', 'critical') THEN 'pause_promotion' END, CASE WHEN calibration_error > 0.15 THEN 'adjust_confidence' END, CASE WHEN n < 60 THEN 'collect_more' END] IF r IS NOT NULL] AS found
  FROM ({_assess_sql()}))""",
    "rlw",
)
def _(m):
    return rel.daily_report(rel.assess(predictions(m), ["exchange"]), F.lit(False), F.lit(False))


define(
    "reports", "rl",
    """
SELECT exchange, last_day(data_cutoff) AS report_date, 'v' || year(last_day(data_cutoff)) AS version, count(*) AS live_n, avg(CASE WHEN outcome_class THEN 1.0 ELSE 0.0 END) FILTER (predicted_class) AS live_precision FROM rl GROUP BY ALL""",
)


@query(
    "rl_16_report_trend", "exchange s, report_date d, live_precision f, trend s",
    """
SELECT *, CASE WHEN pn IS NULL THEN NULL WHEN pv <> version THEN 'version_changed' WHEN pn = live_n THEN 'no_new_evidence' WHEN pp IS NULL OR live_precision IS NULL THEN 'insufficient_history'
  WHEN abs(live_precision - pp) * 100 < 3 THEN 'stable' WHEN live_precision > pp THEN 'improving' ELSE 'declining' END AS trend
FROM (SELECT *, lag(version) OVER w AS pv, lag(live_n) OVER w AS pn, lag(live_precision) OVER w AS pp FROM reports WINDOW w AS (PARTITION BY exchange ORDER BY report_date))""",
    "reports",
)
def _(m):
    day = F.last_day("data_cutoff")
    reports = predictions(m).groupBy("exchange", day.alias("report_date")).agg(
        F.count(F.lit(1)).alias("live_n"), F.avg(F.when(F.col("predicted_class"), F.when(F.col("outcome_class"), 1.0).otherwise(0.0))).alias("live_precision")
    )
    reports = reports.withColumns({"version": F.concat(F.lit("v"), F.year("report_date").cast("string")), "trained_today": F.lit(False)})
    return rel.report_trend(reports)


# ------------------------------------------------------------------ sets and scalar functions


@query(
    "set_01_union_of_sources", "symbol s, sources s",
    "SELECT symbol, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM (SELECT symbol, 'bars' AS src FROM bars_all UNION ALL SELECT symbol, 'ledger' FROM ledger UNION ALL SELECT symbol, 'quotes' FROM quotes) GROUP BY symbol",
    "bars_all ledger quotes",
)
def _(m):
    tagged = lambda df, name: df.select("symbol", F.lit(name).alias("src"))
    u = tagged(m.bars_all, "bars").unionByName(tagged(m.ledger, "ledger")).unionByName(tagged(m.quotes, "quotes"))
    return u.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


@query(
    "set_02_feature_schema_change", "exchange s, missing s, added s, changed b",
    "SELECT DISTINCT exchange, 'turnover_ratio' AS missing, '" + ",".join(sorted(set(fixed.NEXT_CLOSE_FEATURES) - set(fixed.FORWARD_FEATURES))) + "' AS added, true AS changed FROM stocks", "stocks",
)
def _(m):
    trained, current = (F.array(*map(F.lit, x)) for x in (fixed.FORWARD_FEATURES, fixed.NEXT_CLOSE_FEATURES))
    c = rel.schema_change(trained, current)
    return m.stocks.select("exchange").distinct().select("exchange", F.array_join(c["missing"], ",").alias("missing"), F.array_join(c["added"], ",").alias("added"), c["changed"].alias("changed"))


# which features a security's first and newest rows hold: the schema a model trained then, or now, would have
_FEATURES = sorted(set(fixed.NEXT_CLOSE_FEATURES) | set(fixed.FORWARD_FEATURES))
define(
    "schemas", "feat",
    "SELECT exchange, symbol, arg_min(names, date) AS trained, arg_max(names, date) AS current FROM (SELECT exchange, symbol, date, list_filter(["
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in _FEATURES)
    + "], lambda x: x IS NOT NULL) AS names FROM feat) GROUP BY exchange, symbol",
)


def _schemas(m):
    names = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in _FEATURES]))
    rows = feature_frame(m.bars, m.stocks).select(*KEY, "date", names.alias("names"))
    return rows.groupBy(*KEY).agg(F.min_by("names", "date").alias("trained"), F.max_by("names", "date").alias("current"))


@query(
    "set_02_available_features_change", "exchange s, symbol s, missing s, added s, changed b",
    """
SELECT *, missing <> '' OR added <> '' AS changed FROM (SELECT exchange, symbol, array_to_string(list_sort(list_filter(trained, lambda x: NOT list_contains(current, x))), ',') AS missing,
  array_to_string(list_sort(list_filter(current, lambda x: NOT list_contains(trained, x))), ',') AS added FROM schemas)""",
    "schemas",
)
def _(m):
    c = rel.schema_change(F.col("trained"), F.col("current"))
    return _schemas(m).select(*KEY, F.array_join(c["missing"], ",").alias("missing"), F.array_join(c["added"], ",").alias("added"), c["changed"].alias("changed"))


@query(
    "fn_06_available_features_hash", "exchange s, symbol s, trained_hash s, current_hash s",
    "SELECT exchange, symbol, substring(sha256(array_to_string(list_sort(trained), ',')), 1, 16) AS trained_hash, substring(sha256(array_to_string(list_sort(current), ',')), 1, 16) AS current_hash FROM schemas",
    "schemas",
)
def _(m):
    return _schemas(m).select(*KEY, schema_hash(F.col("trained")).alias("trained_hash"), schema_hash(F.col("current")).alias("current_hash"))


@query(
    "fn_01_strings", "company_name s, found b, masked s, cleaned s",
    "SELECT company_name, company_name ILIKE '%#0000000%' AS found, company_name[1:3] || repeat('*', CAST(length(company_name) - 6 AS BIGINT)) || company_name[-3:] AS masked, upper(trim(regexp_replace('  ' || company_name || '   x ', '\\s+', ' ', 'g'))) AS cleaned FROM stocks",
    "stocks",
)
def _(m):
    from barwright.functions.expr import collapse_spaces, mask_middle

    n = F.col("company_name")
    return m.stocks.select(
        n, n.ilike("%#0000000%").alias("found"), mask_middle(n).alias("masked"), F.upper(collapse_spaces(F.concat(F.lit("  "), n, F.lit("   x ")))).alias("cleaned")
    )


@query(
    "fn_06_schema_hash", "exchange s, hash s", f"SELECT DISTINCT exchange, {_HASH_NC} AS hash FROM stocks", "stocks",
)
def _(m):
    return m.stocks.select("exchange").distinct().select("exchange", schema_hash(F.array(*map(F.lit, fixed.NEXT_CLOSE_FEATURES))).alias("hash"))


@query(
    "set_03_flag_intersection", "exchange s, symbol s, date d, common s",
    "SELECT *, array_to_string(list_sort(list_intersect(quality_flags, ['abnormal_jump', 'gap_before'])), ',') AS common FROM scanned WHERE list_has_any(quality_flags, ['abnormal_jump', 'gap_before'])",
    "scanned",
)
def _(m):
    from barwright.functions.expr import flags_overlap
    from barwright.operators.quality import full_scan
    from barwright.plans.cat_windows import disturbed

    wanted = ["abnormal_jump", "gap_before"]
    df = full_scan(disturbed(m)).filter(flags_overlap(F.col("quality_flags"), wanted))
    return df.withColumn("common", F.array_join(F.array_sort(F.array_intersect("quality_flags", F.array(*map(F.lit, wanted)))), ","))


@query(
    "fn_02_dates", "event_id i, local_day d, in_ten d, weekday i, weekend b, days_to_month_end i",
    "SELECT event_id, CAST(ts + INTERVAL 6 HOUR AS DATE) AS local_day, CAST(ts AS DATE) + 10 AS in_ten, (dayofweek(ts) + 6) % 7 AS weekday, dayofweek(ts) IN (5, 6) AS weekend, last_day(CAST(ts AS DATE)) - CAST(ts AS DATE) AS days_to_month_end FROM events",
)
def _(m):
    from barwright.operators.calendar import is_weekend

    day = F.to_date("ts")
    return m.table("events").select(
        "event_id", F.to_date(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(6))).alias("local_day"), F.date_add(day, 10).alias("in_ten"),
        F.weekday(day).alias("weekday"), is_weekend(day).alias("weekend"), F.date_diff(F.last_day(day), day).alias("days_to_month_end"),
    )


@query(
    "fn_03_math", "event_id i, clipped f, decay f, powered f, sign i, logged f, root f",
    "SELECT event_id, greatest(5, least(60, value)) AS clipped, exp(-value / 55) AS decay, pow(0.5, value / 180) AS powered, sign(value - 20) AS sign, ln(1 + value) AS logged, sqrt(value) AS root FROM events",
)
def _(m):
    from barwright.functions.expr import clip

    v = F.col("value")
    return m.table("events").select(
        "event_id", clip(v, 5, 60).alias("clipped"), F.exp(-v / 55.0).alias("decay"), F.pow(F.lit(0.5), v / 180.0).alias("powered"), F.signum(v - 20.0).alias("sign"),
        F.log1p(v).alias("logged"), F.sqrt(v).alias("root"),
    )


@query(
    "fn_04_rounding", "portfolio_id i, txn_id i, half_up f, half_even f",
    "SELECT portfolio_id, txn_id, floor(price * 100 + 0.5) / 100 AS half_up, round_even(CAST(l_tail AS DOUBLE) / 2, 0) AS half_even FROM (SELECT *, txn_id % 1000 AS l_tail FROM ledger)", "ledger",
)
def _(m):
    return m.ledger.select("portfolio_id", "txn_id", F.round("price", 2).alias("half_up"), F.bround((F.col("txn_id") % 1000) / 2.0).alias("half_even"))


@query(
    "fn_05_json", "run_id i, k i, error s, merged i",
    "SELECT event_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS error, 2 AS merged FROM events",
)
def _(m):
    from barwright.functions.expr import nested_get

    e = m.table("events").select(F.col("event_id").alias("run_id"), nested_get(F.col("props"), "k").alias("k"), F.from_json("props", "map<string,long>").alias("p"))
    d = m.task_runs.select("run_id", nested_get(F.col("detail"), "live.error").alias("error"))
    return e.join(d, "run_id").withColumn("merged", F.size(F.map_concat("p", F.create_map(F.lit("extra"), F.lit(1).cast("long")))))


@query(
    "fn_07_buckets", "event_id i, tenth i, band s",
    "SELECT event_id, least(floor(u * 10), 9) AS tenth, CASE WHEN u >= 0.8 THEN 'Very high' WHEN u >= 0.6 THEN 'High' WHEN u >= 0.4 THEN 'Moderate' WHEN u >= 0.2 THEN 'Low' ELSE 'Very low' END AS band FROM (SELECT *, (event_id % 1001) / 1000.0::DOUBLE AS u FROM events)",
)
def _(m):
    from barwright.functions.expr import confidence_label

    u = (F.col("event_id") % 1001) / 1000.0
    return m.table("events").select("event_id", F.least(F.floor(u * 10), F.lit(9)).alias("tenth"), confidence_label(u).alias("band"))
