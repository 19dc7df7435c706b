"""Forecast queries (survey 2.11, FC rows)."""

import datetime as dt

from pyspark.sql import functions as F

from barwright.functions.rolling import KEY, change, history
from barwright.operators import analogue, calendar, forecast, screen, shadow
from barwright.plans.oracle import W, define
from barwright.plans.registry import query
from barwright.session import work_folder

define(
    "oneday", "bars",
    f"""
SELECT exchange, symbol, max(date) AS as_of, arg_max(close, date) AS last_close, count(*) AS n_rows, quantile_cont(f, 0.5) AS analogue_ret,
  greatest(quantile_cont(f, 0.75) - quantile_cont(f, 0.25), 0.005) AS spread, count(f) AS samples
FROM (SELECT *, lead(close) OVER {W} / close - 1 AS f FROM bars) GROUP BY exchange, symbol""",
)


@query("fc_01_one_day_analogue", "exchange s, symbol s, as_of d, last_close f, analogue_ret f, spread f, samples i", "SELECT * FROM oneday", "oneday")
def _(m):
    return analogue.one_day(m.bars)


# stand-in class probabilities from the last 3-session return, bias from its sign
define(
    "nextclose", "oneday ind",
    """
SELECT exchange, symbol, as_of, round_even(last_close, 4) AS last_close, round_even(last_close * (1 + corr), 4) AS predicted_close, round_even(corr, 6) AS predicted_return,
  round_even(raw, 6) AS raw_return, round_even(bias, 6) AS return_bias, round_even(greatest(0.15, least(0.85, 0.35 + least(samples, 80) / 160 - 4 * spread)), 3) AS confidence, samples
FROM (SELECT *, greatest(-0.12, least(0.12, raw - bias)) AS corr FROM (
SELECT *, 0.5 * (analogue_ret + ml) * mc AS raw FROM (
SELECT o.*, CASE WHEN greatest(pd, pf, pu) >= 0.65 THEN pd * -0.02 + pu * 0.02 ELSE 0 END AS ml, CASE WHEN greatest(pd, pf, pu) >= 0.65 THEN 1 - pf ELSE 1 END AS mc,
       CASE WHEN z > 0 THEN 0.002 ELSE -0.001 END AS bias
FROM oneday o JOIN (SELECT exchange AS e2, symbol AS s2, z, exp(-z) / (exp(-z) + exp(z) + 0.5) AS pd, 0.5 / (exp(-z) + exp(z) + 0.5) AS pf, exp(z) / (exp(-z) + exp(z) + 0.5) AS pu
  FROM (SELECT *, return_3d * 30 AS z FROM ind WHERE rn = n_rows)) ON e2 = o.exchange AND s2 = o.symbol)))""",
)


def _parts(m):
    w = history()
    c = F.col("close")
    z = m.bars.withColumn("z", change(c, w, 3) * 30.0).groupBy(*KEY).agg(F.max_by("z", "date").alias("z"))
    down, up = F.exp(-F.col("z")), F.exp("z")
    total = down + up + 0.5
    probs = z.select(
        *KEY, (down / total).alias("p_down"), (F.lit(0.5) / total).alias("p_flat"), (up / total).alias("p_up"),
        F.lit(-0.02).alias("r_down"), F.lit(0.0).alias("r_flat"), F.lit(0.02).alias("r_up"),
    )
    bias = z.select(*KEY, F.when(F.col("z") > 0, 0.002).otherwise(-0.001).alias("return_bias"))
    return forecast.learned_return(probs), bias


FORECAST = "exchange s, symbol s, as_of d, last_close f, predicted_close f, predicted_return f, raw_return f, return_bias f, confidence f, samples i"


@query("fc_02_next_close_forecast", FORECAST, "SELECT * FROM nextclose", "nextclose")
def _(m):
    learned, bias = _parts(m)
    return forecast.next_close(m.bars, learned, bias)


@query(
    "fc_03_generated_forecasts", "exchange s, symbol s, target_date d, predicted_close f, predicted_return f, candidate_return f, method s",
    """
SELECT exchange, symbol, DATE '2001-11-05' AS target_date, last_close AS predicted_close, 0.0 AS predicted_return, predicted_return AS candidate_return, 'analogue+ml+ctx+bias+naive_gate' AS method
FROM nextclose WHERE NOT (exchange = 'CSE' AND symbol LIKE '%1')""",
    "nextclose",
)
def _(m):
    learned, bias = _parts(m)
    written = m.stocks.filter((F.col("exchange") == "CSE") & F.col("symbol").endswith("1")).select(*KEY, F.lit("2001-11-05").cast("date").alias("target_date"))
    return forecast.generate(m.bars, written, F.lit("2001-11-05").cast("date"), True, learned=learned, bias=bias)


# the forecast ledger: every bar with a known 5-session return gives one row
define(
    "forecasts", "bars",
    f"""
SELECT exchange, symbol, date AS as_of, coalesce(nxt, date + 1) AS target_date, round_even(close, 4) AS last_close, round_even(r5 / 10, 6) AS predicted_return,
  round_even(close * (1 + r5 / 10), 4) AS predicted_close, round_even(r5 / 20, 6) AS candidate_return, 0.5 + least(0.45, abs(r5) * 5) AS confidence, nc AS actual_close, nv
FROM (SELECT *, close / lag(close, 5) OVER {W} - 1 AS r5, lead(date) OVER {W} AS nxt, lead(close) OVER {W} AS nc, lead(volume) OVER {W} AS nv FROM bars) WHERE r5 IS NOT NULL""",
)


def forecasts(m):
    w = history()
    c = F.col("close")
    df = m.bars.withColumns({"r5": change(c, w, 5), "nxt": F.lead("date").over(w), "nc": F.lead("close").over(w)}).filter(F.col("r5").isNotNull())
    r = F.col("r5")
    return df.select(
        *KEY, F.col("date").alias("as_of"), F.coalesce("nxt", F.date_add("date", 1)).alias("target_date"), F.bround(c, 4).alias("last_close"),
        F.bround(r / 10.0, 6).alias("predicted_return"), F.bround(c * (r / 10.0 + 1.0), 4).alias("predicted_close"), F.bround(r / 20.0, 6).alias("candidate_return"),
        (F.least(F.abs(r) * 5.0, F.lit(0.45)) + 0.5).alias("confidence"), F.col("nc").alias("actual_close"),
    )


define(
    "settledf", "forecasts",
    """
SELECT *, round_even(abs(predicted_close - actual_close), 4) AS abs_error, round_even(abs(predicted_close - actual_close) / actual_close * 100, 4) AS pct_error,
  round_even(predicted_return - (actual_close / last_close - 1), 6) AS return_error FROM forecasts WHERE actual_close IS NOT NULL AND target_date <= DATE '2001-10-31' AND nv > 0""",
)


def settled(m):
    return forecast.settle(forecasts(m), m.bars, F.lit("2001-10-31").cast("date"))


@query("fc_04_settled_forecasts", "exchange s, symbol s, target_date d, actual_close f, abs_error f, pct_error f, return_error f", "SELECT * FROM settledf", "settledf")
def _(m):
    return settled(m)




@query(
    "fc_05_global_bias", "return_bias f, days i",
    """
SELECT list_reduce(list_prepend(0.0::DOUBLE, list(return_error ORDER BY target_date, symbol || ':' || exchange)), lambda x, e: greatest(-0.01, least(0.01, 0.92 * x + 0.08 * e))) AS return_bias,
       count(DISTINCT target_date) AS days FROM settledf""",
    "settledf",
)
def _(m):
    return forecast.global_bias(settled(m))


@query(
    "fc_05_stock_bias", "exchange s, symbol s, return_bias f, settled_count i",
    """
SELECT exchange, symbol, list_reduce(list_prepend(0.0::DOUBLE, list(return_error ORDER BY target_date)), lambda x, e: greatest(-0.01, least(0.01, 0.88 * x + 0.12 * e))) AS return_bias,
       count(*) AS settled_count FROM settledf GROUP BY exchange, symbol""",
    "settledf",
)
def _(m):
    return forecast.stock_bias(settled(m))


@query(
    "fc_05_combined_bias", "exchange s, symbol s, return_bias f",
    """
SELECT s.exchange, s.symbol, CASE WHEN s.n >= 8 THEN s.b ELSE 0 END + g.b AS return_bias FROM (
  SELECT exchange, symbol, count(*) AS n, list_reduce(list_prepend(0.0::DOUBLE, list(return_error ORDER BY target_date)), lambda x, e: greatest(-0.01, least(0.01, 0.88 * x + 0.12 * e))) AS b FROM settledf GROUP BY exchange, symbol) s
SEMI JOIN liquid ON liquid.exchange = s.exchange AND liquid.symbol = s.symbol,
(SELECT list_reduce(list_prepend(0.0::DOUBLE, list(return_error ORDER BY target_date, symbol || ':' || exchange)), lambda x, e: greatest(-0.01, least(0.01, 0.92 * x + 0.08 * e))) AS b FROM settledf) g""",
    "settledf liquid",
)
def _(m):
    s = settled(m)
    state = forecast.global_bias(s).select("return_bias").scalar()
    return forecast.combined_bias(state, forecast.stock_bias(s), screen.liquid_universe(m.bars, F.lit("2001-06-30").cast("date")))


def _running(where):
    return f"""SELECT exchange, count(*) AS n, avg(abs(predicted_close - actual_close)) AS mae, avg(abs(predicted_close - actual_close) / actual_close * 100) AS mape,
  avg(CASE WHEN abs(actual_close / last_close - 1) > 1e-9 OR abs(predicted_return) > 1e-9 THEN CASE WHEN (predicted_return >= 0) = (actual_close / last_close - 1 >= 0) THEN 1.0 ELSE 0.0 END END) AS hit
  FROM settledf WHERE {where} GROUP BY exchange"""


@query(
    "fc_06_running_errors", "exchange s, settled_count i, mae f, mape f, direction_hit_rate f",
    f"""
SELECT b.exchange, b.n + p.n AS settled_count, (b.mae * b.n + p.mae * p.n) / (b.n + p.n) AS mae, (b.mape * b.n + p.mape * p.n) / (b.n + p.n) AS mape, (b.hit * b.n + p.hit * p.n) / (b.n + p.n) AS direction_hit_rate
FROM ({_running("target_date >= DATE '2001-01-01'")}) b JOIN ({_running("target_date < DATE '2001-01-01'")}) p USING (exchange)""",
    "settledf",
)
def _(m):
    s, cut = settled(m), F.lit("2001-01-01").cast("date")
    return forecast.merge_running(s.filter(F.col("target_date") >= cut), s.filter(F.col("target_date") < cut))


def _skill_sql(pred, limit):
    src = f"(SELECT * FROM settledf ORDER BY target_date DESC, exchange, symbol LIMIT {limit})" if limit else "settledf"
    return f"""
SELECT count(*) AS n, round_even(avg(me), 6) AS model_mae_return, round_even(avg(be), 6) AS baseline_mae_return, round_even(avg(abs(predicted_close - actual_close) / actual_close * 100), 4) AS model_mape,
  round_even(avg(abs(last_close - actual_close) / actual_close * 100), 4) AS baseline_mape, round_even(1 - avg(me) / avg(be), 4) AS skill_vs_naive,
  round_even(avg(CASE WHEN me < be - 1e-12 THEN 1.0 ELSE 0.0 END), 4) AS beats_naive_pct,
  round_even(avg(CASE WHEN be > 1e-9 OR abs(p) > 1e-9 THEN CASE WHEN (p >= 0) = (a >= 0) THEN 1.0 ELSE 0.0 END END), 4) AS direction_hit_rate
FROM (SELECT *, abs(p - a) AS me, abs(a) AS be FROM (SELECT *, actual_close / last_close - 1 AS a, {pred} AS p FROM {src}))"""


SKILL = "n i, model_mae_return f, baseline_mae_return f, model_mape f, baseline_mape f, skill_vs_naive f, beats_naive_pct f, direction_hit_rate f"


@query("fc_07_skill_vs_naive", SKILL, _skill_sql("predicted_return", None), "settledf")
def _(m):
    return forecast.skill(settled(m))


@query("fc_07_candidate_skill", SKILL, _skill_sql("candidate_return", None), "settledf")
def _(m):
    return forecast.skill(settled(m), prediction="candidate_return")


@query(
    "fc_08_live_gates", "downgrade_model b, serve_naive b",
    f"SELECT (SELECT skill_vs_naive <= 0 AND n >= 50 FROM ({_skill_sql('predicted_return', None)})) AS downgrade_model, (SELECT CASE WHEN n >= 50 THEN skill_vs_naive <= 0 END FROM ({_skill_sql('candidate_return', None)})) AS serve_naive",
    "settledf",
)
def _(m):
    s = settled(m)
    return forecast.live_gates(forecast.skill(s), forecast.skill(s, prediction="candidate_return"))


define(
    "replayed", "bars",
    """
SELECT exchange, symbol, dates[i] AS as_of, dates[i + 1] AS target_date, closes[i] AS last_close, closes[i + 1] AS actual_close, list_aggregate(fwd[1:i - 1], 'quantile_cont', 0.5) AS raw,
  row_number() OVER (PARTITION BY exchange, symbol ORDER BY i) AS no
FROM (SELECT *, unnest(range(40, n)) AS i FROM (
  SELECT *, list_transform(range(1, n), lambda j: closes[j + 1] / closes[j] - 1) AS fwd FROM (
    SELECT exchange, symbol, list(date ORDER BY date) AS dates, list(close ORDER BY date) AS closes, count(*) AS n FROM bars GROUP BY ALL) WHERE n >= 45))
WHERE dates[i + 1] >= DATE '2001-11-04' - 90""",
)
define(
    "replay_walk", "replayed",
    """
SELECT exchange, symbol, 0::BIGINT AS no, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS used FROM replayed WHERE no = 1
UNION ALL
SELECT r.exchange, r.symbol, r.no, greatest(-0.01, least(0.01, 0.88 * w.bias + 0.12 * (greatest(-0.12, least(0.12, r.raw - CASE WHEN w.no >= 8 THEN w.bias ELSE 0 END)) - (r.actual_close / r.last_close - 1)))),
       CASE WHEN w.no >= 8 THEN w.bias ELSE 0 END
FROM replay_walk w JOIN replayed r ON r.exchange = w.exchange AND r.symbol = w.symbol AND r.no = w.no + 1""",
)


@query(
    "fc_09_historical_replay", "exchange s, symbol s, as_of d, target_date d, raw f, used_bias f, predicted_return f, predicted_close f, actual_close f",
    """
SELECT r.*, w.used AS used_bias, greatest(-0.12, least(0.12, r.raw - w.used)) AS predicted_return, r.last_close * (1 + greatest(-0.12, least(0.12, r.raw - w.used))) AS predicted_close
FROM replayed r JOIN replay_walk w ON w.exchange = r.exchange AND w.symbol = r.symbol AND w.no = r.no""",
    "replayed replay_walk",
)
def _(m):
    return forecast.replay(m.bars, 90, F.lit("2001-11-04").cast("date"))


@query(
    "fc_10_learn_status", "settled_count i, pending_forecasts i, last_settled d, last_forecast d, mae f",
    "SELECT count(*) FILTER (actual_close IS NOT NULL) AS settled_count, count(*) FILTER (actual_close IS NULL) AS pending_forecasts, max(target_date) FILTER (actual_close IS NOT NULL) AS last_settled, max(as_of) AS last_forecast, round_even(avg(abs(predicted_close - actual_close)), 4) AS mae FROM forecasts",
    "forecasts",
)
def _(m):
    return forecast.learn_status(forecasts(m))


define(
    "shadow", "settledf",
    "SELECT *, 'shadow_analogue' AS candidate FROM settledf UNION ALL SELECT * REPLACE (last_close * (1 + candidate_return) AS predicted_close), 'shadow_regression' AS candidate FROM settledf",
)


def _shadow_report_sql(source):
    return f"""
SELECT candidate, n, mae, naive_mae, skill, direction, CASE WHEN n < 40 THEN NULL WHEN abs(d) < 0.03 THEN 'stable' WHEN d > 0 THEN 'improving' ELSE 'declining' END AS trend FROM (
SELECT candidate, count(*) AS n, round_even(avg(e), 4) AS mae, round_even(avg(b), 4) AS naive_mae, round_even(1 - avg(e) / avg(b), 4) AS skill,
  round_even(avg(CASE WHEN actual_close <> last_close THEN CASE WHEN sign(actual_close - last_close) = sign(predicted_close - last_close) THEN 1.0 ELSE 0.0 END END), 4) AS direction,
  (1 - avg(e) FILTER (recent) / avg(b) FILTER (recent)) - (1 - avg(e) FILTER (NOT recent) / avg(b) FILTER (NOT recent)) AS d
FROM (SELECT *, abs(predicted_close - actual_close) AS e, abs(last_close - actual_close) AS b,
  row_number() OVER (PARTITION BY candidate ORDER BY target_date DESC, exchange, symbol) <= floor(count(*) OVER (PARTITION BY candidate) / 2) AS recent FROM {source}) GROUP BY candidate)"""


@query(
    "fc_11_shadow_report", "candidate s, n i, mae f, naive_mae f, skill f, direction f, trend s",
    _shadow_report_sql("shadow"),
    "shadow",
)
def _(m):
    s = settled(m)
    other = s.withColumn("predicted_close", F.col("last_close") * (F.col("candidate_return") + 1.0)).withColumn("candidate", F.lit("shadow_regression"))
    return forecast.shadow_report(s.withColumn("candidate", F.lit("shadow_analogue")).unionByName(other))


# shadow cycles on five sessions in a row: each settles what is due and forecasts the next session
SHADOW_DAYS = [dt.date(2001, 9, 30), *[dt.date(2001, 10, d) for d in (1, 2, 3, 4)]]
_SHADOW_ENDS = [*SHADOW_DAYS[1:], dt.date(2001, 10, 7)]
define(
    "shadow_log", "bars stocks",
    f"""
SELECT 'shadow_analogue' AS candidate, g.exchange, g.symbol, g.as_of, g.target_date, g.last_close, round_even(c * (1 + corr), 4) AS predicted_close, round_even(corr, 6) AS predicted_return,
  b.close AS actual_close, CASE WHEN b.close IS NOT NULL THEN g.target_date END AS settled_on
FROM (SELECT *, round_even(c, 4) AS last_close, greatest(-0.12, least(0.12, CASE WHEN n >= 40 AND k >= 10 THEN med ELSE 0 END)) AS corr FROM (
  SELECT exchange, symbol, target AS target_date, max(date) AS as_of, arg_max(close, date) AS c, count(*) AS n, count(f) AS k, quantile_cont(f, 0.5) AS med FROM (
    SELECT exchange, symbol, date, close, target, lead(close) OVER (PARTITION BY target, exchange, symbol ORDER BY date) / close - 1 AS f
    FROM bars JOIN (SELECT unnest([{", ".join(f"DATE '{d}'" for d in SHADOW_DAYS)}]) AS day, unnest([{", ".join(f"DATE '{d}'" for d in _SHADOW_ENDS)}]) AS target) ON date <= day)
  GROUP BY exchange, symbol, target) WHERE n >= 40 AND c > 0) g
SEMI JOIN (SELECT exchange, symbol FROM stocks WHERE is_active) s ON s.exchange = g.exchange AND s.symbol = g.symbol
LEFT JOIN bars b ON b.exchange = g.exchange AND b.symbol = g.symbol AND b.date = g.target_date AND g.target_date <= DATE '{SHADOW_DAYS[-1]}'""",
)


def _shadow_cycles(m):
    path = work_folder(m.spark, "shadow")
    shadow.create(m.spark, path)
    cal = calendar.calendar(calendar.span_of(m.bars.select("date")), m.holidays)
    active = m.stocks.filter("is_active")
    for day in SHADOW_DAYS:
        shadow.run_cycle(m.spark, path, m.bars, active, cal, day, {shadow.ANALOGUE: shadow.analogue()})
    return path


@query(
    "fc_11_shadow_cycles", "candidate s, exchange s, symbol s, as_of d, target_date d, last_close f, predicted_close f, predicted_return f, actual_close f, settled_on d",
    "SELECT * FROM shadow_log", "shadow_log",
)
def _(m):
    return shadow.current(m.spark, _shadow_cycles(m))


@query(
    "fc_11_shadow_cycle_report", "candidate s, n i, mae f, naive_mae f, skill f, direction f, trend s",
    _shadow_report_sql("(SELECT * FROM shadow_log WHERE actual_close IS NOT NULL)"), "shadow_log",
)
def _(m):
    return shadow.report(m.spark, _shadow_cycles(m))


@query(
    "prj_10_pending_and_settled_forecast", "exchange s, symbol s, pending_target d, pending_close f, settled_target d, settled_predicted f, settled_actual f",
    """
SELECT exchange, symbol, max(target_date) FILTER (actual_close IS NULL) AS pending_target, arg_max(predicted_close, target_date) FILTER (actual_close IS NULL) AS pending_close,
  max(target_date) FILTER (actual_close IS NOT NULL) AS settled_target, arg_max(predicted_close, target_date) FILTER (actual_close IS NOT NULL) AS settled_predicted,
  arg_max(actual_close, target_date) FILTER (actual_close IS NOT NULL) AS settled_actual FROM forecasts GROUP BY exchange, symbol""",
    "forecasts",
)
def _(m):
    return forecast.pending_and_settled(forecasts(m))
