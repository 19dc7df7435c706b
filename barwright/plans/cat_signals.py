"""Patterns, score, analogue, screener and listing queries (survey 2.2, 2.4, 2.7, 2.8)."""

from functools import cached_property

from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.rolling import KEY, history
from barwright.operators import analogue, listing, patterns, scoring, screen
from barwright.operators import quality as dq
from barwright.operators.indicators import indicators, latest, refresh, snapshot
from barwright.plans.oracle import TABLES, W, define
from barwright.plans.registry import query
from barwright.session import cut_lineage
from barwright.sources.adapters import Market

K = "exchange s, symbol s, date d"

define(
    "indp",
    "ind",
    f"""
SELECT *, sma_20 AS bb_middle, sma_20 + 2 * bb_std AS bb_upper, sma_20 - 2 * bb_std AS bb_lower, volume / nullif(volume_sma_20, 0) AS vr,
  lag(sma_50) OVER {W} AS prev_sma_50, lag(sma_200) OVER {W} AS prev_sma_200, lag(macd) OVER {W} AS prev_macd, lag(macd_signal) OVER {W} AS prev_macd_signal,
  support <> 0 AND close <= support * 1.02 AS near_low, resistance <> 0 AND close >= resistance * 0.98 AS near_high
FROM ind""",
)


def _p(test, name, direction, strength):
    d = direction if direction.startswith("CASE") else f"'{direction}'"
    return f"CASE WHEN {test} THEN {{'name': '{name}', 'direction': {d}, 'strength': round_even(greatest(0.0, least(1.0, {strength})), 3)}} END"


_PATTERNS = ", ".join(
    [
        _p("prev_sma_50 <= prev_sma_200 AND sma_50 > sma_200", "Golden Cross", "bullish", "0.85"),
        _p("prev_sma_50 >= prev_sma_200 AND sma_50 < sma_200", "Death Cross", "bearish", "0.85"),
        _p("rsi_14 < 30", "RSI Oversold", "bullish", "(30 - rsi_14) / 30 + 0.5"),
        _p("rsi_14 > 70", "RSI Overbought", "bearish", "(rsi_14 - 70) / 30 + 0.5"),
        _p("prev_macd <= prev_macd_signal AND macd > macd_signal", "MACD Bullish Cross", "bullish", "0.7"),
        _p("prev_macd >= prev_macd_signal AND macd < macd_signal", "MACD Bearish Cross", "bearish", "0.7"),
        _p("close <= bb_lower", "BB Lower Touch", "bullish", "0.65"),
        _p("close >= bb_upper AND close > bb_lower", "BB Upper Touch", "bearish", "0.65"),
        _p("volume_sma_20 > 0 AND vr >= 2", "Volume Spike", "CASE WHEN close >= prev_close THEN 'bullish' ELSE 'bearish' END", "vr / 4"),
        _p("close > sma_20 AND sma_20 > sma_50", "Uptrend Stack", "bullish", "0.55"),
        _p("close < sma_20 AND sma_20 < sma_50", "Downtrend Stack", "bearish", "0.55"),
        _p("near_low AND (NOT near_high OR close - support <= resistance - close)", "Near Support", "bullish", "0.5"),
        _p("near_high AND (NOT near_low OR close - support > resistance - close)", "Near Resistance", "bearish", "0.5"),
    ]
)
define("pat", "indp", f"SELECT *, CASE WHEN n_rows >= 30 THEN list_filter([{_PATTERNS}], lambda x: x IS NOT NULL) ELSE [] END AS patterns FROM indp")
define(
    "patrows", "pat",
    "SELECT exchange, symbol, date, rn, n_rows, p.name AS name, p.direction AS direction, p.strength AS strength FROM (SELECT *, unnest(patterns) AS p FROM pat)",
)


def _pattern_query(name, names):
    listed = ", ".join(f"'{n}'" for n in names)

    @query(name, f"{K}, name s, direction s, strength f", f"SELECT * FROM patrows WHERE name IN ({listed})", "patrows")
    def _(m):
        rows = patterns.pattern_rows(patterns.with_patterns(indicators(m.bars)))
        return rows.filter(F.col("name").isin(names)).withColumnRenamed("as_of", "date")


_pattern_query("pat_01_golden_death_cross", ["Golden Cross", "Death Cross"])
_pattern_query("pat_02_rsi_extremes", ["RSI Oversold", "RSI Overbought"])
_pattern_query("pat_03_macd_cross", ["MACD Bullish Cross", "MACD Bearish Cross"])
_pattern_query("pat_04_bollinger_touch", ["BB Lower Touch", "BB Upper Touch"])
_pattern_query("pat_05_volume_spike", ["Volume Spike"])
_pattern_query("pat_06_trend_stack", ["Uptrend Stack", "Downtrend Stack"])
_pattern_query("pat_07_near_level", ["Near Support", "Near Resistance"])


@query(
    "pat_08_latest_pattern_table", "exchange s, symbol s, as_of d, name s, direction s, strength f",
    "SELECT *, date AS as_of FROM patrows WHERE rn = n_rows", "patrows",
)
def _(m):
    return patterns.pattern_rows(latest(patterns.with_patterns(indicators(m.bars))))


_R20 = "return_20d * 100"
define(
    "scored",
    "pat stocks",
    f"""
SELECT *, CASE WHEN pe_score >= 25 THEN 'BUY' WHEN pe_score <= -25 THEN 'SELL' WHEN abs(pe_score) >= 12 THEN 'WATCH' ELSE 'HOLD' END AS action,
  CASE WHEN board = 'Z' THEN 'high' WHEN volatility_20 IS NULL THEN 'medium' WHEN volatility_20 < 0.25 THEN 'low' WHEN volatility_20 > 0.45 THEN 'high' ELSE 'medium' END AS risk_level
FROM (SELECT *, greatest(-100, least(100, rule_score + CASE WHEN pe_ratio > 0 AND pe_ratio < 12 THEN 6 WHEN pe_ratio > 30 THEN -8 ELSE 0 END)) AS pe_score
FROM (SELECT *, greatest(-100, least(100,
    CASE WHEN rsi_14 < 35 THEN 18 WHEN rsi_14 > 65 THEN -18 WHEN rsi_14 IS NOT NULL THEN 4 ELSE 0 END
  + CASE WHEN macd_hist > 0 THEN 10 WHEN macd_hist IS NOT NULL THEN -8 ELSE 0 END
  + CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 15 WHEN close < sma_20 AND sma_20 < sma_50 THEN -15 ELSE 0 END
  + CASE WHEN {_R20} > 0 AND {_R20} < 12 THEN 8 WHEN {_R20} > 25 THEN -6 WHEN {_R20} < -15 THEN 5 ELSE 0 END
  + CASE WHEN volume_sma_20 > 0 AND vr > 1.5 AND return_5d > 0 THEN 8 ELSE 0 END
  + coalesce(list_sum(list_transform(patterns, lambda p: 12.0 * p.strength * CASE p.direction WHEN 'bullish' THEN 1 ELSE -1 END)), 0)
  + CASE board WHEN 'Z' THEN -25 WHEN 'A' THEN 5 ELSE 0 END)) AS rule_score
FROM pat LEFT JOIN (SELECT exchange, symbol, board, pe_ratio, sector FROM stocks) USING (exchange, symbol)))""",
)


@query("prd_01_rule_score", f"{K}, rule_score f", "SELECT * FROM scored", "scored")
def _(m):
    return scoring.scored_history(m.bars, m.stocks)


@query(
    "prd_02_pe_adjustment", f"{K}, pe_ratio f, rule_score f, score f", "SELECT *, pe_score AS score FROM scored WHERE rn = n_rows", "scored",
)
def _(m):
    return latest(scoring.scored_history(m.bars, m.stocks))


@query("prd_03_action", f"{K}, action s", "SELECT * FROM scored", "scored")
def _(m):
    return scoring.scored_history(m.bars, m.stocks)


@query("prd_04_risk_level", f"{K}, risk_level s", "SELECT * FROM scored", "scored")
def _(m):
    return scoring.scored_history(m.bars, m.stocks)


_NEXT40 = "OVER (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)"
define(
    "episodes",
    "indp",
    f"""
SELECT exchange, symbol, date, nullif(list_position(list_transform(path, lambda x: x >= close * 1.05), true), 0) AS maturity_days,
       list_position(path, list_max(path)) AS peak_days, (list_max(path) / close - 1) * 100 AS peak_ret, (list_min(path) / close - 1) * 100 AS trough_ret
FROM (SELECT *, list(close) {_NEXT40} AS path FROM indp)
WHERE n_rows >= 80 AND rn - 1 >= 40 AND rn - 1 < n_rows - 40 AND close > 0
  AND (coalesce(rsi_14 < 40, false) OR coalesce(prev_macd <= prev_macd_signal AND macd > macd_signal, false))""",
)
define(
    "study",
    "episodes",
    """
SELECT exchange, symbol, CAST(round_even(quantile_cont(maturity_days, 0.5), 0) AS BIGINT) AS maturity_days,
  CAST(round_even(quantile_cont(peak_days, 0.5), 0) AS BIGINT) AS peak_days, count(maturity_days) / count(*) AS hit_rate, avg(peak_ret) AS avg_return,
  count(*) AS samples, CASE WHEN count(*) >= 10 THEN quantile_cont(peak_ret, 0.25) END AS return_p25,
  CASE WHEN count(*) >= 10 THEN quantile_cont(peak_ret, 0.75) END AS return_p75, CASE WHEN count(*) >= 10 THEN avg(trough_ret) END AS downside_return
FROM episodes GROUP BY exchange, symbol""",
)


@query("prd_05_setup_episodes", f"{K}, maturity_days i, peak_days i, peak_ret f, trough_ret f", "SELECT * FROM episodes", "episodes")
def _(m):
    return analogue.setup_episodes(patterns.with_previous(indicators(m.bars)))


@query(
    "prd_05_setup_summary",
    "exchange s, symbol s, maturity_days i, peak_days i, hit_rate f, avg_return f, samples i, return_p25 f, return_p75 f, downside_return f",
    "SELECT * FROM study", "study",
)
def _(m):
    return analogue.setup_summary(analogue.setup_episodes(patterns.with_previous(indicators(m.bars))))


# every security asked at one recorded date and five distances ahead
define(
    "requests",
    "bars",
    """
SELECT exchange, symbol, last_date + d AS target_date
FROM (SELECT exchange, symbol, max(date) AS last_date FROM bars GROUP BY ALL), (SELECT unnest([-1, 0, 1, 5, 30, 120, 300]) AS d)""",
)


def requests(m):
    last = m.bars.groupBy(*KEY).agg(F.max("date").alias("last_date"))
    days = F.explode(F.array(*map(F.lit, [-1, 0, 1, 5, 30, 120, 300])))
    return last.select(*KEY, "last_date", days.alias("d")).select(*KEY, F.date_add("last_date", F.col("d")).alias("target_date"))


define(
    "dated",
    "requests bars",
    """
SELECT *, CASE WHEN n < 30 THEN 'insufficient' WHEN spot > 0 THEN 'actual' WHEN target_date < last_date THEN 'missing'
               WHEN steps > 180 THEN 'too_far' ELSE 'forecast' END AS mode, CASE WHEN spot > 0 THEN 0 ELSE steps END AS horizon
FROM (SELECT r.*, h.*, coalesce(list_position(dates, target_date), 0) AS spot,
  greatest(1, (SELECT count(*) FROM generate_series(CAST(last_date AS TIMESTAMP) + INTERVAL 1 DAY, CAST(target_date AS TIMESTAMP), INTERVAL 1 DAY) g(x) WHERE dayofweek(x) <= 4)) AS steps
FROM (SELECT exchange AS re, symbol AS rs, target_date FROM requests) r
JOIN (SELECT exchange, symbol, list(date ORDER BY date) AS dates, list(close ORDER BY date) AS closes, count(*) AS n, max(date) AS last_date FROM bars GROUP BY ALL) h
ON re = exchange AND rs = symbol)""",
)
define(
    "priced",
    "dated",
    """
SELECT *, list_aggregate(fwd, 'quantile_cont', 0.5) AS med, list_aggregate(fwd, 'quantile_cont', 0.25) AS p25, list_aggregate(fwd, 'quantile_cont', 0.75) AS p75,
       list_aggregate(fwd, 'quantile_cont', 0.1) AS p10, len(fwd) AS samples, closes[n] AS last_close
FROM (SELECT *, CASE WHEN mode = 'forecast' THEN list_transform(range(1, n - horizon + 1), lambda i: closes[i + horizon] / closes[i] - 1) END AS fwd FROM dated)""",
)
_TICK = "round_even(round_even(({0}) / 0.1, 0) * 0.1, 2)"


@query(
    "prd_06_price_at_date",
    "exchange s, symbol s, target_date d, mode s, horizon i, samples i, predicted_price f, price_low f, price_high f, price_downside f, expected_return_pct f, confidence f, confidence_label s",
    f"""
SELECT *, CASE WHEN confidence >= 0.8 THEN 'Very high' WHEN confidence >= 0.6 THEN 'High' WHEN confidence >= 0.4 THEN 'Moderate'
               WHEN confidence >= 0.2 THEN 'Low' WHEN confidence IS NOT NULL THEN 'Very low' END AS confidence_label
FROM (SELECT exchange, symbol, target_date, mode, horizon,
  CASE mode WHEN 'actual' THEN 1 WHEN 'forecast' THEN samples END AS samples,
  CASE mode WHEN 'actual' THEN round_even(closes[spot], 2) WHEN 'forecast' THEN {_TICK.format('last_close * (1 + med)')} END AS predicted_price,
  CASE mode WHEN 'actual' THEN round_even(closes[spot], 2) WHEN 'forecast' THEN {_TICK.format('last_close * (1 + p25)')} END AS price_low,
  CASE mode WHEN 'actual' THEN round_even(closes[spot], 2) WHEN 'forecast' THEN {_TICK.format('last_close * (1 + p75)')} END AS price_high,
  CASE WHEN mode = 'forecast' THEN {_TICK.format('last_close * (1 + p10)')} END AS price_downside,
  CASE mode WHEN 'forecast' THEN round_even(med * 100, 2) WHEN 'actual' THEN round_even((round_even(closes[spot], 2) / last_close - 1) * 100, 2) END AS expected_return_pct,
  CASE mode WHEN 'actual' THEN 0.99 WHEN 'forecast' THEN round_even(greatest(0.08, least(0.88, 0.22 + 0.55 * least(1, samples / 40) * exp(-horizon / 55)
     * greatest(0.35, least(1, 1 - 1.2 * abs(p75 - p25))))), 3) END AS confidence
FROM priced)""",
    "priced",
)
def _(m):
    return analogue.price_at_date(m.bars, requests(m))


@query("prd_07_trading_day_distance", "exchange s, symbol s, target_date d, steps i", "SELECT *, CASE WHEN target_date <= last_date THEN 0 ELSE (SELECT count(*) FROM generate_series(CAST(last_date AS TIMESTAMP) + INTERVAL 1 DAY, CAST(target_date AS TIMESTAMP), INTERVAL 1 DAY) g(x) WHERE dayofweek(x) <= 4) END AS steps FROM requests JOIN (SELECT exchange, symbol, max(date) AS last_date FROM bars GROUP BY ALL) USING (exchange, symbol)", "requests bars")
def _(m):
    last = m.bars.groupBy(*KEY).agg(F.max("date").alias("last_date"))
    return requests(m).join(last, KEY).withColumn("steps", analogue.trading_days(F.col("last_date"), F.col("target_date")))


_PARTS = """
CASE WHEN rsi_14 < 35 THEN format('RSI oversold ({:.0f})', rsi_14) WHEN rsi_14 > 65 THEN format('RSI elevated ({:.0f})', rsi_14) END,
CASE WHEN macd_hist > 0 THEN 'MACD histogram positive' WHEN macd_hist IS NOT NULL THEN 'MACD histogram negative' END,
CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'Short-term uptrend stack' WHEN close < sma_20 AND sma_20 < sma_50 THEN 'Short-term downtrend stack' END,
CASE WHEN return_20d * 100 > 0 AND return_20d * 100 < 12 THEN format('Healthy 20d momentum ({:.1f}%)', return_20d * 100)
     WHEN return_20d * 100 > 25 THEN 'Extended 20d rally — chase risk' WHEN return_20d * 100 < -15 THEN 'Deep 20d pullback — mean-reversion watch' END,
CASE WHEN volume_sma_20 > 0 AND vr > 1.5 AND return_5d > 0 THEN 'Rising price on above-average volume' END"""
define(
    "analysis",
    "scored study",
    f"""
SELECT *, action = 'BUY' AND risk_level <> 'high' AND board <> 'Z' AND pe_score >= 28 AND conf >= 0.4 AND (hit_rate IS NULL OR hit_rate >= 0.35) AS is_safe_buy,
  round_even(pe_score, 2) AS score, round_even(conf, 3) AS confidence, round_even(avg_return, 2) AS expected_return_pct, round_even(hit_rate, 3) AS probability,
  CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') ELSE 'Neutral posture.' END AS rationale
FROM (SELECT *, date AS as_of, CASE WHEN hit_rate IS NULL THEN base ELSE least(0.95, (base + hit_rate) / 2 + 0.15) END AS conf,
  list_concat(list_filter(list_concat(list_filter([{_PARTS}], lambda x: x IS NOT NULL),
      list_transform(list_filter(patterns, lambda p: p.strength * 12 >= 6), lambda p: p.name),
      list_filter([CASE WHEN board = 'Z' THEN 'Z-group risk penalty' END,
                   CASE WHEN pe_ratio > 0 AND pe_ratio < 12 THEN format('Attractive P/E ({{:.1f}})', pe_ratio) WHEN pe_ratio > 30 THEN format('Elevated P/E ({{:.1f}})', pe_ratio) END], lambda x: x IS NOT NULL)),
      lambda x: x IS NOT NULL)[1:6],
    list_filter([CASE WHEN maturity_days > 0 THEN format('Historically, similar setups matured (~+5%) in ~{{:d}} days (hit rate {{:.0f}}% over {{:d}} samples).', maturity_days, hit_rate * 100, samples) END,
      CASE WHEN peak_days > 0 THEN format('Median days to local peak after setup: ~{{:d}}.', peak_days) END,
      CASE WHEN return_p25 IS NOT NULL THEN format('Peak-return range across those episodes: {{:.1f}}% to {{:.1f}}% (typical downside within the same window: {{:.1f}}%).', return_p25, return_p75, downside_return) END],
      lambda x: x IS NOT NULL)) AS parts
FROM (SELECT s.*, t.* EXCLUDE (exchange, symbol), least(0.92, 0.35 + abs(pe_score) / 150 + CASE WHEN samples > 10 THEN 0.15 ELSE 0 END) AS base
      FROM (SELECT * FROM scored WHERE rn = n_rows) s LEFT JOIN study t ON t.exchange = s.exchange AND t.symbol = s.symbol))""",
)
ANALYSIS = (
    "exchange s, symbol s, as_of d, action s, score f, confidence f, risk_level s, is_safe_buy b, maturity_days i, peak_days i, "
    "expected_return_pct f, probability f, rationale s, samples i"
)


@query("prd_08_confidence_band", "exchange s, symbol s, confidence f, band s", "SELECT *, CASE WHEN confidence >= 0.8 THEN 'Very high' WHEN confidence >= 0.6 THEN 'High' WHEN confidence >= 0.4 THEN 'Moderate' WHEN confidence >= 0.2 THEN 'Low' ELSE 'Very low' END AS band FROM analysis", "analysis")
def _(m):
    from barwright.functions.expr import confidence_label

    return scoring.analysis(m.bars, m.stocks).withColumn("band", confidence_label(F.col("confidence")))


def _analysis(m):
    return scoring.analysis(m.bars, m.stocks).withColumnsRenamed({"maturity_days_est": "maturity_days", "peak_days_est": "peak_days"})


@query("prd_09_stock_analysis", ANALYSIS, "SELECT * REPLACE (coalesce(samples, 0) AS samples) FROM analysis", "analysis")
def _(m):
    return _analysis(m)


# a stand-in model probability: logistic of the latest 5-session return
@query(
    "prd_10_blended_score", "exchange s, symbol s, action s, score f, is_safe_buy b, ml_score f",
    """
SELECT exchange, symbol, ml_score, round_even(mixed, 2) AS score,
  CASE WHEN mixed >= 25 THEN 'BUY' WHEN mixed <= -25 THEN 'SELL' WHEN abs(mixed) >= 12 THEN 'WATCH' ELSE 'HOLD' END AS action,
  is_safe_buy AND mixed >= 25 AND round_even(mixed, 2) >= 28 AND confidence >= 0.4 AS is_safe_buy
FROM (SELECT *, greatest(-100, least(100, 0.7 * score + (p - 0.5) * 60)) AS mixed, round_even(p * 100, 2) AS ml_score
      FROM (SELECT *, 1 / (1 + exp(-40 * return_5d)) AS p FROM analysis))""",
    "analysis",
)
def _(m):
    p = snapshot_probability(m)
    return scoring.with_model_score(scoring.analysis(m.bars, m.stocks), p)


def snapshot_probability(m):
    r = latest(indicators(m.bars))
    return r.select(*KEY, (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("return_5d") * -40.0))).alias("ml_probability"))


@query(
    "prd_11_full_universe_analysis",
    "exchange s, symbol s, as_of d, action s, score f, pattern_count i, rsi_14 f, macd_hist f, sma_20 f, sma_50 f, volatility_20 f, return_20d f",
    "SELECT *, len(patterns) AS pattern_count FROM analysis", "analysis",
)
def _(m):
    return scoring.analysis(m.bars, m.stocks)


@query(
    "prd_12_technicals_refresh", "exchange s, symbol s, as_of d, rsi_14 f, macd f, sma_20 f",
    "SELECT *, date AS as_of FROM ind WHERE rn = n_rows AND date >= (SELECT max(date) - 3 FROM bars)", "ind bars",
)
def _(m):
    newest = m.bars.select(F.max("date")).scalar()
    changed = m.bars.filter(F.col("date") >= F.date_sub(newest, 3))
    return refresh(m.bars, changed)


# ------------------------------------------------------------------ screener
# as_of is moved to the month end so that securities share an analysis date
define("screened", "analysis", "SELECT * REPLACE (last_day(as_of) AS as_of) FROM analysis")
define("newest", "screened", "SELECT * FROM screened WHERE as_of = (SELECT max(as_of) FROM screened)")


def screened(m):
    """The analysis table as a screen reads it: computed once, then stored."""
    return cut_lineage(scoring.analysis(m.bars, m.stocks).withColumn("as_of", F.last_day("as_of")).drop("patterns"))


TOP = "exchange s, symbol s, as_of d, score f, confidence f"


@query("top_01_potential_shares", TOP, "SELECT * FROM newest WHERE score >= 25 ORDER BY score DESC, confidence DESC, exchange, symbol LIMIT 20", "newest")
def _(m):
    return screen.potential_shares(screened(m))


@query("top_02_safe_buys", TOP, "SELECT * FROM newest WHERE is_safe_buy AND action = 'BUY' ORDER BY score DESC, exchange, symbol LIMIT 10", "newest")
def _(m):
    return screen.safe_buys(screened(m))


def swinging(m, share: float, days: float, fold: int | None = None):
    """The market with prices that swing by a share over days, out of step by security; with `fold`, suppliers share that many securities."""

    class Swinging(Market):
        def table(self, name):
            df = super().table(name)
            return df.withColumn("l_suppkey", F.col("l_suppkey") % fold + 1) if name == "lineitem" and fold else df

        @cached_property
        def bars(self):
            phase = F.date_diff("date", F.lit("1995-01-01").cast("date")) / days + F.substring("symbol", 2, 20).cast("long")
            return self.bars_all.filter(~F.col("is_synthetic")).withColumns({c: F.col(c) * (F.sin(phase) * share + 1.0) for c in ("open", "high", "low", "close")})

    return Swinging(m.spark, m.folder)


def swinging_sql(share: float, days: float, fold: int | None = None) -> dict[str, tuple[str, str]]:
    needs, text = TABLES["bars_all"]
    return {
        "bars_all": (needs, text.replace("l_suppkey AS k", f"l_suppkey % {fold} + 1 AS k") if fold else text),
        "bars": ("bars_all", f"""
SELECT * REPLACE (open * f AS open, high * f AS high, low * f AS low, close * f AS close)
FROM (SELECT *, 1.0 + {share} * sin((date - DATE '1995-01-01') / CAST({days} AS DOUBLE) + CAST(symbol[2:] AS BIGINT)) AS f FROM bars_all WHERE NOT is_synthetic)"""),
    }


@query(
    "top_02_safe_buys_in_swings", f"{TOP}, action s, is_safe_buy b", "SELECT * FROM newest WHERE is_safe_buy AND action = 'BUY' ORDER BY score DESC, exchange, symbol LIMIT 10", "newest",
    swinging_sql(0.1, 60.0),
)
def _(m):
    return screen.safe_buys(screened(swinging(m, 0.1, 60.0)))


@query("top_03_sell_candidates", TOP, "SELECT * FROM newest WHERE action = 'SELL' ORDER BY score, exchange, symbol LIMIT 10", "newest")
def _(m):
    return screen.sell_candidates(screened(m))


@query(
    "top_04_best_per_sector", "sector s, place i, exchange s, symbol s, score f",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, exchange, symbol) AS place
FROM (SELECT * REPLACE (CASE WHEN coalesce(sector, '') = '' THEN 'Other' ELSE sector END AS sector) FROM newest WHERE score >= 20)) WHERE place <= 3""",
    "newest",
)
def _(m):
    return screen.best_per_sector(screened(m))


_LINE = "format('{} ({}) score={:.0f}', symbol, exchange, score)"


@query(
    "top_06_daily_digest", "section s, exchange s, symbol s, line s",
    f"""
(SELECT 'potential' AS section, exchange, symbol, {_LINE} AS line FROM newest WHERE score >= 25 ORDER BY score DESC, confidence DESC, exchange, symbol LIMIT 8)
UNION ALL (SELECT 'safe', exchange, symbol, rationale[1:120] FROM newest WHERE is_safe_buy AND action = 'BUY' ORDER BY score DESC, exchange, symbol LIMIT 5)
UNION ALL (SELECT 'sell', exchange, symbol, {_LINE} FROM newest WHERE action = 'SELL' ORDER BY score, exchange, symbol LIMIT 5)""",
    "newest",
)
def _(m):
    return screen.digest(screened(m))


# a user's watchlist: the securities of the line items of their orders
define("watchlist", "", "SELECT DISTINCT o_custkey AS user_id, CASE WHEN l_suppkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange, 'S' || l_suppkey AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def watchlist(m):
    o = m.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    li = m.table("lineitem").select("l_orderkey", "l_suppkey")
    k = F.col("l_suppkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        "user_id", F.when(k % 2 == 0, "DSE").otherwise("CSE").alias("exchange"), F.concat(F.lit("S"), k.cast("string")).alias("symbol")
    ).distinct()


@query(
    "top_06_watchlist_brief", "user_id i, exchange s, symbol s, action s, line s",
    """
SELECT user_id, exchange, symbol, coalesce(action, 'UNAVAILABLE') AS action,
  CASE WHEN action IS NULL THEN 'analysis is not available yet.'
       ELSE format('{} (score {:.0f}, confidence {:.0f}%) - ', action, score, confidence * 100) || rationale[1:180] END AS line
FROM watchlist LEFT JOIN analysis USING (exchange, symbol)""",
    "watchlist analysis",
)
def _(m):
    return screen.watchlist_brief(watchlist(m), scoring.analysis(m.bars, m.stocks))


@query(
    "agg_20_watchlist_actions", "user_id i, action s, stocks i",
    "SELECT user_id, coalesce(action, 'UNAVAILABLE') AS action, count(*) AS stocks FROM watchlist LEFT JOIN analysis USING (exchange, symbol) GROUP BY 1, 2",
    "watchlist analysis",
)
def _(m):
    return screen.watchlist_counts(screen.watchlist_brief(watchlist(m), scoring.analysis(m.bars, m.stocks)))


@query(
    "agg_05_screen_summary", "as_of d, total i, buy i, hold i, sell i, watch i, research_candidates i",
    "SELECT as_of, count(*) AS total, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a.lower()}" for a in fixed.ACTIONS)
    + ", count(*) FILTER (is_safe_buy) AS research_candidates FROM newest GROUP BY as_of",
    "newest",
)
def _(m):
    return screen.summary(screened(m))


define(
    "snapshots", "bars",
    f"""
SELECT exchange, date AS as_of, count(*) FILTER (c > 0) AS advancers, count(*) FILTER (c < 0) AS decliners, count(*) FILTER (c = 0) AS unchanged
FROM (SELECT exchange, date, (close / lag(close) OVER {W} - 1) * 100 AS c FROM bars) WHERE c IS NOT NULL GROUP BY exchange, date""",
)


def snapshots(m):
    from barwright.functions.rolling import change

    ch = m.bars.select("exchange", F.col("date").alias("as_of"), (change(F.col("close"), history()) * 100.0).alias("change_pct"))
    return screen.market_snapshot(ch)


@query("agg_07_market_snapshot", "exchange s, as_of d, advancers i, decliners i, unchanged i", "SELECT * FROM snapshots", "snapshots")
def _(m):
    return snapshots(m)


@query(
    "agg_06_sentiment_gauge", "exchange s, as_of d, score f, label s, needle_deg f",
    """
SELECT *, round_even(score * 0.9, 2) AS needle_deg, CASE WHEN score < -60 THEN 'Extremely Bearish' WHEN score < -30 THEN 'Bearish' WHEN score < -10 THEN 'Slightly Bearish'
  WHEN score < 10 THEN 'Neutral' WHEN score < 30 THEN 'Slightly Bullish' WHEN score < 60 THEN 'Bullish' ELSE 'Extremely Bullish' END AS label
FROM (SELECT *, round_even((advancers - decliners) * 100.0::DOUBLE / (advancers + decliners + unchanged), 1) AS score FROM snapshots)""",
    "snapshots",
)
def _(m):
    return screen.sentiment(snapshots(m))


@query(
    "agg_08_sector_heatmap", "sector s, stocks i, buy i, sell i, avg_score f, avg_change f, heat i",
    """
SELECT *, greatest(0, least(100, round_even((avg_score + 100) / 2, 0))) AS heat FROM (
SELECT CASE WHEN coalesce(q.sector, '') = '' THEN 'Unclassified' ELSE q.sector END AS sector, count(*) AS stocks, count(*) FILTER (action = 'BUY') AS buy,
  count(*) FILTER (action = 'SELL') AS sell, round_even(avg(CAST(score AS DECIMAL(10,2))), 1) AS avg_score, round_even(avg(last_change_pct), 2) AS avg_change
FROM analysis a JOIN quoted q ON q.exchange = a.exchange AND q.symbol = a.symbol AND q.is_active GROUP BY 1)""",
    "analysis quoted",
)
def _(m):
    return screen.sector_heatmap(scoring.analysis(m.bars, m.stocks), m.quoted)


@query("agg_09_sector_pe", "sector s, sector_pe f", "SELECT sector, round_even(avg(pe_ratio), 2) AS sector_pe FROM stocks WHERE pe_ratio > 0 GROUP BY sector", "stocks")
def _(m):
    return screen.sector_pe(m.stocks)


@query(
    "agg_10_liquid_universe", "exchange s, symbol s, avg_volume f",
    """
SELECT exchange, symbol, avg(volume) AS avg_volume FROM bars WHERE date BETWEEN DATE '2001-06-30' - 45 AND DATE '2001-06-30'
GROUP BY ALL ORDER BY avg_volume DESC, exchange, symbol LIMIT 80""",
    "bars",
)
def _(m):
    return screen.liquid_universe(m.bars, F.lit("2001-06-30").cast("date"))


define(
    "cleanbars", "bars",
    "SELECT *, CAST([] AS VARCHAR[]) AS quality_flags FROM bars",
)


@query(
    "agg_11_traded_value_universe", "exchange s, symbol s, clean_rows i, avg_traded_value f",
    """
SELECT exchange, symbol, count(*) AS clean_rows, avg(greatest(coalesce(value, 0), coalesce(close * volume, 0))) AS avg_traded_value
FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY date DESC) AS r FROM bars WHERE date <= DATE '2001-06-30' AND source <> 'unknown')
SEMI JOIN (SELECT exchange, symbol FROM stocks WHERE is_active AND board <> 'Z') USING (exchange, symbol)
WHERE r <= 60 GROUP BY ALL HAVING count(*) >= 40 AND avg(greatest(coalesce(value, 0), coalesce(close * volume, 0))) >= 30000
ORDER BY avg_traded_value DESC, exchange, symbol LIMIT 40""",
    "bars stocks",
)
def _(m):
    return screen.traded_value_universe(dq.with_bar_flags(m.bars), m.stocks, F.lit("2001-06-30").cast("date"), 30000.0)


@query(
    "agg_18_prediction_volume", "as_of d, rows_written i",
    "SELECT as_of, count(*) AS rows_written FROM analysis GROUP BY as_of ORDER BY as_of DESC LIMIT 7", "analysis",
)
def _(m):
    return screen.prediction_volume(scoring.analysis(m.bars, m.stocks))


# ------------------------------------------------------------------ listings


@query(
    "prj_01_stock_search", "exchange s, symbol s, company_name s",
    "SELECT * FROM stocks WHERE is_active AND exchange = 'DSE' AND (symbol ILIKE '%s1%' OR company_name ILIKE '%s1%' OR symbol ILIKE '%4%' AND false)", "stocks",
)
def _(m):
    return listing.stock_search(m.stocks, "s1", "DSE")


@query(
    "prj_02_latest_analysis", "exchange s, symbol s, as_of d, score f, action s, rsi_14 f",
    "SELECT exchange, symbol, max(date) AS as_of, arg_max(pe_score, date) AS score, arg_max(action, date) AS action, arg_max(rsi_14, date) AS rsi_14 FROM scored GROUP BY ALL",
    "scored",
)
def _(m):
    rows = scoring.scored_history(m.bars, m.stocks).select(*KEY, F.col("date").alias("as_of"), "score", "action", "rsi_14")
    return listing.latest_by(rows, KEY, "as_of")


@query(
    "prj_03_compare_stocks", "exchange s, symbol s, action s, score f, rsi_14 f, macd f, sma_200 f",
    "SELECT s.exchange, s.symbol, a.action, a.score, t.rsi_14, t.macd, t.sma_200 FROM stocks s LEFT JOIN analysis a USING (exchange, symbol) LEFT JOIN snap t USING (exchange, symbol) WHERE s.is_active AND s.symbol IN ('S1', 'S2', 'S8', 'S10')",
    "stocks analysis snap",
)
def _(m):
    chosen = m.stocks.filter(F.col("is_active") & F.col("symbol").isin("S1", "S2", "S8", "S10")).select(*KEY)
    # the filter reaches the bars, so only the chosen histories are computed
    bars = m.bars.join(chosen, KEY, "left_semi")
    a = scoring.analysis(bars, m.stocks).select(*KEY, "action", "score")
    t = snapshot(bars).select(*KEY, "rsi_14", "macd", "sma_200")
    return chosen.join(a, KEY, "left").join(t, KEY, "left")


@query(
    "prj_04_analysis_list", "exchange s, symbol s, as_of d, action s, score f",
    "SELECT *, date AS as_of, pe_score AS score FROM scored WHERE exchange = 'DSE' AND action = 'BUY' ORDER BY date DESC, round(pe_score, 6) DESC, symbol LIMIT 25 OFFSET 25", "scored",
)
def _(m):
    rows = scoring.scored_history(m.bars, m.stocks).withColumn("as_of", F.col("date"))
    rows = rows.filter((F.col("exchange") == "DSE") & (F.col("action") == "BUY"))
    return listing.page(rows, [F.desc("as_of"), F.desc(F.round("score", 6)), F.asc("symbol")], 25, 2)


@query(
    "prj_05_transaction_page", "portfolio_id i, exchange s, symbol s, txn_id i, side s, txn_date d",
    "SELECT * FROM ledger WHERE portfolio_id = 7 AND exchange = 'DSE' AND symbol LIKE '%1%' AND side = 'BUY' ORDER BY txn_date DESC, txn_id DESC LIMIT 25", "ledger",
)
def _(m):
    f = (F.col("portfolio_id") == 7) & (F.col("exchange") == "DSE") & F.contains("symbol", F.lit("1")) & (F.col("side") == "BUY")
    return listing.page(m.ledger.filter(f), [F.desc("txn_date"), F.desc("txn_id")])


define(
    "notices", "",
    """
SELECT 'Company ' || o_custkey || ' - ' || CASE o_orderstatus WHEN 'O' THEN 'AGM' WHEN 'P' THEN 'EGM' ELSE 'Record date' END || ' ' || o_orderkey AS title,
       CAST(o_orderdate AS DATE) AS event_date, o_orderkey % 3 <> 0 AS is_public FROM orders""",
)


@query(
    "prj_06_upcoming_events", "title s, event_date d",
    "SELECT * FROM notices WHERE is_public AND event_date >= DATE '1999-01-01' ORDER BY event_date DESC, title LIMIT 100", "notices",
)
def _(m):
    kind = F.when(F.col("o_orderstatus") == "O", "AGM").when(F.col("o_orderstatus") == "P", "EGM").otherwise("Record date")
    events = m.table("orders").select(
        F.concat(F.lit("Company "), F.col("o_custkey").cast("string"), F.lit(" - "), kind, F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"),
        F.to_date("o_orderdate").alias("event_date"), (F.col("o_orderkey") % 3 != 0).alias("is_public"),
    )
    return listing.upcoming_events(events, F.lit("1999-01-01").cast("date"))


@query(
    "prj_07_latest_snapshot", "exchange s, as_of d, advancers i, decliners i",
    "SELECT exchange, max(as_of) AS as_of, arg_max(advancers, as_of) AS advancers, arg_max(decliners, as_of) AS decliners FROM snapshots GROUP BY exchange", "snapshots",
)
def _(m):
    return listing.latest_by(snapshots(m), ["exchange"], "as_of")


def runs(m):
    """Study runs and assessments: orders stand in for the append-only tables."""
    k = F.col("o_custkey")
    return m.table("orders").select(
        F.col("o_orderpriority").alias("strategy"), F.when(k % 2 == 0, "DSE").otherwise("CSE").alias("exchange"),
        F.concat(F.lit("run "), (k % 7).cast("string")).alias("name"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("result"),
    )


define(
    "runs", "",
    "SELECT o_orderpriority AS strategy, CASE WHEN o_custkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange, 'run ' || (o_custkey % 7) AS name, o_orderdate AS created_at, o_orderkey AS run_id, o_totalprice AS result FROM orders",
)
_LATEST_RUN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, exchange, name ORDER BY created_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1"


@query(
    "prj_08_latest_runs", "strategy s, exchange s, name s, created_at t, run_id i, result f",
    f"SELECT * FROM ({_LATEST_RUN}) ORDER BY created_at DESC, run_id DESC LIMIT 20", "runs",
)
def _(m):
    now = listing.latest_by(runs(m), ["strategy", "exchange", "name"], "created_at", "run_id")
    return now.orderBy(F.desc("created_at"), F.desc("run_id")).limit(20)


@query("prj_09_latest_assessments", "strategy s, exchange s, name s, created_at t, run_id i, result f", _LATEST_RUN, "runs")
def _(m):
    return listing.latest_by(runs(m), ["strategy", "exchange", "name"], "created_at", "run_id")


@query(
    "prj_09_assessment_history", "run_id i, created_at t, result f",
    "SELECT * FROM runs WHERE strategy = '2-HIGH' AND exchange = 'DSE' AND name = 'run 3' ORDER BY created_at DESC, run_id DESC LIMIT 20", "runs",
)
def _(m):
    f = (F.col("strategy") == "2-HIGH") & (F.col("exchange") == "DSE") & (F.col("name") == "run 3")
    return listing.page(runs(m).filter(f), [F.desc("created_at"), F.desc("run_id")], 20)


@query(
    "prj_11_ticker", "exchange s, place i, symbol s, last_price f, last_change_pct f",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY last_volume DESC, symbol) AS place FROM quoted WHERE is_active AND last_price IS NOT NULL) WHERE place <= 70",
    "quoted",
)
def _(m):
    return listing.ticker(m.quoted, 70)


@query("prj_12_enabled_exchange_gate", "exchange s, symbol s, sector s", "SELECT * FROM stocks WHERE exchange IN ('DSE')", "stocks")
def _(m):
    return listing.enabled(m.stocks, ["DSE"])


@query(
    "prj_13_expected_peak_price", "exchange s, symbol s, last_price f, expected_return_pct f, peak_price f",
    "SELECT a.exchange, a.symbol, q.last_price, a.expected_return_pct, round_even(q.last_price * (1 + a.expected_return_pct / 100), 2) AS peak_price FROM analysis a JOIN quoted q ON q.exchange = a.exchange AND q.symbol = a.symbol",
    "analysis quoted",
)
def _(m):
    return screen.expected_change(scoring.analysis(m.bars, m.stocks), m.quoted)


@query("prj_14_tick_rounding", f"{K}, tick f", f"SELECT *, {_TICK.format('close')} AS tick FROM bars", "bars")
def _(m):
    from barwright.functions.expr import tick_price

    return m.bars.withColumn("tick", tick_price(F.col("close")))


define(
    "hist",
    "bars holidays",
    """
SELECT s.exchange, s.symbol, s.date, b.open, b.high, b.low, b.close, b.volume,
       CASE WHEN b.close IS NULL THEN CASE WHEN dayofweek(s.date) IN (5, 6) THEN 'Weekend' ELSE h.name END END AS closed_reason
FROM (SELECT exchange, symbol, CAST(unnest(generate_series(CAST(max(date) - {days} AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM bars GROUP BY exchange, symbol) s
LEFT JOIN bars b ON b.exchange = s.exchange AND b.symbol = s.symbol AND b.date = s.date
LEFT JOIN holidays h ON h.date = s.date""".replace("{days}", "364"),
)


@query(
    "prj_15_price_history_table", f"{K}, open f, close f, volume i, closed_reason s, change f, change_pct f",
    f"""
SELECT *, CASE WHEN prev > 0 THEN round_even(close - prev, 2) END AS change, CASE WHEN prev > 0 THEN round_even((close / prev - 1) * 100, 2) END AS change_pct
FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM hist WHERE close IS NOT NULL OR closed_reason IS NOT NULL)""",
    "hist",
)
def _(m):
    return listing.history_table(m.bars, m.holidays, "1y")


@query(
    "prj_16_chart_series", f"{K}, open f, high f, low f, close f, volume i",
    "SELECT exchange, symbol, date, volume, round_even(open, 2) AS open, round_even(high, 2) AS high, round_even(low, 2) AS low, round_even(close, 2) AS close FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY date DESC) AS r FROM bars) WHERE r <= 280",
    "bars",
)
def _(m):
    return listing.chart_series(m.bars)


@query(
    "prj_17_ticket_diagnostics", "reference s, exchange s, symbol s, analysis_date d, data_source s, price_date d, prediction_reference s",
    """
SELECT t.reference, t.exchange, t.symbol, a.as_of AS analysis_date, b.source AS data_source, b.date AS price_date,
       a.exchange || ':' || a.symbol || ':' || a.as_of AS prediction_reference
FROM tickets t LEFT JOIN stocks s ON s.exchange = t.exchange AND s.symbol = t.symbol
LEFT JOIN (SELECT exchange, symbol, max(date) AS as_of FROM bars GROUP BY ALL) a ON a.exchange = s.exchange AND a.symbol = s.symbol
LEFT JOIN (SELECT exchange, symbol, max(date) AS date, arg_max(source, date) AS source FROM bars_all GROUP BY ALL) b ON b.exchange = s.exchange AND b.symbol = s.symbol
WHERE category IN ('prediction_issue', 'data_issue')""",
    "tickets stocks bars bars_all",
)
def _(m):
    analysed = m.bars.groupBy(*KEY).agg(F.max("date").alias("as_of"))
    last_bar = m.bars_all.groupBy(*KEY).agg(F.max("date").alias("date"), F.max_by("source", "date").alias("source"))
    return listing.ticket_diagnostics(m.tickets, m.stocks, analysed, last_bar)
