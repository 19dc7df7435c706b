"""Window, context, feature and quality queries (survey 2.4, 2.5, 2.6)."""

from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.rolling import history, mean
from barwright.operators import context as ctx
from barwright.operators import features as feat
from barwright.operators import indicators as ind
from barwright.operators import quality as dq
from barwright.plans.oracle import W, define, define_indicators, over, rolling_mean
from barwright.plans.registry import query

K = "exchange s, symbol s, date d"
ALL = "SELECT * FROM {}"

# ---------------------------------------------------------------- windows


@query("win_01_simple_moving_average", f"{K}, sma_20 f, sma_50 f, sma_200 f, volume_sma_20 f", "SELECT * FROM ind", "ind")
def _(m):
    w = history()
    c = F.col("close")
    return m.bars.select(
        "exchange", "symbol", "date", mean(c, w, 20).alias("sma_20"), mean(c, w, 50).alias("sma_50"),
        mean(c, w, 200).alias("sma_200"), mean(F.col("volume").cast("double"), w, 20).alias("volume_sma_20"),
    )


@query("win_02_exponential_average", f"{K}, ema_12 f, ema_26 f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


@query("win_03_relative_strength_index", f"{K}, rsi_14 f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


@query("win_04_macd", f"{K}, macd f, macd_signal f, macd_hist f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


@query(
    "win_05_bollinger", f"{K}, bb_upper f, bb_middle f, bb_lower f",
    "SELECT *, sma_20 AS bb_middle, sma_20 + 2 * bb_std AS bb_upper, sma_20 - 2 * bb_std AS bb_lower FROM ind", "ind",
)
def _(m):
    return ind.indicators(m.bars)


@query("win_06_average_true_range", f"{K}, atr_14 f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


@query("win_07_support_resistance", f"{K}, support f, resistance f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


@query("win_08_session_returns", f"{K}, return_1d f, return_2d f, return_3d f, return_5d f, return_20d f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


@query("win_09_annualised_volatility", f"{K}, volatility_20 f", "SELECT * FROM ind", "ind")
def _(m):
    return ind.indicators(m.bars)


_F252 = over(252)
define(
    "regime",
    "ind",
    f"""
SELECT *, CASE WHEN q33 IS NULL THEN NULL WHEN volatility_20 <= q33 THEN 0.0 WHEN volatility_20 <= q67 THEN 1.0 ELSE 2.0 END AS vol_regime
FROM (SELECT *, CASE WHEN count(volatility_20) {_F252} >= 60 THEN quantile_cont(volatility_20, 0.33) {_F252} END AS q33,
             CASE WHEN count(volatility_20) {_F252} >= 60 THEN quantile_cont(volatility_20, 0.67) {_F252} END AS q67 FROM ind)""",
)


@query("win_10_volatility_regime", f"{K}, vol_regime f", "SELECT * FROM regime", "regime")
def _(m):
    return ind.volatility_regime(ind.indicators(m.bars))


define(
    "snap",
    "ind",
    """
SELECT *, date AS as_of, sma_20 AS bb_middle, sma_20 + 2 * bb_std AS bb_upper, sma_20 - 2 * bb_std AS bb_lower
FROM ind WHERE rn = n_rows AND n_rows >= 5""",
)
SNAP_COLS = "exchange s, symbol s, as_of d, close f, " + ", ".join(f"{c} f" for c in ind.SNAPSHOT)


@query("win_11_latest_indicator_row", SNAP_COLS, "SELECT * FROM snap", "snap")
def _(m):
    return ind.snapshot(m.bars)


define(
    "tech",
    "regime",
    f"""
SELECT *, volume / nullif(volume_sma_20, 0) AS volume_ratio, close / nullif(sma_20, 0) - 1 AS dist_sma20, close / nullif(sma_50, 0) - 1 AS dist_sma50,
  close / nullif(open, 0) - 1 AS intraday_return, open / nullif(prev_close, 0) - 1 AS overnight_gap,
  (high - low) / nullif(atr_14, 0) AS range_atr, (close - low) / nullif(high - low, 0) AS close_location,
  volume / nullif({rolling_mean('volume', 5, 3)}, 0) AS volume_acceleration,
  close * volume / nullif({rolling_mean('close * volume', 20, 10)}, 0) AS turnover_acceleration,
  coalesce(value / nullif({rolling_mean('value', 20, 10)}, 0), 1.0) AS turnover_ratio,
  sgn * count(*) OVER (PARTITION BY exchange, symbol, island ORDER BY date) AS up_down_streak
FROM (SELECT *, sum(turned) OVER {W} AS island FROM (
  SELECT *, CASE WHEN sgn = lag(sgn) OVER {W} THEN 0 ELSE 1 END AS turned
  FROM (SELECT *, sign(coalesce(return_1d, 0)) AS sgn FROM regime)))""",
)


@query("win_12_intraday_features", f"{K}, intraday_return f, overnight_gap f, range_atr f, close_location f", "SELECT * FROM tech", "tech")
def _(m):
    return feat.technical(m.bars)


@query(
    "win_13_activity_ratios", f"{K}, volume_ratio f, volume_acceleration f, turnover_acceleration f, turnover_ratio f",
    "SELECT * FROM tech", "tech",
)
def _(m):
    return feat.technical(m.bars)


@query("win_14_distance_to_average", f"{K}, dist_sma20 f, dist_sma50 f", "SELECT * FROM tech", "tech")
def _(m):
    return feat.technical(m.bars)


@query("win_15_up_down_streak", f"{K}, up_down_streak i", "SELECT * FROM tech", "tech")
def _(m):
    return feat.technical(m.bars)


define(
    "rets",
    "bars stocks",
    f"""
SELECT exchange, symbol, date, close, sector, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret
FROM bars JOIN (SELECT exchange, symbol, sector FROM stocks WHERE is_active) USING (exchange, symbol)""",
)
_IDX = "OVER (PARTITION BY exchange ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
define(
    "ctx",
    "rets",
    f"""
SELECT *, coalesce(CASE WHEN count(*) {_IDX.format(4)} >= 2 THEN product(1 + index_ret_1d) {_IDX.format(4)} - 1 END, 0) AS index_ret_5d,
       coalesce(CASE WHEN count(*) {_IDX.format(19)} >= 10 THEN product(1 + index_ret_1d) {_IDX.format(19)} - 1 END, 0) AS index_ret_20d
FROM (SELECT exchange, date, coalesce(avg(ret), 0) AS index_ret_1d,
             coalesce(avg(CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END), 0.5) AS breadth
      FROM rets GROUP BY exchange, date)""",
)
define(
    "secctx", "rets",
    "SELECT exchange, sector, date, coalesce(avg(ret), 0) AS sector_ret_1d FROM rets WHERE sector <> '' GROUP BY ALL",
)
define(
    "usable", "stocks",
    "SELECT exchange FROM stocks WHERE is_active GROUP BY exchange HAVING count(*) FILTER (sector <> '') / count(*) >= 0.9",
)
_WIN = "OVER (PARTITION BY exchange, symbol ORDER BY date)"
define(
    "feat",
    "tech ctx secctx usable stocks",
    f"""
SELECT *, coalesce(return_1d, 0) - index_ret_1d AS rel_ret_1d, coalesce(return_5d, 0) - index_ret_5d AS rel_ret_5d,
  coalesce(return_20d, 0) - index_ret_20d AS rel_ret_20d, coalesce(return_1d, 0) - sector_ret_1d AS stock_sector_rel_1d,
  sector_ret_1d - index_ret_1d AS sector_index_rel_1d, CASE WHEN index_ret_20d > 0 THEN 1.0 ELSE 0.0 END AS trend_regime,
  CASE WHEN fwd_ret_10 IS NOT NULL THEN CASE WHEN fwd_ret_10 > 0 THEN 1.0 ELSE 0.0 END END AS label,
  CASE WHEN fwd_ret_1 < -0.005 THEN 0 WHEN fwd_ret_1 > 0.005 THEN 2 WHEN fwd_ret_1 IS NOT NULL THEN 1 END AS direction_label
FROM (SELECT t.*, s.sector,
        coalesce(c.index_ret_1d, 0) AS index_ret_1d, coalesce(c.index_ret_5d, 0) AS index_ret_5d, coalesce(c.index_ret_20d, 0) AS index_ret_20d,
        coalesce(c.breadth, 0.5) AS breadth, coalesce(CASE WHEN u.exchange IS NOT NULL THEN x.sector_ret_1d END, 0) AS sector_ret_1d
      FROM (SELECT *, lead(close) {_WIN} / close - 1 AS fwd_ret_1, lead(close, 10) {_WIN} / close - 1 AS fwd_ret_10,
                   lead(volume) {_WIN} AS next_volume FROM tech) t
      LEFT JOIN (SELECT exchange AS e2, symbol AS s2, sector FROM stocks) s ON s.e2 = t.exchange AND s.s2 = t.symbol
      LEFT JOIN ctx c ON c.exchange = t.exchange AND c.date = t.date
      LEFT JOIN usable u ON u.exchange = t.exchange
      LEFT JOIN secctx x ON x.exchange = t.exchange AND x.sector = s.sector AND x.date = t.date)""",
)


@query(
    "win_16_relative_strength",
    f"{K}, rel_ret_1d f, rel_ret_5d f, rel_ret_20d f, stock_sector_rel_1d f, sector_index_rel_1d f, trend_regime f",
    "SELECT * FROM feat", "feat",
)
def _(m):
    return feat.feature_frame(m.bars, m.stocks)


_LATEST_COLS = ", ".join(f"{c} f" for c in fixed.NEXT_CLOSE_FEATURES)
define(
    "latest_vec", "feat",
    "SELECT * REPLACE (coalesce(vol_regime, 1.0) AS vol_regime), date AS as_of FROM feat WHERE rn = n_rows AND n_rows >= 40 AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in fixed.TECHNICAL_FEATURES),
)


@query("win_17_latest_feature_vector", f"exchange s, symbol s, as_of d, {_LATEST_COLS}", "SELECT * FROM latest_vec", "latest_vec")
def _(m):
    return feat.latest_vector(m.bars, m.stocks)


@query("win_18_forward_labels", f"{K}, fwd_ret_1 f, fwd_ret_10 f, label f, direction_label i, next_volume i", "SELECT * FROM feat", "feat")
def _(m):
    from barwright.functions.recurrence import with_blocks

    return feat.with_labels(with_blocks(m.bars))


@query(
    "win_19_recent_and_previous_close", "exchange s, symbol s, today d, recent_bars i, latest_close f, previous_close f",
    """
WITH t AS (SELECT max(date) AS today FROM bars_all)
SELECT exchange, symbol, any_value(today) AS today, count(*) FILTER (date >= today - 15 AND date <= today) AS recent_bars,
       arg_max(close, date) FILTER (date >= today - 15) AS latest_close,
       arg_max(close, date) FILTER (date >= today - 15 AND date < today AND NOT is_synthetic) AS previous_close
FROM bars_all, t GROUP BY exchange, symbol HAVING count(*) FILTER (date >= today - 15) > 0""",
    "bars_all",
)
def _(m):
    from barwright.operators.listing import recent_closes

    return recent_closes(m.bars_all)


@query(
    "win_20_holding_sessions", "portfolio_id i, exchange s, symbol s, opened_on d, sessions i",
    """
WITH p AS (SELECT portfolio_id, exchange, symbol, min(txn_date) AS opened_on FROM ledger WHERE side = 'BUY' GROUP BY ALL)
SELECT p.*, (SELECT count(DISTINCT b.date) FROM bars b WHERE b.exchange = p.exchange AND b.symbol = p.symbol AND b.date > p.opened_on) AS sessions
FROM p""",
    "ledger bars",
)
def _(m):
    from barwright.operators.paper import holding_sessions

    opened = (
        m.ledger.filter(F.col("side") == "BUY").groupBy("portfolio_id", "exchange", "symbol").agg(F.min("txn_date").alias("opened_on"))
    )
    return holding_sessions(opened, m.bars)


# ---------------------------------------------------------------- context aggregates


@query("agg_01_index_and_breadth", "exchange s, date d, index_ret_1d f, breadth f", "SELECT * FROM ctx", "ctx")
def _(m):
    return ctx.exchange_context(ctx.daily_returns(m.bars, m.stocks))


@query("agg_02_compounded_index_return", "exchange s, date d, index_ret_5d f, index_ret_20d f", "SELECT * FROM ctx", "ctx")
def _(m):
    return ctx.exchange_context(ctx.daily_returns(m.bars, m.stocks))


@query("agg_03_sector_return", "exchange s, sector s, date d, sector_ret_1d f", "SELECT * FROM secctx", "secctx")
def _(m):
    return ctx.sector_context(ctx.daily_returns(m.bars, m.stocks))


define(
    "pairs",
    "rets ctx",
    """
SELECT r.exchange, r.symbol, r.date, r.ret AS stock_ret, c.index_ret_1d AS index_ret
FROM (SELECT *, max(date) OVER (PARTITION BY exchange, symbol) AS last_date FROM rets) r JOIN ctx c ON c.exchange = r.exchange AND c.date = r.date
WHERE r.date >= r.last_date - 90 AND r.ret IS NOT NULL""",
)


@query(
    "agg_04_beta", "exchange s, symbol s, pairs i, beta_90d f",
    """
SELECT exchange, symbol, count(*) AS pairs, CASE WHEN count(*) >= 20 AND var_samp(index_ret) > 1e-12
       THEN round_even(covar_samp(stock_ret, index_ret) / var_samp(index_ret), 3) END AS beta_90d
FROM pairs GROUP BY exchange, symbol""",
    "pairs",
)
def _(m):
    r = ctx.daily_returns(m.bars, m.stocks)
    return ctx.beta(ctx.beta_pairs(r, ctx.exchange_context(r)))


@query("agg_04_beta_pairs", f"{K}, stock_ret f, index_ret f", "SELECT * FROM pairs", "pairs")
def _(m):
    r = ctx.daily_returns(m.bars, m.stocks)
    return ctx.beta_pairs(r, ctx.exchange_context(r))


_R90 = "OVER (PARTITION BY exchange, symbol ORDER BY date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)"


@query(
    "agg_04_rolling_beta", f"{K}, beta_90d f",
    f"""
SELECT exchange, symbol, date, CASE WHEN count(*) {_R90} >= 20 AND var_samp(index_ret_1d) {_R90} > 1e-12
  THEN covar_samp(ret, index_ret_1d) {_R90} / var_samp(index_ret_1d) {_R90} END AS beta_90d
FROM rets JOIN ctx USING (exchange, date) WHERE ret IS NOT NULL""",
    "rets ctx",
)
def _(m):
    r = ctx.daily_returns(m.bars, m.stocks)
    return ctx.rolling_beta(r, ctx.exchange_context(r))


@query(
    "agg_12_breadth_above_sma50", "exchange s, date d, breadth_50 f",
    "SELECT exchange, date, avg(CASE WHEN close > sma_50 THEN 1.0 ELSE 0.0 END) AS breadth_50 FROM ind WHERE sma_50 IS NOT NULL GROUP BY ALL",
    "ind",
)
def _(m):
    return ctx.breadth_above_sma50(ind.indicators(m.bars))


# ---------------------------------------------------------------- data quality

_RULES = [
    ("open IS NULL OR open <= 0", "non_positive_open"), ("high IS NULL OR high <= 0", "non_positive_high"),
    ("low IS NULL OR low <= 0", "non_positive_low"), ("close IS NULL OR close <= 0", "non_positive_close"),
    ("volume < 0", "negative_volume"), ("high >= 0 AND low >= 0 AND high < low", "high_below_low"),
    ("high >= 0 AND low >= 0 AND high >= low AND open > 0 AND NOT (open BETWEEN low AND high)", "open_out_of_range"),
    ("high >= 0 AND low >= 0 AND high >= low AND close > 0 AND NOT (close BETWEEN low AND high)", "close_out_of_range"),
]
_BAR_FLAGS = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for test, code in _RULES)
# a disturbed copy of the raw bars so that every rule has rows to find
define(
    "disturbed",
    "bars_raw",
    """
SELECT * REPLACE (
  CASE WHEN day(date) = 7 THEN -open ELSE open END AS open,
  CASE WHEN day(date) = 11 THEN low - 1 ELSE high END AS high,
  CASE WHEN day(date) = 13 THEN 0 WHEN day(date) IN (14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27) THEN 500.0 ELSE close END AS close,
  CASE WHEN day(date) = 17 THEN -volume ELSE volume END AS volume)
FROM bars_raw""",
)


def disturbed(m):
    day = F.dayofmonth("date")
    return m.bars_raw.withColumns(
        {
            "open": F.when(day == 7, -F.col("open")).otherwise(F.col("open")),
            "high": F.when(day == 11, F.col("low") - 1).otherwise(F.col("high")),
            "close": F.when(day == 13, 0.0).when(day.between(14, 27), 500.0).otherwise(F.col("close")),
            "volume": F.when(day == 17, -F.col("volume")).otherwise(F.col("volume")),
        }
    )


@query(
    "dq_01_bar_validation", f"{K}, flags s",
    f"SELECT *, array_to_string(list_filter([{_BAR_FLAGS}], lambda x: x IS NOT NULL), ',') AS flags FROM disturbed", "disturbed",
)
def _(m):
    return dq.with_bar_flags(disturbed(m)).withColumn("flags", F.array_join("quality_flags", ","))


define(
    "facts",
    "disturbed",
    f"""
SELECT *, CASE WHEN repeats THEN count(*) FILTER (repeats) OVER (PARTITION BY exchange, symbol, island) ELSE 0 END AS stale_run
FROM (SELECT *, count(*) FILTER (NOT repeats) OVER {W} AS island FROM (
  SELECT *, date - prev_date AS gap_days,
         CASE WHEN prev_close > 0 AND close > 0 THEN abs(close - prev_close) / prev_close * 100 END AS jump_pct,
         coalesce(close = prev_close AND volume > 0, false) AS repeats
  FROM (SELECT *, lag(date) OVER {W} AS prev_date, lag(close) OVER {W} AS prev_close FROM disturbed)))""",
)
define(
    "scanned",
    "facts",
    f"""
SELECT *, list_sort(list_filter([{_BAR_FLAGS}, CASE WHEN gap_days > 10 THEN 'gap_before' END,
  CASE WHEN jump_pct >= 25 THEN 'abnormal_jump' END, CASE WHEN stale_run >= 5 THEN 'stale_quote_run' END], lambda x: x IS NOT NULL)) AS quality_flags
FROM facts""",
)


@query(
    "dq_02_session_gaps", "exchange s, symbol s, gap_start d, gap_end d, days_missing i",
    "SELECT exchange, symbol, prev_date AS gap_start, date AS gap_end, gap_days AS days_missing FROM facts WHERE gap_days > 10", "facts",
)
def _(m):
    return dq.gaps(disturbed(m))


@query("dq_03_abnormal_jumps", f"{K}, jump_pct f", "SELECT * FROM facts WHERE jump_pct >= 25", "facts")
def _(m):
    return dq.with_history_facts(disturbed(m)).filter(F.col("jump_pct") >= fixed.ABNORMAL_JUMP_PCT)


@query("dq_04_stale_quote_runs", f"{K}, stale_run i", "SELECT * FROM facts WHERE stale_run >= 5", "facts")
def _(m):
    return dq.with_history_facts(disturbed(m)).filter(F.col("stale_run") >= fixed.STALE_RUN_MIN_LENGTH)


@query(
    "dq_05_full_scan_flags", f"{K}, flags s", "SELECT *, array_to_string(quality_flags, ',') AS flags FROM scanned", "scanned",
)
def _(m):
    return dq.full_scan(disturbed(m)).withColumn("flags", F.array_join("quality_flags", ","))


_MEASURES = [*fixed.STRICT_EXCLUDE_FLAGS, "gap_before", "stale_quote_run"]


@query(
    "dq_05_full_scan_totals", "measure s, total i",
    "SELECT 'rows_scanned' AS measure, count(*) AS total FROM scanned UNION ALL "
    "SELECT 'rows_flagged', count(*) FROM scanned WHERE len(quality_flags) > 0 UNION ALL "
    "SELECT 'gaps_found', count(*) FROM scanned WHERE gap_days > 10 UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}', count(*) FROM scanned WHERE list_contains(quality_flags, '{f}')" for f in _MEASURES),
    "scanned",
)
def _(m):
    return dq.scan_totals(dq.full_scan(disturbed(m)))


@query(
    "dq_05_flag_histogram", "flag s, total i",
    "SELECT flag, count(*) AS total FROM (SELECT unnest(quality_flags) AS flag FROM scanned) GROUP BY flag", "scanned",
)
def _(m):
    return dq.flag_histogram(dq.full_scan(disturbed(m))).withColumnRenamed("count", "total")


_EXCL = ", ".join(f"'{f}'" for f in fixed.TRAINING_EXCLUDE_FLAGS)


@query(
    "dq_06_training_exclusion", f"{K}, close f, strict_ok b",
    f"SELECT *, NOT list_has_any(quality_flags, [{_EXCL}, 'open_out_of_range']) AS strict_ok FROM scanned WHERE NOT list_has_any(quality_flags, [{_EXCL}])",
    "scanned",
)
def _(m):
    from barwright.functions.expr import flags_overlap

    return dq.usable_for_training(dq.full_scan(disturbed(m))).withColumn(
        "strict_ok", ~flags_overlap(F.col("quality_flags"), fixed.STRICT_EXCLUDE_FLAGS)
    )


@query(
    "dq_07_chronology_errors", "exchange s, symbol s, null_dates i, repeated_dates i",
    """
SELECT exchange, symbol, count(*) FILTER (date IS NULL) AS null_dates, count(*) FILTER (date IS NOT NULL) AS repeated_dates
FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange, 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n
      FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""",
)
def _(m):
    # un-aggregated trades are a history with repeated dates
    k = F.col("l_suppkey")
    raw = m.table("lineitem").select(
        F.when(k % 2 == 0, "DSE").otherwise("CSE").alias("exchange"), F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
    )
    return dq.chronology_errors(raw)


@query(
    "src_01_bar_scan", f"{K}, open f, high f, low f, close f, volume f, value f",
    f"""
SELECT * FROM disturbed WHERE close IS NOT NULL
AND NOT list_has_any(list_filter([{_BAR_FLAGS}], lambda x: x IS NOT NULL), [{_EXCL}])""",
    "disturbed",
)
def _(m):
    return ind.scan(dq.with_bar_flags(disturbed(m)), fixed.TRAINING_EXCLUDE_FLAGS)


@query("src_02_live_rows", "exchange s, live_rows i, demo_rows i", "SELECT exchange, count(*) FILTER (NOT is_synthetic) AS live_rows, count(*) FILTER (is_synthetic) AS demo_rows FROM bars_all GROUP BY exchange", "bars_all")
def _(m):
    return m.bars_all.groupBy("exchange").agg(
        F.count_if(~F.col("is_synthetic")).alias("live_rows"), F.count_if("is_synthetic").alias("demo_rows")
    )


define(
    "flagged", "scanned",
    "SELECT * FROM scanned",
)


@query(
    "agg_14_provenance_report", "exchange s, source s, total_rows i, synthetic_rows i, unknown_rows i, flagged_rows i, latest_date d",
    """
SELECT exchange, source, count(*) AS total_rows, count(*) FILTER (is_synthetic) AS synthetic_rows,
       count(*) FILTER (source = 'unknown') AS unknown_rows, count(*) FILTER (len(quality_flags) > 0) AS flagged_rows, max(date) AS latest_date
FROM flagged GROUP BY exchange, source""",
    "flagged",
)
def _(m):
    return dq.provenance_report(dq.full_scan(disturbed(m)))


@query(
    "agg_15_provenance_by_stock",
    "exchange s, symbol s, latest_date d, latest_source s, is_synthetic b, latest_adjustment s, latest_flags s, known_rows i, unknown_rows i, raw_rows i",
    """
SELECT exchange, symbol, max(date) AS latest_date, arg_max(source, date) AS latest_source, arg_max(is_synthetic, date) AS is_synthetic,
       arg_max(adjustment_status, date) AS latest_adjustment, array_to_string(arg_max(quality_flags, date), ',') AS latest_flags,
       count(*) FILTER (source <> 'unknown') AS known_rows, count(*) FILTER (source = 'unknown') AS unknown_rows,
       count(*) FILTER (adjustment_status = 'raw') AS raw_rows
FROM flagged GROUP BY exchange, symbol""",
    "flagged",
)
def _(m):
    return dq.provenance_by_stock(dq.full_scan(disturbed(m)))


@query(
    "agg_16_research_summary",
    "exchange s, active_stocks i, blank_sectors i, coverage_pct f, sector_usable b, price_rows i, flagged_rows i, unknown_rows i",
    """
SELECT s.*, round_even((active_stocks - blank_sectors) / active_stocks * 100.0, 2) AS coverage_pct,
       (active_stocks - blank_sectors) / active_stocks >= 0.9 AS sector_usable, price_rows, flagged_rows, unknown_rows
FROM (SELECT exchange, count(*) AS active_stocks, count(*) FILTER (sector = '') AS blank_sectors FROM stocks WHERE is_active GROUP BY exchange) s
LEFT JOIN (SELECT exchange, count(*) AS price_rows, count(*) FILTER (len(quality_flags) > 0) AS flagged_rows,
                  count(*) FILTER (source = 'unknown' OR adjustment_status = 'unknown') AS unknown_rows
           FROM flagged WHERE NOT is_synthetic GROUP BY exchange) USING (exchange)""",
    "stocks flagged",
)
def _(m):
    return dq.research_summary(m.stocks, dq.full_scan(disturbed(m)))


define(
    "quality",
    "stocks bars",
    """
SELECT *, array_to_string(rs, '; ') AS reasons, len(rs) > 0 AS limited FROM (
SELECT *, list_filter([CASE WHEN history_days < 80 THEN 'Too little price history' END,
   CASE WHEN recent_sessions < ceil(expected * 0.8) THEN 'Not traded regularly in the last 60 days' END,
   CASE WHEN coalesce(avg_value, 0) <= CASE WHEN len(vals) >= 10 THEN (list_sort(vals))[CAST(ceil(len(vals) * 0.1) AS BIGINT)] END
        THEN 'Recent traded value is in the lowest 10%' END], lambda x: x IS NOT NULL) AS rs
FROM (SELECT *, list(coalesce(avg_value, 0)) FILTER (recent_sessions > 0) OVER (PARTITION BY exchange) AS vals FROM (
  SELECT a.exchange, a.symbol, coalesce(p.recent_sessions, 0) AS recent_sessions, coalesce(p.history_days, 0) AS history_days, p.avg_value
  FROM (SELECT exchange, symbol FROM stocks WHERE is_active) a
  LEFT JOIN (SELECT exchange, symbol, count(*) FILTER (date >= latest - 60) AS recent_sessions, count(*) AS history_days,
                    avg(value) FILTER (date >= latest - 60) AS avg_value
             FROM bars JOIN (SELECT exchange, max(date) AS latest FROM bars GROUP BY exchange) USING (exchange) GROUP BY exchange, symbol) p
  USING (exchange, symbol)))
JOIN (SELECT exchange, count(DISTINCT date) AS expected FROM bars JOIN (SELECT exchange, max(date) AS latest FROM bars GROUP BY exchange) USING (exchange)
      WHERE date >= latest - 60 GROUP BY exchange) USING (exchange))""",
)


@query(
    "agg_13_stock_quality", "exchange s, symbol s, recent_sessions i, history_days i, avg_value f, limited b, reasons s",
    "SELECT * FROM quality", "quality",
)
def _(m):
    return dq.stock_quality(m.stocks, m.bars)
