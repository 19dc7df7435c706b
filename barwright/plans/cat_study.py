"""Signal study and paper evidence queries (survey 2.10, parts of 2.4 and 2.8)."""

from pyspark.sql import functions as F

from barwright.functions.rolling import KEY
from barwright.operators import context as ctx
from barwright.operators import ledger, paper, patterns, scoring, study
from barwright.operators import quality as dq
from barwright.operators.indicators import indicators, latest
from barwright.plans.cat_ledger import market_calendar
from barwright.plans.cat_signals import screened, swinging, swinging_sql
from barwright.plans.oracle import W, define, define_indicators
from barwright.plans.registry import query

K = "exchange s, symbol s, date d"
RULES = study.Rules(least_volume=10, volume_share_pct=100.0)
STRICT = study.Rules("strict_research_v1", 120_000.0, 40, 12.0, 6.0, 10, 100.0, 1.25, 0.35)
INITIAL = 1_000_000.0

def _define_signals(suffix=""):
    """Breadth and entry signals over one set of indicators with their previous values."""
    define(
        f"b50{suffix}", f"ind{suffix}",
        f"SELECT exchange, date, avg(CASE WHEN close > sma_50 THEN 1.0 ELSE 0.0 END) AS breadth_50 FROM ind{suffix} WHERE sma_50 IS NOT NULL GROUP BY ALL",
    )
    define(
        f"sig{suffix}", f"indp{suffix} b50{suffix}",
        f"""
SELECT i.*, b.breadth_50, rn > 1 AND (coalesce(rsi_14 < 35, false) OR coalesce(prev_macd <= prev_macd_signal AND macd > macd_signal, false)) AS sig_base,
  rn > 1 AND coalesce(rsi_14 < 35 AND prev_macd <= prev_macd_signal AND macd > macd_signal AND volume_sma_20 > 0 AND volume >= volume_sma_20 * 1.25, false)
    AND coalesce(breadth_50, 0) >= 0.35 AS sig_strict
FROM indp{suffix} i LEFT JOIN b50{suffix} b ON b.exchange = i.exchange AND b.date = i.date""",
    )


_define_signals()
# bars with splits: every third security trades at one and a half times its price from July to December
define(
    "bars_split", "bars",
    """
SELECT * REPLACE (open * f AS open, high * f AS high, low * f AS low, close * f AS close)
FROM (SELECT *, CASE WHEN CAST(symbol[2:] AS BIGINT) % 3 = 1 AND month(date) > 6 THEN 1.5 ELSE 1.0 END AS f FROM bars)""",
)
define_indicators("bars_split", "_split")
define("indp_split", "ind_split", f"SELECT *, lag(macd) OVER {W} AS prev_macd, lag(macd_signal) OVER {W} AS prev_macd_signal FROM ind_split")
_define_signals("_split")


def split_bars(m):
    moved = (F.substring("symbol", 2, 20).cast("long") % 3 == 1) & (F.month("date") > 6)
    factor = F.when(moved, 1.5).otherwise(1.0)
    return m.bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")})


def _base(m, bars=None):
    ind = patterns.with_previous(indicators(m.bars if bars is None else bars))
    return ind, ctx.breadth_above_sma50(ind)


@query("bt_01_entry_signals", f"{K}, signal b", "SELECT *, sig_base AS signal FROM sig", "sig")
def _(m):
    return study.signals(*_base(m), RULES)


@query("bt_01_strict_signals", f"{K}, breadth_50 f", "SELECT * FROM sig WHERE sig_strict", "sig")
def _(m):
    return study.signals(*_base(m), STRICT).filter("signal")


def _trades_sql(flag, notional, hold, target, stop, strict, source="sig"):
    frame = f"OVER (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {5 + hold} FOLLOWING)"
    stop_test = (lambda x: f"({x}.low <= entry * {1 - stop / 100})") if stop else (lambda x: "false")
    target_test = lambda x: f"({x}.close >= entry * {1 + target / 100})"
    thin = "fill.volume < 10 OR shares < 1" + (" OR fill.high <= fill.low" if strict else "")
    return f"""
SELECT *, CASE WHEN filled THEN gross END AS gross_pnl, CASE WHEN filled THEN shares * exit_price * (1 - 0.0035) - paid END AS net_pnl,
  CASE WHEN filled THEN shares * entry * 0.0035 + shares * fill.open * 0.002 + shares * exit_price * 0.0035 + shares * raw_exit * adverse END AS costs,
  CASE WHEN filled THEN (shares * exit_price * (1 - 0.0035) - paid) / paid * 100 END AS return_pct, CASE WHEN filled THEN paid END AS cash_paid,
  CASE WHEN filled THEN shares END AS n_shares, CASE WHEN filled THEN entry END AS entry_price, CASE WHEN filled THEN fill.open END AS entry_open,
  CASE WHEN filled THEN exit_price END AS exitp, CASE WHEN filled THEN xdate - fill.date END AS hold_calendar_days, CASE WHEN filled THEN xrn - fill.rn END AS sessions_held,
  CASE WHEN filled THEN xdate END AS exit_date, CASE WHEN filled THEN corp END AS corp_action,
  CASE WHEN filled THEN xdate ELSE coalesce(fill.date, path[least(len(path), 5)].date, date) END AS free_from, date AS signal_date, fill.date AS entry_date
FROM (SELECT *, raw_exit * (1 - adverse) AS exit_price, shares * (raw_exit - fill.open) AS gross, shares * entry * 1.0035 AS paid FROM (
SELECT *, CASE WHEN sold THEN 0.002 ELSE 0 END AS adverse, CASE WHEN sold THEN hit.nxt.open ELSE lastclose END AS raw_exit, CASE WHEN sold THEN hit.nxt.date ELSE lastdate END AS xdate,
  CASE WHEN sold THEN hit.nxt.rn ELSE n_rows END AS xrn,
  CASE WHEN NOT filled THEN NULL WHEN hit IS NULL OR (NOT sold AND hit.rn < n_rows) THEN 'forced_close_at_backtest_end' WHEN NOT sold THEN 'forced_close_no_further_data'
       WHEN {stop_test('hit')} THEN 'stop_loss' WHEN {target_test('hit')} THEN 'target' ELSE 'hold_days' END AS reason,
  len(list_filter(held, lambda x: x.rn <= coalesce(hit.rn, n_rows) AND abs(x.ret) * 100 >= 25)) > 0 OR (sold AND coalesce(abs(hit.nxt.ret) * 100 >= 25, false)) AS corp
FROM (SELECT *, coalesce(hit.nxt IS NOT NULL, false) AS sold FROM (
SELECT *, list_filter(held, lambda x: {stop_test('x')} OR {target_test('x')} OR x.rn - fill.rn >= {hold})[1] AS hit FROM (
SELECT *, fill_state = 'filled' AS filled, CASE WHEN fill_state = 'filled' THEN list_filter(path, lambda x: x.rn >= fill.rn AND x.rn <= fill.rn + {hold}) END AS held FROM (
SELECT *, CASE WHEN fill IS NULL AND len(coalesce(path, [])) = 0 THEN 'no_next_session' WHEN fill IS NULL THEN 'abandoned_suspended' WHEN fill.open <= 0 THEN 'no_price'
   WHEN {thin} THEN 'insufficient_liquidity' ELSE 'filled' END AS fill_state FROM (
SELECT *, fill.open * 1.002 AS entry, least(floor({notional} / (fill.open * 1.002)), fill.volume) AS shares FROM (
SELECT *, list_filter(path[1:5], lambda x: x.volume > 0)[1] AS fill FROM (
SELECT *, list({{'rn': rn, 'date': date, 'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume, 'ret': return_1d, 'nxt': nxt}}) {frame} AS path FROM (
SELECT *, lead({{'date': date, 'open': open, 'ret': return_1d, 'rn': rn}}) OVER {W} AS nxt, last_value(close) OVER (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastclose,
  max(date) OVER (PARTITION BY exchange, symbol) AS lastdate FROM {source})) WHERE {flag})))))))) """


define("trades", "sig", _trades_sql("sig_base", 50000.0, 20, 5.0, None, False))
define("strict_trades", "sig", _trades_sql("sig_strict", 120000.0, 40, 12.0, 6.0, True))
define("split_trades", "sig_split", _trades_sql("sig_base", 50000.0, 20, 5.0, None, False, "sig_split"))
TRADE = (
    "exchange s, symbol s, signal_date d, fill_state s, entry_date d, exit_date d, reason s, entry_price f, exit_price f, shares i, gross_pnl f, net_pnl f, costs f, "
    "return_pct f, hold_calendar_days i, sessions_held i, corp_action b"
)
_T = "SELECT * REPLACE (exitp AS exit_price, n_shares AS shares) FROM {}"


def _trades(m, rules=RULES, bars=None):
    return study.trades(study.signals(*_base(m, bars), rules), rules)


@query(
    "bt_02_next_open_fill", "exchange s, symbol s, signal_date d, fill_state s, entry_date d, entry_open f, entry_price f, shares i",
    _T.format("trades"), "trades",
)
def _(m):
    return _trades(m)


@query("bt_03_exit_detection", "exchange s, symbol s, signal_date d, exit_date d, reason s, sessions_held i", "SELECT * FROM trades", "trades")
def _(m):
    return _trades(m)


@query("bt_04_trade_profit_after_costs", TRADE, _T.format("trades"), "trades")
def _(m):
    return _trades(m)


@query("bt_04_strict_trades", TRADE, _T.format("strict_trades"), "strict_trades")
def _(m):
    return _trades(m, STRICT)


@query(
    "bt_05_corporate_action_exclusion", "exchange s, excluded i, headline i",
    "SELECT exchange, count(*) FILTER (corp_action) AS excluded, count(*) FILTER (NOT corp_action) AS headline FROM trades WHERE filled GROUP BY exchange", "trades",
)
def _(m):
    t = _trades(m).filter(F.col("fill_state") == "filled")
    return t.groupBy("exchange").agg(F.count_if("corp_action").alias("excluded"), F.count_if(~F.col("corp_action")).alias("headline"))


@query("bt_05_trades_over_splits", TRADE, _T.format("split_trades"), "split_trades")
def _(m):
    return _trades(m, bars=split_bars(m))


@query(
    "bt_05_exclusion_over_splits", "exchange s, corp_action b, trades i, winners i, average_return_pct f",
    "SELECT exchange, corp_action, count(*) AS trades, count(*) FILTER (net_pnl > 0) AS winners, avg(return_pct) AS average_return_pct FROM split_trades WHERE filled GROUP BY exchange, corp_action",
    "split_trades",
)
def _(m):
    t = _trades(m, bars=split_bars(m)).filter(F.col("fill_state") == "filled")
    return t.groupBy("exchange", "corp_action").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("net_pnl") > 0).alias("winners"), F.avg("return_pct").alias("average_return_pct"))


define(
    "hops", "trades",
    """
SELECT t.exchange, t.symbol, t.signal_date, n.signal_date AS next_signal
FROM (SELECT *, greatest(free_from, signal_date + 1) AS from_day FROM trades) t
ASOF LEFT JOIN trades n ON n.exchange = t.exchange AND n.symbol = t.symbol AND n.signal_date >= t.from_day""",
)
define(
    "taken", "hops",
    """
SELECT exchange, symbol, min(signal_date) AS signal_date FROM hops GROUP BY exchange, symbol
UNION ALL SELECT h.exchange, h.symbol, h.next_signal FROM taken t JOIN hops h ON h.exchange = t.exchange AND h.symbol = t.symbol AND h.signal_date = t.signal_date WHERE h.next_signal IS NOT NULL""",
)
define(
    "marked", "trades taken",
    "SELECT t.*, k.symbol IS NOT NULL AS taken FROM trades t LEFT JOIN taken k ON k.exchange = t.exchange AND k.symbol = t.symbol AND k.signal_date = t.signal_date",
)
define("closed", "marked", "SELECT * FROM marked WHERE taken AND filled AND NOT corp_action")


def _closed(m):
    t = study.non_overlapping(_trades(m))
    return t.filter(F.col("taken") & (F.col("fill_state") == "filled") & ~F.col("corp_action"))


@query("bt_06_non_overlapping_trades", "exchange s, symbol s, signal_date d, taken b", "SELECT * FROM marked", "marked")
def _(m):
    return study.non_overlapping(_trades(m))


@query(
    "bt_06_rejection_counts", "exchange s, outcome s, signals i",
    "SELECT exchange, CASE WHEN NOT taken THEN 'already_open' ELSE fill_state END AS outcome, count(*) AS signals FROM marked GROUP BY ALL", "marked",
)
def _(m):
    return study.rejections(study.non_overlapping(_trades(m)))


# equity on every session: cash flows up to the day, and each open trade at its security's last close by an as-of join
define(
    "curve", "closed bars",
    """
SELECT *, equity / lag(equity) OVER (PARTITION BY exchange ORDER BY date) - 1 AS ret, (equity / max(equity) OVER (PARTITION BY exchange ORDER BY date) - 1) * 100 AS dd,
  held_value / equity * 100 AS exposure_pct
FROM (
SELECT s.exchange, s.date, coalesce(v.held_value, 0) AS held_value,
  1000000 + coalesce(sum(f.x) OVER (PARTITION BY s.exchange ORDER BY s.date), 0) + coalesce(v.held_value, 0) AS equity
FROM (SELECT DISTINCT b.exchange, b.date FROM bars b JOIN (SELECT exchange, min(entry_date) AS a, max(exit_date) AS z FROM closed GROUP BY exchange) r
      ON r.exchange = b.exchange AND b.date BETWEEN r.a AND r.z) s
LEFT JOIN (SELECT exchange, date, sum(x) AS x FROM (SELECT exchange, entry_date AS date, -cash_paid AS x FROM closed UNION ALL SELECT exchange, exit_date, cash_paid + net_pnl FROM closed) GROUP BY ALL) f
  ON f.exchange = s.exchange AND f.date = s.date
LEFT JOIN (SELECT o.exchange, o.day, sum(o.n_shares * b.close) AS held_value
  FROM (SELECT c.exchange, c.day, k.symbol, k.n_shares FROM (SELECT DISTINCT exchange, date AS day FROM bars) c
        JOIN closed k ON k.exchange = c.exchange AND c.day >= k.entry_date AND c.day < k.exit_date) o
  ASOF JOIN bars b ON b.exchange = o.exchange AND b.symbol = o.symbol AND o.day >= b.date GROUP BY ALL) v
  ON v.exchange = s.exchange AND v.day = s.date)""",
)


def _curve(m):
    return study.equity_curve(_closed(m), m.bars, INITIAL)


@query(
    "bt_07_equity_metrics", "exchange s, days i, total_return_pct f, annualized_return_pct f, max_drawdown_pct f, sharpe f, sortino f",
    """
SELECT exchange, count(*) AS days, round_even((arg_max(equity, date) / 1000000 - 1) * 100, 3) AS total_return_pct,
  round_even((pow(arg_max(equity, date) / 1000000, 1 / greatest((max(date) - min(date)) / 365.25, 1e-9)) - 1) * 100, 3) AS annualized_return_pct,
  round_even(min(dd), 3) AS max_drawdown_pct, round_even(avg(ret) / stddev_pop(ret) * sqrt(250), 3) AS sharpe,
  round_even(avg(ret) / stddev_pop(ret) FILTER (ret < 0) * sqrt(250), 3) AS sortino FROM curve GROUP BY exchange""",
    "curve",
)
def _(m):
    return study.equity_metrics(_curve(m), INITIAL)


@query(
    "bt_07_exposure_and_turnover", "exchange s, avg_exposure_pct f, turnover_pct f",
    """
SELECT c.exchange, c.avg_exposure_pct, t.turnover_pct FROM (SELECT exchange, round_even(avg(exposure_pct), 3) AS avg_exposure_pct FROM curve GROUP BY exchange) c
JOIN (SELECT exchange, round_even(sum(n_shares * (entry_price + exitp)) / 1000000 * 100, 3) AS turnover_pct FROM closed GROUP BY exchange) t ON t.exchange = c.exchange""",
    "closed curve",
)
def _(m):
    return study.exposure(_closed(m), _curve(m), INITIAL)


@query(
    "bt_08_trade_metrics", "exchange s, trades i, win_rate f, avg_win_pct f, avg_loss_pct f, avg_return_pct f, profit_factor f, total_costs f",
    """
SELECT exchange, count(*) AS trades, round_even(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round_even(avg(return_pct) FILTER (net_pnl > 0), 3) AS avg_win_pct,
  round_even(avg(return_pct) FILTER (net_pnl <= 0), 3) AS avg_loss_pct, round_even(avg(return_pct), 3) AS avg_return_pct,
  round_even(sum(net_pnl) FILTER (net_pnl > 0) / abs(sum(net_pnl) FILTER (net_pnl <= 0)), 3) AS profit_factor, round_even(sum(costs), 2) AS total_costs FROM closed GROUP BY exchange""",
    "closed",
)
def _(m):
    return study.trade_metrics(_closed(m), "exchange")


@query(
    "bt_09_breakdown", "kind s, label s, trades i, win_rate f, avg_return_pct f, total_net_pnl f, small_sample b",
    """
SELECT kind, label, count(*) AS trades, round_even(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round_even(avg(return_pct), 3) AS avg_return_pct,
  round_even(sum(net_pnl), 2) AS total_net_pnl, count(*) < 20 AS small_sample
FROM (SELECT net_pnl, return_pct, unnest([{'kind': 'year', 'label': CAST(year(entry_date) AS VARCHAR)}, {'kind': 'exchange', 'label': c.exchange},
        {'kind': 'sector', 'label': CASE WHEN coalesce(sector, '') = '' THEN 'Unknown' ELSE sector END}], recursive := true)
      FROM closed c LEFT JOIN stocks s ON s.exchange = c.exchange AND s.symbol = c.symbol) GROUP BY kind, label""",
    "closed stocks",
)
def _(m):
    return study.breakdown(_closed(m), m.stocks)


@query(
    "bt_10_buy_and_hold", "exchange s, buy_hold_return_pct f, stocks i",
    """
SELECT exchange, round_even(avg(c / o - 1) * 100, 3) AS buy_hold_return_pct, count(*) AS stocks FROM (
SELECT exchange, symbol, arg_min(open, date) AS o, arg_max(close, date) AS c FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY ALL) WHERE o > 0 GROUP BY exchange""",
    "bars",
)
def _(m):
    return study.buy_and_hold(m.bars, F.lit("1999-01-01").cast("date"), F.lit("2000-12-31").cast("date"))


@query(
    "bt_11_index_proxy", "exchange s, index_return_pct f, days i",
    "SELECT exchange, round_even((product(1 + greatest(-0.5, least(0.5, index_ret_1d))) - 1) * 100, 3) AS index_return_pct, count(*) AS days FROM ctx WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY exchange",
    "ctx",
)
def _(m):
    c = ctx.exchange_context(ctx.daily_returns(m.bars, m.stocks))
    return ctx.index_proxy(c.filter(F.col("date").between(F.lit("1999-01-01").cast("date"), F.lit("2000-12-31").cast("date"))))


# ------------------------------------------------------------------ paper rules


@query(
    "pp_01_breakout_rule", f"{K}, prior_high f",
    """
SELECT * FROM (SELECT *, max(close) OVER p AS prior_high, count(close) OVER p AS n FROM ind WINDOW p AS (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
WHERE close > sma_20 AND sma_20 > sma_50 AND n = 20 AND close > prior_high AND NOT (coalesce(volume_sma_20, 0) <> 0 AND volume < volume_sma_20)""",
    "ind",
)
def _(m):
    return paper.breakout(indicators(m.bars)).filter("passes")


@query(
    "pp_02_strict_rule", f"{K}, rsi_14 f, breadth_50 f",
    """
SELECT s.* FROM sig s JOIN stocks k ON k.exchange = s.exchange AND k.symbol = s.symbol WHERE k.board <> 'Z' AND rsi_14 < 35 AND prev_macd <= prev_macd_signal AND macd > macd_signal
AND volume >= volume_sma_20 * 1.25 AND breadth_50 >= 0.35""",
    "sig stocks",
)
def _(m):
    ind, breadth = _base(m)
    return paper.strict_rule(ind, breadth, m.stocks, 0.35).filter("passes")


@query(
    "pp_03_execution_price_and_fee", "portfolio_id i, symbol s, txn_id i, execution_price f, fee f",
    """
SELECT *, CAST(floor(x * quantity * 0.0035 * 100 + 0.5 + 1e-6) / 100 AS DOUBLE) AS fee, x AS execution_price
FROM (SELECT *, floor(price::DOUBLE * CASE side WHEN 'BUY' THEN 1.001 ELSE 0.999 END * 10000 + 0.5 + 1e-5) / 10000 AS x FROM ledger)""",
    "ledger",
)
def _(m):
    return paper.execution(m.ledger, "price", "side", "quantity")


define(
    "settled", "ledger stocks cal",
    """
SELECT l.*, k.board, s.date AS settlement_date, l.quantity * l.price - l.fees AS amount
FROM ledger l LEFT JOIN stocks k ON k.exchange = l.exchange AND k.symbol = l.symbol LEFT JOIN cal c ON c.date = l.txn_date
LEFT JOIN cal s ON s.is_session AND s.session_no = c.session_no + CASE WHEN k.board = 'Z' THEN 3 ELSE 2 END""",
)


def _settled(m):
    s = paper.settlement(m.ledger, m.stocks, market_calendar(m), "txn_date")
    return s.withColumn("amount", F.col("quantity") * F.col("price") - F.col("fees"))


@query("pp_04_settlement_date", "portfolio_id i, exchange s, symbol s, txn_id i, txn_date d, settlement_date d", "SELECT * FROM settled", "settled")
def _(m):
    return _settled(m)


@query(
    "pp_05_cash_due", "portfolio_id i, settled_cash f, unsettled_cash f, settlements_due i",
    """
SELECT portfolio_id, coalesce(sum(amount) FILTER (settlement_date <= DATE '1999-06-30'), 0) AS settled_cash, coalesce(sum(amount) FILTER (settlement_date > DATE '1999-06-30'), 0) AS unsettled_cash,
       count(*) FILTER (settlement_date <= DATE '1999-06-30') AS settlements_due FROM settled WHERE side = 'SELL' GROUP BY portfolio_id""",
    "settled",
)
def _(m):
    return paper.cash_due(_settled(m).filter(F.col("side") == "SELL"), F.lit("1999-06-30").cast("date"))


# the latest fill of every security is its open position
define(
    "openpos", "trades scored",
    """
SELECT t.exchange, t.symbol, arg_max(t.entry_date, t.signal_date) AS opened_on, arg_max(t.entry_price, t.signal_date) AS entry_price, any_value(s.close) AS market_price,
       any_value(s.action) AS latest_action, any_value(s.n_rows) AS n_rows, arg_max(t.fill.rn, t.signal_date) AS fill_rn
FROM trades t JOIN scored s ON s.exchange = t.exchange AND s.symbol = t.symbol AND s.rn = s.n_rows WHERE t.filled GROUP BY t.exchange, t.symbol""",
)


@query(
    "pp_06_exit_decision", "exchange s, symbol s, opened_on d, sessions i, change_pct f, exit_reason s",
    """
SELECT *, n_rows - fill_rn AS sessions, (market_price / entry_price - 1) * 100 AS change_pct, CASE WHEN opened_on + 3 > DATE '2001-11-04' THEN NULL WHEN latest_action = 'SELL' THEN 'sell_prediction'
  WHEN (market_price / entry_price - 1) * 100 <= -2.5 THEN 'stop_loss' WHEN (market_price / entry_price - 1) * 100 >= 4.5 THEN 'take_profit' WHEN n_rows - fill_rn >= 3 THEN 'holding_period' END AS exit_reason FROM openpos""",
    "openpos",
)
def _(m):
    t = _trades(m).filter(F.col("fill_state") == "filled")
    pos = t.groupBy(*KEY).agg(F.max_by(F.struct("entry_date", "entry_price"), "signal_date").alias("p"))
    now = latest(scoring.scored_history(m.bars, m.stocks)).select(*KEY, F.col("close").alias("market_price"), F.col("action").alias("latest_action"))
    df = pos.select(*KEY, F.col("p.entry_date").alias("opened_on"), F.col("p.entry_price").alias("entry_price")).join(now, KEY)
    df = paper.holding_sessions(df, m.bars).withColumn("maturity_date", F.date_add("opened_on", 3))
    return paper.exit_decision(df, F.lit("2001-11-04").cast("date"))


@query(
    "pp_07_account_equity", "portfolio_id i, cash m, holdings_value m, total_equity m, unrealized_pnl m, realized_pnl m, open_positions i, total_return_pct f",
    """
SELECT *, round_even((total_equity / 1e8 - 1) * 100, 2) AS total_return_pct FROM (
SELECT a.portfolio_id, a.cash, a.realized AS realized_pnl, coalesce(p.hv, 0) AS holdings_value, coalesce(p.hv, 0) - coalesce(p.cost, 0) AS unrealized_pnl, coalesce(p.n, 0) AS open_positions,
       a.cash + coalesce(p.hv, 0) + coalesce(u.unsettled, 0) AS total_equity
FROM (SELECT portfolio_id, 1e8 - sum(cost + bfees) AS cash, sum(realized) AS realized FROM held GROUP BY 1) a
LEFT JOIN (SELECT h.portfolio_id, sum(h.qty * coalesce(q.last_price, h.cost / h.qty)) AS hv, sum(h.cost + h.bfees) AS cost, count(*) AS n
           FROM held h LEFT JOIN quoted q ON q.exchange = h.exchange AND q.symbol = h.symbol WHERE h.qty > 0 GROUP BY 1) p ON p.portfolio_id = a.portfolio_id
LEFT JOIN (SELECT portfolio_id, sum(amount) FILTER (settlement_date > DATE '2001-06-30') AS unsettled FROM settled WHERE side = 'SELL' GROUP BY 1) u ON u.portfolio_id = a.portfolio_id)""",
    "held quoted settled",
)
def _(m):
    held = ledger.holdings(m.ledger).withColumns({c: F.col(c).cast("double") for c in ("quantity", "purchase_cost", "fees_in_basis", "realized_pl")})
    accounts = held.groupBy("portfolio_id").agg(
        (F.lit(1e8) - F.sum(F.col("purchase_cost") + F.col("fees_in_basis"))).alias("cash"), F.sum("realized_pl").alias("realized_pnl"), F.lit(1e8).alias("initial_cash")
    )
    pos = held.filter(F.col("quantity") > 0).join(m.quoted.select(*KEY, F.col("last_price").alias("market_price")), KEY, "left")
    pos = pos.select("portfolio_id", "quantity", "market_price", (F.col("purchase_cost") / F.col("quantity")).alias("entry_price"), F.col("fees_in_basis").alias("entry_fee"))
    due = paper.cash_due(_settled(m).filter(F.col("side") == "SELL"), F.lit("2001-06-30").cast("date"))
    return paper.account_equity(accounts, pos, due.withColumn("unsettled_cash", F.col("unsettled_cash").cast("double")))


define(
    "fb", "closed",
    """
SELECT *, exit_date AS outcome_date, round_even((exitp / entry_price - 1) * 100, 4) AS gross_return_pct, round_even(net_pnl / cash_paid * 100, 4) AS net_return_pct, net_pnl > 0 AS profitable_after_costs,
       sessions_held AS holding_sessions, reason AS exit_reason, costs AS fees, CASE WHEN rsi_14 IS NULL THEN NULL ELSE 0.5 + abs(rsi_14 - 50) / 100 END AS confidence FROM closed""",
)


def _feedback(m):
    rsi = indicators(m.bars).select(*KEY, F.col("date").alias("signal_date"), (F.lit(0.5) + F.abs(F.col("rsi_14") - 50.0) / 100.0).alias("confidence"))
    return paper.feedback(_closed(m).join(rsi, [*KEY, "signal_date"], "left"))


@query(
    "pp_08_closed_trade_feedback",
    "exchange s, symbol s, signal_date d, outcome_date d, gross_return_pct f, net_return_pct f, profitable_after_costs b, holding_sessions i, exit_reason s", "SELECT * FROM fb", "fb",
)
def _(m):
    return _feedback(m)


@query(
    "agg_21_feedback_stats", "trades i, wins i, avg_net_return f, win_rate f",
    "SELECT count(*) AS trades, count(*) FILTER (profitable_after_costs) AS wins, avg(net_return_pct) AS avg_net_return, round_even(count(*) FILTER (profitable_after_costs) * 100.0::DOUBLE / count(*), 2) AS win_rate FROM fb",
    "fb",
)
def _(m):
    return paper.feedback_stats(_feedback(m))


@query(
    "agg_22_confidence_learning", "label s, trades i, win_rate f, average_net_return f, is_best b, ready_for_review b",
    """
SELECT *, coalesce(label = best, false) AS is_best, total >= 30 AND best IS NOT NULL AS ready_for_review FROM (
SELECT *, arg_max(label, (average_net_return, win_rate)) FILTER (trades >= 10) OVER () AS best, sum(trades) OVER () AS total FROM (
SELECT CASE WHEN confidence IS NULL THEN 'No confidence saved' WHEN confidence >= 0.8 THEN '80% and above' WHEN confidence >= 0.7 THEN '70%–79%' ELSE 'Below 70%' END AS label, count(*) AS trades,
  round_even(avg(CASE WHEN profitable_after_costs THEN 100.0 ELSE 0.0 END), 1) AS win_rate, round_even(avg(net_return_pct), 2) AS average_net_return FROM fb GROUP BY 1))""",
    "fb",
)
def _(m):
    return paper.learning(_feedback(m))


@query(
    "agg_23_paper_evidence", "exchange s, completed_trades i, total_fees f, gross_return_sum_pct f, net_return_sum_pct f, max_drawdown_pct f, snapshot_count i, evidence_status s",
    """
SELECT f.*, c.max_drawdown_pct, c.snapshot_count, CASE WHEN completed_trades < 30 THEN 'Insufficient completed trades for review' ELSE 'Reviewable paper sample only — not proof of an edge' END AS evidence_status
FROM (SELECT exchange, count(*) AS completed_trades, round_even(sum(fees), 2) AS total_fees, round_even(sum(gross_return_pct), 2) AS gross_return_sum_pct, round_even(sum(net_return_pct), 2) AS net_return_sum_pct FROM fb GROUP BY exchange) f
JOIN (SELECT exchange, round_even(min(dd), 2) AS max_drawdown_pct, count(*) AS snapshot_count FROM curve GROUP BY exchange) c USING (exchange)""",
    "fb curve",
)
def _(m):
    return paper.evidence(_feedback(m), _curve(m))


@query(
    "top_05_ranked_entry_candidates", "exchange s, symbol s, probability f, confidence f, score f",
    """
SELECT n.* FROM newest n JOIN quality q ON q.exchange = n.exchange AND q.symbol = n.symbol AND NOT q.limited
ANTI JOIN (SELECT exchange AS he, symbol AS hs FROM ledger WHERE txn_date >= DATE '2001-07-20') ON he = n.exchange AND hs = n.symbol
WHERE action = 'BUY' AND confidence >= 0.0 AND probability >= 0.0 ORDER BY probability DESC, confidence DESC, score DESC, n.exchange, n.symbol LIMIT 10""",
    "newest quality ledger",
)
def _(m):
    recent = m.ledger.filter(F.col("txn_date") >= F.lit("2001-07-20").cast("date"))
    return paper.ranked_entries(
        screened(m), dq.stock_quality(m.stocks, m.bars), recent, None, 10, "three_day_book_rules", min_probability=0.0, min_confidence=0.0, require_safe=False
    )


# few securities that trade on most days, with prices in swings: some are regular enough to be bought
@query(
    "top_05_ranked_entries_in_swings", "exchange s, symbol s, probability f, confidence f, score f, is_safe_buy b",
    """
SELECT n.* FROM newest n JOIN quality q ON q.exchange = n.exchange AND q.symbol = n.symbol AND NOT q.limited
ANTI JOIN (SELECT exchange AS he, symbol AS hs FROM ledger WHERE txn_date >= DATE '2001-08-01') ON he = n.exchange AND hs = n.symbol
WHERE action = 'BUY' AND confidence >= 0.5 AND probability >= 0.3 ORDER BY score DESC, confidence DESC, n.exchange, n.symbol LIMIT 10""",
    "newest quality ledger", swinging_sql(0.2, 90.0, 12),
)
def _(m):
    recent = m.ledger.filter(F.col("txn_date") >= F.lit("2001-08-01").cast("date"))
    market = swinging(m, 0.2, 90.0, 12)
    return paper.ranked_entries(
        screened(market), dq.stock_quality(market.stocks, market.bars), recent, None, 10, "strict_research_v1", min_probability=0.3, min_confidence=0.5, require_safe=False
    )
