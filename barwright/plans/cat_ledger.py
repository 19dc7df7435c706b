"""Joins, calendar and portfolio queries (survey 2.3, 2.9, 2.12 calendar)."""

from pyspark.sql import functions as F

from barwright.functions.rolling import KEY
from barwright.operators import calendar as cal
from barwright.operators import context as ctx
from barwright.operators import features as feat
from barwright.operators import joins, ledger, listing, screen
from barwright.plans.oracle import define
from barwright.plans.registry import query

K = "exchange s, symbol s, date d"
P = "portfolio_id i, exchange s, symbol s"

# ------------------------------------------------------------------ calendar
define(
    "cal",
    "bars holidays",
    """
SELECT *, count(*) FILTER (is_session) OVER (ORDER BY date) AS session_no FROM (
SELECT date, closure, closure IS NULL AS is_session FROM (
SELECT d.date, CASE WHEN dayofweek(d.date) IN (5, 6) THEN 'Weekend' ELSE h.name END AS closure
FROM (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) + 400 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT date FROM bars UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders)) d
LEFT JOIN holidays h ON h.date = d.date))""",
)


def market_calendar(m):
    return cal.calendar(cal.span_of(m.bars.select("date"), m.table("orders").select(F.to_date("o_orderdate"))), m.holidays)


@query("cal_01_closure_reason", "date d, closure s, is_session b", "SELECT * FROM cal", "cal")
def _(m):
    return market_calendar(m)


@query(
    "cal_02_nth_session", "date d, next_session d, tenth_session d",
    """
SELECT c.date, a.date AS next_session, b.date AS tenth_session FROM cal c
JOIN cal a ON a.is_session AND a.session_no = c.session_no + 1 JOIN cal b ON b.is_session AND b.session_no = c.session_no + 10""",
    "cal",
)
def _(m):
    c = market_calendar(m)
    return cal.nth_session(c, 1, "next_session").join(cal.nth_session(c, 10, "tenth_session"), "date")


@query(
    "cal_03_session_status", "event_id i, is_open b, status s, next_event s, next_at t",
    """
SELECT event_id, is_open, CASE WHEN is_open THEN 'Open' WHEN closure IS NOT NULL THEN 'Closed — ' || closure ELSE 'Closed' END AS status,
  CASE WHEN is_open THEN 'closes' ELSE 'opens' END AS next_event,
  CASE WHEN is_open THEN CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE WHEN closure IS NULL AND mi < 600 THEN CAST(day AS TIMESTAMP) + INTERVAL 600 MINUTE
       ELSE CAST(nxt AS TIMESTAMP) + INTERVAL 600 MINUTE END AS next_at
FROM (SELECT event_id, day, mi, CASE WHEN dayofweek(day) IN (5, 6) THEN 'Weekend' END AS closure, dayofweek(day) NOT IN (5, 6) AND mi >= 600 AND mi < 870 AS is_open,
  day + CASE dayofweek(day) WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS nxt
FROM (SELECT event_id, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS mi FROM events))""",
)
def _(m):
    e = m.table("events").select("event_id", "ts")
    c = cal.calendar(cal.span_of(e.select(F.to_date("ts")), slack=30), m.holidays)
    return cal.session_status(e, c)


# ------------------------------------------------------------------ joins


@query(
    "jn_01_bar_to_stock", "sector s, board s, bars i, mean_close f",
    "SELECT sector, board, count(*) AS bars, avg(close) AS mean_close FROM bars JOIN stocks USING (exchange, symbol) GROUP BY ALL", "bars stocks",
)
def _(m):
    j = m.bars.join(m.stocks.select(*KEY, "sector", "board"), KEY)
    return j.groupBy("sector", "board").agg(F.count(F.lit(1)).alias("bars"), F.avg("close").alias("mean_close"))


@query("jn_02_context_join", f"{K}, index_ret_1d f, index_ret_20d f, sector_ret_1d f, breadth f", "SELECT * FROM feat", "feat")
def _(m):
    from barwright.functions.rolling import change, history

    w = history()
    c = F.col("close")
    bars = m.bars.select(*KEY, "date", *[change(c, w, n).alias(f"return_{n}d") for n in (1, 5, 20)])
    return feat.with_market(bars, ctx.daily_returns(m.bars, m.stocks), m.stocks)


@query(
    "jn_03_stock_index_pairs", f"{K}, ret f, index_ret_1d f",
    "SELECT r.*, c.index_ret_1d FROM rets r JOIN ctx c ON c.exchange = r.exchange AND c.date = r.date WHERE ret IS NOT NULL", "rets ctx",
)
def _(m):
    r = ctx.daily_returns(m.bars, m.stocks)
    return r.join(ctx.exchange_context(r), ["exchange", "date"]).filter(F.col("ret").isNotNull())


@query(
    "jn_04_as_of_close", f"{P}, txn_id i, txn_date d, as_of d, close f",
    "SELECT l.*, b.date AS as_of, b.close FROM ledger l ASOF LEFT JOIN bars b ON b.exchange = l.exchange AND b.symbol = l.symbol AND b.date <= l.txn_date",
    "ledger bars",
)
def _(m):
    return joins.as_of_join(m.ledger, m.bars.select(*KEY, F.col("date").alias("as_of"), "close"), "txn_date")


@query(
    "jn_05_next_session_fill", f"{P}, txn_id i, txn_date d, next_date d, next_open f",
    """
SELECT * REPLACE (CASE WHEN next_date <= txn_date + 30 THEN next_date END AS next_date), CASE WHEN next_date <= txn_date + 30 THEN open END AS next_open
FROM (SELECT l.*, b.date AS next_date, b.open FROM ledger l ASOF LEFT JOIN bars b ON b.exchange = l.exchange AND b.symbol = l.symbol AND b.date > l.txn_date)""",
    "ledger bars",
)
def _(m):
    return joins.next_bar(m.ledger, m.bars, "txn_date")


@query(
    "jn_06_exact_date_settlement", f"{P}, txn_id i, txn_date d, close f",
    "SELECT l.*, b.close FROM ledger l LEFT JOIN bars b ON b.exchange = l.exchange AND b.symbol = l.symbol AND b.date = l.txn_date", "ledger bars",
)
def _(m):
    return m.ledger.join(m.bars.select(*KEY, F.col("date").alias("txn_date"), "close"), [*KEY, "txn_date"], "left")


@query(
    "jn_07_append_new_keys", "exchange s, symbol s, rows_added i",
    """
SELECT exchange, symbol, count(*) AS rows_added FROM (SELECT DISTINCT exchange, symbol, txn_date FROM ledger) l
ANTI JOIN (SELECT exchange, symbol, date AS txn_date FROM bars_all) USING (exchange, symbol, txn_date) GROUP BY ALL""",
    "ledger bars_all",
)
def _(m):
    existing = m.bars_all.select(*KEY, F.col("date").alias("txn_date"))
    new = joins.append_new(existing, m.ledger.select(*KEY, "txn_date"), [*KEY, "txn_date"])
    return new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows_added"))


@query(
    "jn_08_not_traded_on_day", "exchange s, symbol s",
    "SELECT exchange, symbol FROM stocks ANTI JOIN (SELECT exchange, symbol FROM ledger WHERE txn_date = DATE '1998-07-01') USING (exchange, symbol)", "stocks ledger",
)
def _(m):
    traded = m.ledger.filter(F.col("txn_date") == F.lit("1998-07-01").cast("date")).select(*KEY).distinct()
    return m.stocks.select(*KEY).join(traded, KEY, "left_anti")


define(
    "liquid", "bars",
    "SELECT exchange, symbol, avg(volume) AS v FROM bars WHERE date BETWEEN DATE '2001-06-30' - 45 AND DATE '2001-06-30' GROUP BY ALL ORDER BY v DESC, exchange, symbol LIMIT 80",
)


@query(
    "jn_09_liquid_members", f"{K}, close f",
    """
SELECT * FROM bars SEMI JOIN liquid USING (exchange, symbol)""",
    "bars liquid",
)
def _(m):
    liquid = screen.liquid_universe(m.bars, F.lit("2001-06-30").cast("date"))
    return m.bars.join(liquid.select(*KEY), KEY, "left_semi")


@query(
    "jn_10_context_lookup_default", f"{P}, txn_id i, breadth f",
    "SELECT l.*, coalesce(c.breadth, 0.5) AS breadth FROM ledger l LEFT JOIN ctx c ON c.exchange = l.exchange AND c.date = l.txn_date", "ledger ctx",
)
def _(m):
    c = ctx.exchange_context(ctx.daily_returns(m.bars, m.stocks)).select("exchange", F.col("date").alias("txn_date"), "breadth")
    return m.ledger.join(c, ["exchange", "txn_date"], "left").withColumn("breadth", F.coalesce("breadth", F.lit(0.5)))


# ------------------------------------------------------------------ portfolio
# whole units throughout: quantities of 0.0001, money of 1e-10
define(
    "led_n", "ledger",
    """
SELECT *, CAST(quantity * 10000 AS HUGEINT) AS q, CAST(price * 10000 AS HUGEINT) AS p, CAST(fees * 10000 AS HUGEINT) * 1000000 AS f,
       row_number() OVER (PARTITION BY portfolio_id, exchange, symbol ORDER BY txn_date, created_at, txn_id) AS rn FROM ledger""",
)
define(
    "led_walk",
    "led_n",
    """
SELECT portfolio_id, exchange, symbol, 0::BIGINT AS rn, 0::BIGINT AS txn_id, true AS accepted, 0::HUGEINT AS before, 0::HUGEINT AS qty, 0::HUGEINT AS cost, 0::HUGEINT AS bfees,
       0::HUGEINT AS realized, 0::HUGEINT AS paid, 0::HUGEINT AS bought, 0::BIGINT AS skipped, NULL::BIGINT AS last_skipped
FROM led_n WHERE rn = 1
UNION ALL
SELECT portfolio_id, exchange, symbol, rn, txn_id, ok, qty, CASE WHEN NOT ok THEN qty WHEN buy THEN qty + q ELSE qty - q END,
       CASE WHEN NOT ok THEN cost WHEN buy THEN cost + q * p * 100 ELSE cost - gone END,
       CASE WHEN NOT ok THEN bfees WHEN buy THEN bfees + f ELSE bfees - fgone END,
       CASE WHEN ok AND NOT buy THEN realized + (q * p * 100 - f) - gone - fgone ELSE realized END,
       CASE WHEN ok THEN paid + f ELSE paid END, CASE WHEN buy THEN bought + q ELSE bought END,
       CASE WHEN ok THEN skipped ELSE skipped + 1 END, CASE WHEN ok THEN last_skipped ELSE txn_id END
FROM (SELECT w.* EXCLUDE (rn, txn_id, accepted, before), n.rn, n.txn_id, n.side = 'BUY' AS buy, n.side = 'BUY' OR n.q <= w.qty AS ok, n.q, n.p, n.f,
             CASE WHEN w.qty > 0 THEN (2 * w.cost * n.q + w.qty) // (2 * w.qty) ELSE 0 END AS gone,
             CASE WHEN w.qty > 0 THEN (2 * w.bfees * n.q + w.qty) // (2 * w.qty) ELSE 0 END AS fgone
      FROM led_walk w JOIN led_n n ON n.portfolio_id = w.portfolio_id AND n.exchange = w.exchange AND n.symbol = w.symbol AND n.rn = w.rn + 1)""",
)
define(
    "held", "led_walk",
    """
SELECT portfolio_id, exchange, symbol, rn, skipped, last_skipped, qty::DOUBLE / 1e4 AS qty, bought::DOUBLE / 1e4 AS bought, cost::DOUBLE / 1e10 AS cost, bfees::DOUBLE / 1e10 AS bfees,
       realized::DOUBLE / 1e10 AS realized, paid::DOUBLE / 1e10 AS paid, CAST(cost AS VARCHAR) AS cost_units, CAST(bfees AS VARCHAR) AS fee_units, CAST(realized AS VARCHAR) AS realized_units
FROM led_walk QUALIFY row_number() OVER (PARTITION BY portfolio_id, exchange, symbol ORDER BY rn DESC) = 1""",
)


_HELD_COLUMNS = (
    f"{P}, quantity f, purchase_cost f, fees_in_basis f, realized_pl f, total_fees_paid f, lifetime_buy_quantity f, transactions_considered i, skipped_sells i, last_skipped_txn i, "
    "cost_units s, fee_units s, realized_units s"
)
_HELD_SQL = "SELECT *, qty AS quantity, cost AS purchase_cost, bfees AS fees_in_basis, realized AS realized_pl, paid AS total_fees_paid, bought AS lifetime_buy_quantity, rn AS transactions_considered, skipped AS skipped_sells, last_skipped AS last_skipped_txn FROM held"


def _in_units(held):
    units = lambda c: (F.col(c) * 10_000_000_000).cast("decimal(38,0)").cast("string")  # noqa: E731  exact to the last digit
    return held.withColumns({"cost_units": units("purchase_cost"), "fee_units": units("fees_in_basis"), "realized_units": units("realized_pl")})


@query("pf_01_average_cost_replay", _HELD_COLUMNS, _HELD_SQL, "held")
def _(m):
    return _in_units(ledger.holdings(m.ledger))


@query("pf_01_replay_by_ranges", _HELD_COLUMNS, _HELD_SQL, "held")
def _(m):
    """Every position of more than forty rows the way very long ones go: by ranges of rows."""
    return _in_units(ledger.holdings(m.ledger, range_rows=40))


# quotes as of the end of the data, one minute after each security's last update
define(
    "status", "quoted",
    """
SELECT *, CASE WHEN last_price IS NULL THEN 'unavailable' WHEN exchange NOT IN ('DSE') THEN 'exchange_disabled' WHEN last_is_synthetic THEN 'synthetic'
  WHEN DATE '2001-11-04' - last_date > 4 THEN 'stale' WHEN DATE '2001-11-04' = last_date THEN 'live' ELSE 'delayed' END AS quote_status FROM quoted""",
)


def _quotes(m):
    q = m.quoted.withColumn("updated_at", F.col("last_date").cast("timestamp_ntz") + F.expr("INTERVAL '14' HOUR"))
    now = F.lit("2001-11-04 14:03:00").cast("timestamp_ntz")
    sessions = m.stocks.select("exchange").distinct().withColumn("is_open", F.lit(True))
    return ledger.quote_status(q, now, sessions, ["DSE"])


@query("pf_02_quote_status", "exchange s, symbol s, last_price f, quote_status s", "SELECT * FROM status", "status")
def _(m):
    return _quotes(m)


_UP = "sign({0}) * round(abs({0}) + 1e-7, 2)"
define(
    "prevclose", "bars_all",
    """
SELECT exchange, symbol, arg_max(close, date) AS previous_close FROM bars_all
WHERE NOT is_synthetic AND date >= DATE '2001-11-04' - 15 AND date < DATE '2001-11-04' GROUP BY ALL""",
)
define(
    "holding",
    "held status prevclose",
    f"""
SELECT *, market_value - cost_basis AS unrealized_pl, CASE WHEN cost_basis > 0 THEN round((market_value - cost_basis) / basis * 100, 2) END AS unrealized_pl_pct FROM (
SELECT h.portfolio_id, h.exchange, h.symbol, h.qty AS quantity, CASE WHEN coalesce(s.sector, '') = '' THEN 'Unclassified' ELSE s.sector END AS sector, s.quote_status,
  {_UP.format('s.last_price')} AS price, {_UP.format('(h.cost + h.bfees)')} AS cost_basis, round(h.cost / h.qty + 1e-8, 4) AS average_price, h.cost + h.bfees AS basis,
  {_UP.format(f"(({_UP.format('s.last_price')}) * h.qty)")} AS market_value,
  CASE WHEN s.quote_status <> 'exchange_disabled' AND p.previous_close > 0 THEN {_UP.format(f"((({_UP.format('s.last_price')}) - p.previous_close) * h.qty)")} END AS today_pl
FROM held h LEFT JOIN status s ON s.exchange = h.exchange AND s.symbol = h.symbol LEFT JOIN prevclose p ON p.exchange = h.exchange AND p.symbol = h.symbol WHERE h.qty > 0)""",
)


def _valued(m):
    held = ledger.holdings(m.ledger)
    quotes = _quotes(m).select(*KEY, "sector", "last_price", "quote_status")
    day = F.lit("2001-11-04").cast("date")
    recent = m.bars_all.filter(~F.col("is_synthetic") & (F.col("date") >= F.date_sub(day, 15)) & (F.col("date") < day))
    prev = recent.groupBy(*KEY).agg(F.max_by("close", "date").alias("previous_close"))
    return ledger.valued(held, quotes, prev)


def _rows(m):
    return _valued(m).filter(F.col("quantity") > 0)


@query(
    "pf_03_holding_rows",
    f"{P}, quantity f, average_price f, price f, market_value f, cost_basis f, unrealized_pl f, unrealized_pl_pct f, today_pl f, quote_status s",
    "SELECT * FROM holding", "holding",
)
def _(m):
    return _rows(m)


@query(
    "pf_04_portfolio_summary",
    "portfolio_id i, open_holdings i, total_cost_basis f, total_market_value f, total_unrealized_pl f, today_total_pl f, total_realized_pl f, best_holding s, worst_holding s",
    f"""
SELECT r.portfolio_id, o.* EXCLUDE (portfolio_id), {_UP.format('r.realized')} AS total_realized_pl FROM (SELECT portfolio_id, sum(realized) AS realized FROM held GROUP BY 1) r
LEFT JOIN (SELECT portfolio_id, count(*) AS open_holdings, sum(cost_basis) AS total_cost_basis, sum(market_value) AS total_market_value,
  sum(market_value - cost_basis) AS total_unrealized_pl, sum(today_pl) AS today_total_pl,
  arg_max(exchange || ':' || symbol, (unrealized_pl_pct, exchange || ':' || symbol)) AS best_holding,
  arg_max(exchange || ':' || symbol, (-unrealized_pl_pct, exchange || ':' || symbol)) AS worst_holding FROM holding GROUP BY 1) o ON o.portfolio_id = r.portfolio_id""",
    "held holding",
)
def _(m):
    return ledger.summary(_valued(m))


@query(
    "pf_04_allocation", "portfolio_id i, kind s, label s, value f, pct f",
    """
SELECT portfolio_id, kind, label, v AS value, round(v / total * 100, 2) AS pct FROM (
SELECT portfolio_id, kind, label, sum(market_value) AS v FROM (
  SELECT portfolio_id, market_value, unnest([{'kind': 'stock', 'label': exchange || ':' || symbol}, {'kind': 'exchange', 'label': exchange}, {'kind': 'sector', 'label': sector}], recursive := true) FROM holding
) GROUP BY ALL) JOIN (SELECT portfolio_id, sum(market_value) AS total FROM holding GROUP BY 1) USING (portfolio_id)""",
    "holding",
)
def _(m):
    return ledger.allocation(_rows(m))


@query(
    "pf_05_concentration_and_goal", "portfolio_id i, largest_position_pct f, limit_pct f, is_concentrated b, goal_progress_pct f",
    """
SELECT portfolio_id, lp AS largest_position_pct, limit_pct, lp > limit_pct AS is_concentrated, round_even(total / target * 100, 1) AS goal_progress_pct
FROM (SELECT portfolio_id, 1.0 + portfolio_id % 4 AS limit_pct, 100000.0 * (1 + portfolio_id) AS target, round(max(market_value) / sum(market_value) * 100, 2) AS lp, sum(market_value) AS total FROM holding GROUP BY 1)""",
    "holding",
)
def _(m):
    k = F.col("portfolio_id")
    goals = m.ledger.select(k).distinct().select(k, (F.lit(1.0) + k % 4).alias("limit_pct"), ((k + 1) * 100000.0).alias("target_value"))
    return ledger.concentration(_rows(m), goals)


@query(
    "pf_06_ledger_validation", f"{P}, txn_id i, held_before f, error s",
    """
SELECT w.portfolio_id, w.exchange, w.symbol, w.txn_id, w.before::DOUBLE / 1e4 AS held_before,
  CASE WHEN l.side = 'BUY' AND w.exchange <> 'DSE' THEN 'Exchange is disabled for purchases.' WHEN NOT w.accepted THEN 'Sell exceeds the quantity held.' END AS error
FROM led_walk w JOIN ledger l USING (portfolio_id, exchange, symbol, txn_id) WHERE w.rn > 0""",
    "led_walk ledger",
)
def _(m):
    return ledger.validate(m.ledger, ["DSE"])


@query(
    "pf_07_revalidated_positions", f"{P}, skipped_sells i, last_skipped_txn i",
    """
SELECT portfolio_id, exchange, symbol, skipped AS skipped_sells, last_skipped AS last_skipped_txn FROM held
SEMI JOIN (SELECT portfolio_id, exchange, symbol FROM ledger WHERE txn_date >= DATE '2001-06-01') USING (portfolio_id, exchange, symbol) WHERE skipped > 0""",
    "held ledger",
)
def _(m):
    return ledger.revalidate(m.ledger, m.ledger.filter(F.col("txn_date") >= F.lit("2001-06-01").cast("date")))
