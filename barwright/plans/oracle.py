"""SQL text of the shared tables, used to compose each query's counterpart.

Each entry lists the tables it needs; `compose` emits them in order.
"""

from __future__ import annotations

TABLES: dict[str, tuple[str, str]] = {}


def define(name: str, needs: str, sql: str) -> None:
    TABLES[name] = (needs, sql)


def compose(names: str, body: str, picked: str, given: dict[str, tuple[str, str]] | None = None) -> str:
    """`given` replaces shared tables, and so all that is derived from them, in this text only."""
    tables = {**TABLES, **(given or {})}
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in tables[n][0].split():
            visit(dep)
        order.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS ({tables[n][1]})" for n in order]
    parts.append(f"result_rows AS ({body})")
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT {picked} FROM result_rows"


def _bars(price: str) -> str:
    return f"""
SELECT CASE WHEN k % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange, 'S' || k AS symbol, date,
       arg_min(p, seq) AS open, max(p) AS high, min(p) AS low, arg_max(p, seq) AS close,
       CAST(sum(q) AS BIGINT) AS volume, sum(x) AS value,
       CASE WHEN k % 29 = 5 THEN 'synthetic_fallback'
            WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'dse_live' ELSE 'cse_live' END
            WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'dse_history' ELSE 'cse_history' END
            ELSE 'unknown' END AS source,
       k % 29 = 5 AS is_synthetic,
       CASE WHEN k % 3 = 2 THEN 'unknown' ELSE 'raw' END AS adjustment_status,
       k % 7 AS batch_id
FROM (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, {price} AS p,
             l_orderkey * 65536 + l_linenumber AS seq, l_quantity AS q, l_extendedprice AS x
      FROM lineitem)
GROUP BY k, date"""


define("bars_raw", "", _bars("l_extendedprice / l_quantity"))
define("bars_all", "", _bars("100.0 + 2.0 * ln(l_extendedprice / l_quantity)"))
define("bars", "bars_all", "SELECT * FROM bars_all WHERE NOT is_synthetic")
define(
    "stocks",
    "",
    """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange, 'S' || s_suppkey AS symbol,
       s_name AS company_name, CASE WHEN s_suppkey % 25 = 24 THEN '' ELSE n_name END AS sector,
       (['A', 'B', 'G', 'N', 'Z'])[s_suppkey % 5 + 1] AS board, s_suppkey % 37 <> 3 AS is_active,
       CASE WHEN s_acctbal > 0 THEN s_acctbal / 250.0 END AS pe_ratio, s_acctbal / 100.0 AS eps
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
define(
    "quoted",
    "bars_all stocks",
    """
SELECT s.*, l.last_date, l.last_price, l.last_volume, l.last_is_synthetic,
       (l.last_price / l.prev - 1.0) * 100.0 AS last_change_pct
FROM stocks s LEFT JOIN (
  SELECT exchange, symbol, max(date) AS last_date, arg_max(close, date) AS last_price,
         arg_max(prev, date) AS prev, arg_max(volume, date) AS last_volume, arg_max(is_synthetic, date) AS last_is_synthetic
  FROM (SELECT *, lag(close) OVER (PARTITION BY exchange, symbol ORDER BY date) AS prev FROM bars_all)
  GROUP BY exchange, symbol) l USING (exchange, symbol)""",
)
define(
    "ledger",
    "",
    """
SELECT o_custkey % 20 AS portfolio_id, CASE WHEN l_suppkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange,
       'S' || l_suppkey AS symbol, (l_orderkey * 8 + l_linenumber) * 4096 + (CAST(l_shipdate AS DATE) - DATE '1995-01-01') AS txn_id,
       CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
       CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
       CAST(floor(l_extendedprice / l_quantity * 10000.0 + 0.5) / 10000.0 AS DECIMAL(14,4)) AS price,
       CAST(CAST(l_tax AS DECIMAL(6,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(12,4)) AS fees,
       CAST(o_orderdate AS DATE) AS txn_date,
       CAST(o_orderdate AS DATE) + to_minutes(CAST((l_orderkey * 7 + l_linenumber * 613) % 1440 AS INTEGER)) AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
define(
    "quotes",
    "",
    """
SELECT 'S' || (user_id % 40) AS symbol, ts, event_id, value AS ltp, value * 1.01 AS high, value * 0.99 AS low,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 0.995 END AS open, event_id % 1000 AS volume
FROM events""",
)
define(
    "task_runs",
    "",
    """
SELECT run_id, task_name, status, started_at,
       CASE WHEN status <> 'started' THEN started_at + to_seconds(CAST(trunc(value * 10) AS INTEGER)) END AS finished_at,
       CASE WHEN run_id % 3 = 0 THEN 'e' || run_id END AS embedded_error,
       CASE WHEN status = 'failure' THEN 'failed ' || run_id ELSE '' END AS error
FROM (SELECT event_id AS run_id, 'task_' || (user_id % 12) AS task_name, value, ts AS started_at,
             CASE WHEN event_type = 'error' OR user_id % 12 = 7 THEN 'failure' WHEN event_type = 'click' THEN 'partial'
                  WHEN event_type = 'signup' THEN 'skipped'
                  WHEN event_type = 'view' AND event_id % 50 = 0 THEN 'started' ELSE 'success' END AS status
      FROM events)""",
)
define(
    "tickets",
    "",
    """
SELECT 'FB-' || o_orderkey AS reference, status, category,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'normal' END AS reporter_priority,
       CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE '' END AS admin_priority,
       'Ticket ' || o_orderkey AS title,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '/p/' || (o_custkey % 23) END AS page_path,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)) END AS reviewed_at,
       CASE WHEN status = 'resolved' THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS resolved_at,
       CASE WHEN o_custkey % 2 = 0 THEN 'DSE' ELSE 'CSE' END AS exchange, 'S' || (o_custkey % 100) AS symbol
FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'in_progress' ELSE 'resolved' END AS status,
             (['bug', 'feature_request', 'data_issue', 'prediction_issue', 'other'])[o_orderkey % 5 + 1] AS category
      FROM orders)""",
)
define(
    "holidays",
    "",
    """
SELECT date, 'Quarter end ' || strftime(date, '%Y-%m') AS name
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
WHERE month(date) % 3 = 0 AND day(date) >= 28 AND dayofweek(date) NOT IN (5, 6)""",
)
W = "(PARTITION BY exchange, symbol ORDER BY date)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY exchange, symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling_mean(c: str, n: int, least: int) -> str:
    return f"CASE WHEN count({c}) {over(n)} >= {least} THEN avg({c}) {over(n)} END"


# Exponential averages by a recursive walk along each history.
_NUMBERED = f"""
SELECT *, row_number() OVER {W} AS rn, count(*) OVER (PARTITION BY exchange, symbol) AS n_rows,
       lag(close) OVER {W} AS prev_close
FROM {{src}}"""
_WALK = """
SELECT exchange, symbol, rn, close, close AS e12, close AS e26, 0.0::DOUBLE AS sig, NULL::DOUBLE AS ag, NULL::DOUBLE AS al
FROM {num} WHERE rn = 1
UNION ALL
SELECT b.exchange, b.symbol, b.rn, b.close, w.e12 + (b.close - w.e12) * (2.0/13), w.e26 + (b.close - w.e26) * (2.0/27),
       w.sig + (((w.e12 + (b.close - w.e12) * (2.0/13)) - (w.e26 + (b.close - w.e26) * (2.0/27))) - w.sig) * 0.2,
       CASE WHEN w.rn = 1 THEN greatest(b.close - w.close, 0) ELSE w.ag * (13.0/14) + greatest(b.close - w.close, 0) / 14 END,
       CASE WHEN w.rn = 1 THEN greatest(w.close - b.close, 0) ELSE w.al * (13.0/14) + greatest(w.close - b.close, 0) / 14 END
FROM {walk} w JOIN {num} b ON b.exchange = w.exchange AND b.symbol = w.symbol AND b.rn = w.rn + 1"""
_IND = f"""
SELECT i.* EXCLUDE (ret), i.ret AS return_1d,
       CASE WHEN count(ret) {over(20)} >= 20 THEN stddev_samp(ret) {over(20)} END * sqrt(252.0) AS volatility_20
FROM (
SELECT n.*, w.e12 AS ema_12, w.e26 AS ema_26, w.e12 - w.e26 AS macd, w.sig AS macd_signal, w.e12 - w.e26 - w.sig AS macd_hist,
       CASE WHEN n.rn >= 15 THEN CASE WHEN w.al = 0 THEN CASE WHEN w.ag > 0 THEN 100.0 ELSE 50.0 END
            ELSE 100.0 - 100.0 / (1.0 + w.ag / w.al) END END AS rsi_14,
       {rolling_mean('close', 20, 10)} AS sma_20, {rolling_mean('close', 50, 25)} AS sma_50,
       {rolling_mean('close', 200, 100)} AS sma_200, {rolling_mean('volume', 20, 10)} AS volume_sma_20,
       CASE WHEN count(close) {over(20)} >= 10 THEN stddev_samp(close) {over(20)} END AS bb_std,
       avg(greatest(high - low, abs(high - prev_close), abs(low - prev_close))) {over(14)} AS atr_14,
       min(low) {over(40)} AS support, max(high) {over(40)} AS resistance,
       close / lag(close) OVER {W} - 1 AS ret, close / lag(close, 2) OVER {W} - 1 AS return_2d,
       close / lag(close, 3) OVER {W} - 1 AS return_3d, close / lag(close, 5) OVER {W} - 1 AS return_5d,
       close / lag(close, 20) OVER {W} - 1 AS return_20d
FROM {{num}} n JOIN (SELECT exchange, symbol, rn, e12, e26, sig, ag, al FROM {{walk}}) w USING (exchange, symbol, rn)) i"""


def define_indicators(src: str, suffix: str = "") -> None:
    num, walk = f"numbered{suffix}", f"walk{suffix}"
    define(num, src, _NUMBERED.format(src=src))
    define(walk, num, _WALK.format(num=num, walk=walk))
    define(f"ind{suffix}", f"{num} {walk}", _IND.format(num=num, walk=walk))


define_indicators("bars")
