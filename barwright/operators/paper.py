"""Paper-trading rules and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions import recurrence
from barwright.functions.rolling import KEY, history
from barwright.operators.calendar import with_nth_session

# Fixed values of the paper strategy
MIN_PROBABILITY, MIN_CONFIDENCE = 0.70, 0.70
STOP_LOSS_PCT, TAKE_PROFIT_PCT, MAX_SESSIONS, BREAKOUT_SESSIONS = 2.5, 4.5, 3, 20
FEE_PCT, SLIPPAGE_PCT = "0.35", "0.10"


def breakout(ind: DataFrame, lookback: int = BREAKOUT_SESSIONS) -> DataFrame:
    """Established uptrend breaking the prior closing high on normal volume."""
    w = history(recurrence.BLOCK, "date").rowsBetween(-lookback, -1)
    df = ind.withColumns({"prior_high": F.max("close").over(w), "_n": F.count("close").over(w)})
    c = F.col
    quiet = (F.coalesce(c("volume_sma_20"), F.lit(0.0)) != 0) & (c("volume") < c("volume_sma_20"))
    rule = (c("close") > c("sma_20")) & (c("sma_20") > c("sma_50")) & (c("_n") == lookback) & (c("close") > c("prior_high")) & ~quiet
    return df.withColumn("passes", F.coalesce(rule, F.lit(False))).drop("_n")


def strict_rule(with_prev: DataFrame, breadth: DataFrame, stocks: DataFrame, least_breadth: float = 0.55) -> DataFrame:
    """Oversold reversal with volume, vetoed by weak breadth; Z boards never pass."""
    c = F.col
    df = with_prev.join(breadth, ["exchange", "date"], "left").join(stocks.select(*KEY, "board"), KEY, "left")
    rule = (
        (c("board") != "Z")
        & (c("rsi_14") < 35)
        & (c("prev_macd") <= c("prev_macd_signal"))
        & (c("macd") > c("macd_signal"))
        & (c("volume") >= c("volume_sma_20") * 1.25)
        & (c("breadth_50") >= least_breadth)
    )
    return df.withColumn("passes", F.coalesce(rule, F.lit(False)))


def holding_sessions(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Sessions a security traded after each position's opening day.

    Bars are numbered per security (calendar-bounded); positions look up the
    number reached on their opening day instead of joining every bar.
    """
    w = Window.partitionBy(*KEY).orderBy("date")
    numbered = bars.select(*KEY, "date", F.row_number().over(w).alias("no"), F.lead("date").over(w).alias("nxt"))
    total = numbered.groupBy(*KEY).agg(F.max("no").alias("total"), F.min("date").alias("first"))
    # every day up to the next bar carries the same number
    days = numbered.filter(F.col("nxt").isNotNull()).select(
        *KEY, F.explode(F.sequence("date", F.date_sub("nxt", 1))).alias("opened_on"), "no"
    )
    df = positions.join(days, [*KEY, "opened_on"], "left").join(total, KEY, "left")
    reached = F.coalesce("no", F.when(F.col("opened_on") < F.col("first"), 0), F.col("total"))
    return df.withColumn("sessions", F.coalesce(F.col("total") - reached, F.lit(0))).drop("no", "total", "first")


def execution(df: DataFrame, market_price: str, side: str, quantity: str) -> DataFrame:
    """Execution price (4 dp) and fee (2 dp), both half up."""
    slip = F.lit(SLIPPAGE_PCT).cast("decimal(6,4)") / F.lit(100).cast("decimal(6,0)")
    mult = F.when(F.col(side) == "BUY", F.lit(1).cast("decimal(6,4)") + slip).otherwise(F.lit(1).cast("decimal(6,4)") - slip).cast("decimal(8,6)")
    price = F.round(F.col(market_price).cast("decimal(14,4)") * mult, 4)
    df = df.withColumn("execution_price", price)
    notional = F.col("execution_price") * F.col(quantity).cast("decimal(12,4)")
    fee = F.round(notional * F.lit("0.0035").cast("decimal(8,6)"), 2)
    return df.withColumns({"fee": fee, "notional": notional})


def settlement(trades: DataFrame, stocks: DataFrame, cal: DataFrame, by: str = "trade_date") -> DataFrame:
    """Third session after the trade for Z boards, second for all others."""
    n = F.when(F.col("board") == "Z", 3).otherwise(2)
    return with_nth_session(trades.join(stocks.select(*KEY, "board"), KEY, "left"), cal, by, n, "settlement_date")


def cash_due(settlements: DataFrame, as_of: Column) -> DataFrame:
    due = F.col("settlement_date") <= as_of
    return settlements.groupBy("portfolio_id").agg(
        F.sum(F.when(due, F.col("amount")).otherwise(0)).alias("settled_cash"),
        F.sum(F.when(due, F.lit(0)).otherwise(F.col("amount"))).alias("unsettled_cash"),
        F.count_if(due).alias("settlements_due"),
    )


def exit_decision(positions: DataFrame, as_of: Column) -> DataFrame:
    """Reason to close each open position, null to keep it.

    positions: market_price, entry_price, maturity_date, latest_action, sessions.
    """
    change = (F.col("market_price") / F.col("entry_price") - 1.0) * 100.0
    reason = (
        F.when(F.col("market_price").isNull() | (F.col("maturity_date") > as_of), F.lit(None).cast("string"))
        .when(F.col("latest_action") == "SELL", "sell_prediction")
        .when(change <= -STOP_LOSS_PCT, "stop_loss")
        .when(change >= TAKE_PROFIT_PCT, "take_profit")
        .when(F.col("sessions") >= MAX_SESSIONS, "holding_period")
    )
    return positions.withColumns({"change_pct": change, "exit_reason": reason})


def ranked_entries(
    analysis: DataFrame, quality: DataFrame, held: DataFrame, passed: DataFrame | None, slots: int, strategy: str,
    min_probability: float = MIN_PROBABILITY, min_confidence: float = MIN_CONFIDENCE, require_safe: bool = True,
) -> DataFrame:
    """Candidates for the free slots in the order of the chosen strategy."""
    from barwright.operators.screen import newest

    df = newest(analysis).filter((F.col("action") == "BUY") & (F.col("confidence") >= min_confidence) & (F.col("probability") >= min_probability))
    if require_safe:
        df = df.filter(F.col("is_safe_buy") & (F.col("risk_level") != "high"))
    df = df.join(held.select(*KEY).distinct(), KEY, "left_anti")
    df = df.join(quality.filter(~F.col("limited")).select(*KEY), KEY, "left_semi")
    if passed is not None:
        df = df.join(passed.select(*KEY), KEY, "left_semi")
    score, conf, prob = F.desc("score"), F.desc("confidence"), F.desc("probability")
    order = [score, conf] if strategy == "strict_research_v1" else [prob, conf, score]
    return df.orderBy(*order, *KEY).limit(slots)


def account_equity(accounts: DataFrame, positions: DataFrame, unsettled: DataFrame) -> DataFrame:
    """Equity statement per account. accounts: portfolio_id, initial_cash, cash, realized_pnl."""
    value = F.col("quantity") * F.coalesce("market_price", "entry_price")
    p = positions.groupBy("portfolio_id").agg(
        F.sum(value).alias("holdings_value"), F.sum(F.col("entry_price") * F.col("quantity") + F.col("entry_fee")).alias("cost"), F.count(F.lit(1)).alias("open_positions")
    )
    df = accounts.join(p, "portfolio_id", "left").join(unsettled.select("portfolio_id", "unsettled_cash"), "portfolio_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("cash") + zero("holdings_value") + zero("unsettled_cash")
    return df.select(
        "portfolio_id", "cash", zero("holdings_value").alias("holdings_value"), total.alias("total_equity"),
        (zero("holdings_value") - zero("cost")).alias("unrealized_pnl"), "realized_pnl", zero("open_positions").alias("open_positions"),
        F.bround((total / F.col("initial_cash") - 1.0) * 100.0, 2).alias("total_return_pct"),
    )


def feedback(closed: DataFrame) -> DataFrame:
    """Evidence row per closed trade."""
    return closed.select(
        *KEY, "signal_date", F.col("exit_date").alias("outcome_date"),
        F.bround((F.col("exit_price") / F.col("entry_price") - 1.0) * 100.0, 4).alias("gross_return_pct"),
        F.bround(F.col("net_pnl") / F.col("cash_paid") * 100.0, 4).alias("net_return_pct"), (F.col("net_pnl") > 0).alias("profitable_after_costs"),
        F.col("sessions_held").alias("holding_sessions"), F.col("reason").alias("exit_reason"), F.col("costs").alias("fees"),
        *[c for c in ("confidence",) if c in closed.columns],
    )


def feedback_stats(rows: DataFrame) -> DataFrame:
    wins = F.count_if("profitable_after_costs")
    return rows.agg(
        F.count(F.lit(1)).alias("trades"), wins.alias("wins"), F.avg("net_return_pct").alias("avg_net_return"),
        F.bround(F.try_divide(wins * 100.0, F.count(F.lit(1))), 2).alias("win_rate"),
    )


def confidence_bucket(c: Column) -> Column:
    return (
        # fixed values: texts a user sees
        F.when(c.isNull(), "No confidence saved").when(c >= 0.80, "80% and above").when(c >= 0.70, "70%–79%").otherwise("Below 70%")
    )


def learning(rows: DataFrame) -> DataFrame:
    """Results by confidence bucket; the best reliable one is marked."""
    g = rows.groupBy(confidence_bucket(F.col("confidence")).alias("label")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.bround(F.avg(F.when(F.col("profitable_after_costs"), 100.0).otherwise(0.0)), 1).alias("win_rate"),
        F.bround(F.avg("net_return_pct"), 2).alias("average_net_return"),
    )
    # four labels at most
    all_rows = Window.partitionBy(F.lit(0))
    total = F.sum("trades").over(all_rows)
    reliable = F.when(F.col("trades") >= 10, F.struct("average_net_return", "win_rate", "label"))
    best = F.max(reliable).over(all_rows)["label"]
    return g.withColumns({"is_best": F.coalesce(F.col("label") == best, F.lit(False)), "ready_for_review": (total >= 30) & best.isNotNull()})


def evidence(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fee and return sums with the deepest drawdown, per exchange.

    snapshots: exchange, date, equity - one row per calendar day.
    """
    w = Window.partitionBy("exchange").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    dd = snapshots.withColumn("dd", (F.col("equity") / F.max("equity").over(w) - 1.0) * 100.0).groupBy("exchange").agg(
        F.bround(F.min("dd"), 2).alias("max_drawdown_pct"), F.count(F.lit(1)).alias("snapshot_count")
    )
    sums = rows.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("completed_trades"), F.bround(F.sum("fees"), 2).alias("total_fees"),
        F.bround(F.sum("gross_return_pct"), 2).alias("gross_return_sum_pct"), F.bround(F.sum("net_return_pct"), 2).alias("net_return_sum_pct"),
    )
    # fixed values: texts a user sees
    status = F.when(F.col("completed_trades") < 30, "Insufficient completed trades for review").otherwise("Reviewable paper sample only — not proof of an edge")
    return sums.join(dd, "exchange", "left").withColumn("evidence_status", status)
