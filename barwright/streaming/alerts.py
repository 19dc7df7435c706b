"""Personal alert rules evaluated over quotes and analyses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COOLDOWN = pd.Timedelta(hours=4)
OUTPUT = "rule_id long, ts timestamp, kind string, message string"
STATE = "last_signal string, last_triggered timestamp"


def triggered(rule_type: str, row, last_signal: str | None) -> tuple[str | None, str | None]:
    """(message or None, signal to remember) for one observation of a rule."""
    if rule_type == "target_price" and pd.notna(row.target_price) and pd.notna(row.price) and row.price >= row.target_price:
        return f"{row.symbol} reached {row.price:.2f} (target {row.target_price:.2f}).", last_signal
    if rule_type == "percent_move" and pd.notna(row.threshold_pct) and pd.notna(row.change_pct) and abs(row.change_pct) >= row.threshold_pct:
        return f"{row.symbol} moved {row.change_pct:+.2f}% (threshold {row.threshold_pct:.2f}%).", last_signal
    if rule_type == "signal_change" and row.action:
        if not last_signal:
            return None, row.action
        if row.action != last_signal:
            return f"{row.symbol} signal changed from {last_signal} to {row.action}.", row.action
    if rule_type == "confidence" and pd.notna(row.min_confidence) and pd.notna(row.confidence) and row.confidence * 100 >= row.min_confidence:
        return f"{row.symbol} confidence is {row.confidence * 100:.0f}% (threshold {row.min_confidence:.0f}%).", last_signal
    return None, last_signal


def _walk(rows: pd.DataFrame, last_signal: str | None, last_at) -> tuple[list[tuple], str | None, object]:
    fired = []
    for row in rows.sort_values(["ts", "seq"]).itertuples(index=False):
        if last_at is not None and not pd.isna(last_at) and row.ts - last_at < COOLDOWN:
            continue
        message, last_signal = triggered(row.rule_type, row, last_signal)
        if message:
            fired.append((row.rule_id, row.ts, row.rule_type, message))
            last_at = row.ts
    return fired, last_signal, last_at


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_signal, last_at = state.get if state.exists else (None, None)
    fired, last_signal, last_at = _walk(pd.concat(list(batches)), last_signal, last_at)
    state.update((last_signal, None if last_at is None or pd.isna(last_at) else last_at))
    if fired:
        yield pd.DataFrame(fired, columns=["rule_id", "ts", "kind", "message"])


def observations(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Active rules met with price and analysis facts of their security.

    facts: symbol, seq, ts, price, change_pct, action, confidence.
    """
    c = F.col
    # a fact that cannot fire a stateless rule is dropped before the exchange
    relevant = (
        F.when(c("rule_type") == "target_price", c("price") >= c("target_price"))
        .when(c("rule_type") == "percent_move", F.abs("change_pct") >= c("threshold_pct"))
        .when(c("rule_type") == "confidence", c("confidence") * 100 >= c("min_confidence"))
        .otherwise(F.lit(True))
    )
    return rules.filter("is_active").join(facts, "symbol").filter(relevant).select(
        "rule_id", "symbol", "rule_type", "target_price", "threshold_pct", "min_confidence", "seq", F.col("ts").cast("timestamp").alias("ts"),
        "price", "change_pct", "action", "confidence",
    )


def evaluate_stream(obs: DataFrame) -> DataFrame:
    return obs.groupBy("rule_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def evaluate_batch(obs: DataFrame) -> DataFrame:
    """The same walk over a bounded table, streaming through sorted partitions."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, signal, at = None, None, None
        for pdf in batches:
            fired = []
            for rule_id, rows in pdf.groupby("rule_id", sort=False):
                if rule_id != rule:
                    rule, signal, at = rule_id, None, None
                new, signal, at = _walk(rows, signal, at)
                fired += new
            yield pd.DataFrame(fired, columns=["rule_id", "ts", "kind", "message"])

    ordered = obs.repartition("rule_id").sortWithinPartitions("rule_id", "ts", "seq")
    return ordered.mapInPandas(walk, OUTPUT)
