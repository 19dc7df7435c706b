"""Headline timings: prints one JSON line.

Reads the tables at $BENCH_SF_DIR on local[$BENCH_CPUS]; every query runs to
completion into a no-op sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barwright.plans import CATALOG
from barwright.session import local_session

HEADLINE = [
    "dq_05_full_scan_totals",
    "agg_14_provenance_report",
    "win_04_macd",
    "win_05_bollinger",
    "win_10_volatility_regime",
    "win_16_relative_strength",
    "agg_01_index_and_breadth",
    "agg_04_rolling_beta",
    "prd_01_rule_score",
    "prd_09_stock_analysis",
    "top_04_best_per_sector",
    "jn_04_as_of_close",
    "pf_01_average_cost_replay",
    "pf_04_portfolio_summary",
    "bt_08_trade_metrics",
    "src_16_quotes_to_bars",
    "src_17_history_merge",
    "fc_05_global_bias",
    "fc_09_historical_replay",
    "ml_01_forward_return_panel",
    "rl_03_classifier_metrics",
    "rl_11_split_half_drift",
    "agg_17_task_health",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("barwright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's file and shuffle paths before timing anything
    CATALOG["src_21_batch_accounting"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
