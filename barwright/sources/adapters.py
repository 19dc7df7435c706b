"""Market tables derived from the supplied star-schema tables.

Securities are suppliers, trades are line items; the rules are stated in
README.md.  Every table is a lazy DataFrame over the whole input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exchange(k: Column) -> Column:
    return F.when(k % 2 == 0, F.lit("DSE")).otherwise(F.lit("CSE"))


def _symbol(k: Column) -> Column:
    return F.concat(F.lit("S"), k.cast("string"))


def _source(k: Column) -> Column:
    live = F.when(k % 2 == 0, F.lit("dse_live")).otherwise(F.lit("cse_live"))
    past = F.when(k % 2 == 0, F.lit("dse_history")).otherwise(F.lit("cse_history"))
    return (
        F.when(k % 29 == 5, F.lit("synthetic_fallback"))
        .when(k % 3 == 0, live)
        .when(k % 3 == 1, past)
        .otherwise(F.lit("unknown"))
    )


class Market:
    """The tables one query reads, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _bars(self, transform) -> DataFrame:
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("k"),
            F.to_date("l_shipdate").alias("date"),
            transform(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
            # order of trades within a day as one long, so the aggregation keeps
            # fixed-width buffers and stays a hash aggregate with map-side combine
            (F.col("l_orderkey") * 65536 + F.col("l_linenumber")).alias("seq"),
            "l_quantity",
            "l_extendedprice",
        )
        daily = li.groupBy("k", "date").agg(
            F.min_by("p", "seq").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "seq").alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
            F.sum("l_extendedprice").alias("value"),
        )
        k = F.col("k")
        return daily.select(
            _exchange(k).alias("exchange"),
            _symbol(k).alias("symbol"),
            "date",
            "open",
            "high",
            "low",
            "close",
            "volume",
            "value",
            _source(k).alias("source"),
            (k % 29 == 5).alias("is_synthetic"),
            F.when(k % 3 == 2, "unknown").otherwise("raw").alias("adjustment_status"),
            (k % 7).alias("batch_id"),
        )

    @cached_property
    def bars_raw(self) -> DataFrame:
        """Prices as traded: wild daily jumps, for the data-quality operators."""
        return self._bars(lambda p: p)

    @cached_property
    def bars_all(self) -> DataFrame:
        """Prices on a compressed scale with ordinary daily moves."""
        return self._bars(lambda p: F.lit(100.0) + F.lit(2.0) * F.log(p))

    @cached_property
    def bars(self) -> DataFrame:
        """Confirmed-synthetic rows removed, as every signal operator wants it."""
        return self.bars_all.filter(~F.col("is_synthetic"))

    @cached_property
    def stocks(self) -> DataFrame:
        s = self.table("supplier")
        n = self.table("nation").select("n_nationkey", "n_name")
        k = F.col("s_suppkey")
        return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
            _exchange(k).alias("exchange"),
            _symbol(k).alias("symbol"),
            F.col("s_name").alias("company_name"),
            F.when(k % 25 == 24, F.lit("")).otherwise(F.col("n_name")).alias("sector"),
            F.element_at(F.array(*map(F.lit, ["A", "B", "G", "N", "Z"])), (k % 5 + 1).cast("int")).alias("board"),
            (k % 37 != 3).alias("is_active"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 250.0).alias("pe_ratio"),
            (F.col("s_acctbal") / 100.0).alias("eps"),
        )

    @cached_property
    def quoted(self) -> DataFrame:
        """Stocks with last price, change and volume taken from their latest bars."""
        from barwright.functions.rolling import history

        w = history()
        # one row per security survives the pre-aggregation before the join
        last = (
            self.bars_all.withColumn("_prev", F.lag("close").over(w))
            .groupBy("exchange", "symbol")
            .agg(
                F.max("date").alias("last_date"),
                F.max_by("close", "date").alias("last_price"),
                F.max_by("_prev", "date").alias("_prev"),
                F.max_by("volume", "date").alias("last_volume"),
                F.max_by("is_synthetic", "date").alias("last_is_synthetic"),
            )
            .withColumn("last_change_pct", (F.try_divide("last_price", "_prev") - 1.0) * 100.0)
            .drop("_prev")
        )
        return self.stocks.join(last, ["exchange", "symbol"], "left")

    @cached_property
    def ledger(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        li = self.table("lineitem")
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        k = F.col("l_suppkey")
        price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000.0 + 0.5) / 10000.0).cast("decimal(14,4)")
        qty = F.col("l_quantity").cast("decimal(18,4)")
        return j.select(
            (F.col("o_custkey") % 20).alias("portfolio_id"),
            _exchange(k).alias("exchange"),
            _symbol(k).alias("symbol"),
            # line numbers repeat inside an order, so the ship day completes the id
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))).alias("txn_id"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            qty.alias("quantity"),
            price.alias("price"),
            F.round(F.col("l_tax").cast("decimal(6,2)") * F.col("l_extendedprice").cast("decimal(18,2)"), 4)
            .cast("decimal(12,4)")
            .alias("fees"),
            F.to_date("o_orderdate").alias("txn_date"),
            # a minute of the day by rule: the order of entry is not the order of ids
            F.timestamp_add("MINUTE", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 613) % 1440).cast("int"), F.to_date("o_orderdate").cast("timestamp_ntz")).alias("created_at"),
        )

    @cached_property
    def quotes(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("symbol"),
            "ts",
            "event_id",
            F.col("value").alias("ltp"),
            (F.col("value") * 1.01).alias("high"),
            (F.col("value") * 0.99).alias("low"),
            F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("value") * 0.995)
            .alias("open"),
            (F.col("event_id") % 1000).alias("volume"),
        )

    @cached_property
    def task_runs(self) -> DataFrame:
        e = self.table("events")
        kind = F.col("event_type")
        status = (
            F.when((kind == "error") | (F.col("user_id") % 12 == 7), "failure")  # task_7 never succeeds
            .when(kind == "click", "partial")
            .when(kind == "signup", "skipped")
            .when((kind == "view") & (F.col("event_id") % 50 == 0), "started")
            .otherwise("success")
        )
        seconds = (F.col("value") * 10).cast("int")
        return e.select(
            F.col("event_id").alias("run_id"),
            F.concat(F.lit("task_"), (F.col("user_id") % 12).cast("string")).alias("task_name"),
            status.alias("status"),
            F.col("ts").alias("started_at"),
            F.when(status != "started", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).alias(
                "finished_at"
            ),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"ok": false, "live": {"ok": false, "error": "e'), F.col("event_id").cast("string"), F.lit('"}}')))
            .otherwise(F.lit('{"ok": true}'))
            .alias("detail"),
            F.when(status == "failure", F.concat(F.lit("failed "), F.col("event_id").cast("string"))).otherwise("").alias("error"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved")
        pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
        return o.select(
            F.concat(F.lit("FB-"), k.cast("string")).alias("reference"),
            status.alias("status"),
            pick(["bug", "feature_request", "data_issue", "prediction_issue", "other"], 5).alias("category"),
            F.when(F.substring("o_orderpriority", 1, 1) == "1", "urgent").otherwise("normal").alias("reporter_priority"),
            F.when(k % 3 == 0, "high").otherwise("").alias("admin_priority"),
            F.concat(F.lit("Ticket "), k.cast("string")).alias("title"),
            F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("/p/"), (F.col("o_custkey") % 23).cast("string"))).alias("page_path"),
            F.col("o_orderdate").alias("created_at"),
            F.when(k % 4 != 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 72).cast("int"))).alias("reviewed_at"),
            F.when(status == "resolved", F.col("o_orderdate") + F.make_dt_interval((k % 30).cast("int"))).alias("resolved_at"),
            _exchange(F.col("o_custkey")).alias("exchange"),
            _symbol(F.col("o_custkey") % 100).alias("symbol"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        """Weekday order dates of the last week of each quarter stand in for notices."""
        d = F.to_date("o_orderdate")
        return (
            self.table("orders")
            .select(d.alias("date"))
            .filter((F.month("date") % 3 == 0) & (F.dayofmonth("date") >= 28) & ~F.dayofweek("date").isin(6, 7))
            .groupBy("date")
            .agg(F.concat(F.lit("Quarter end "), F.date_format(F.first("date"), "yyyy-MM")).alias("name"))
        )
