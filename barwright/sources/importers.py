"""CSV imports: research price history and broker ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import parse_number

RESEARCH_COLUMNS = ["Trading_Code", "Date", "Open", "High", "Low", "Close", "Volume"]


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text; typing happens in the rules."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def classify_research(raw: DataFrame, stocks: DataFrame, start: Column, end: Column, exchange: str = "DSE") -> DataFrame:
    """Typed rows with reject_reason: out_of_range, unknown_ticker, invalid or null."""
    require_columns(raw, RESEARCH_COLUMNS)
    known = stocks.filter(F.col("exchange") == exchange).select(F.upper("symbol").alias("symbol"), F.lit(True).alias("_known"))
    df = raw.select(
        F.upper(F.trim("Trading_Code")).alias("symbol"),
        F.expr("try_to_date(Date, 'yyyy-MM-dd')").alias("date"),
        *[F.col(c).try_cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.col("Volume").try_cast("double").cast("long").alias("volume"),
    ).join(known, "symbol", "left")
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    broken = (
        (F.least(o, h, l, c) <= 0) | (v < 0) | (h < F.greatest(o, c, l)) | (l > F.least(o, c, h))
        | o.isNull() | h.isNull() | l.isNull() | c.isNull() | v.isNull()
    )
    reason = (
        F.when(F.coalesce(~F.col("date").between(start, end), F.lit(True)), "out_of_range")
        .when(F.col("_known").isNull(), "unknown_ticker")
        .when(broken, "invalid")
    )
    return df.withColumns({"exchange": F.lit(exchange), "reject_reason": reason}).drop("_known")


def research_bars(classified: DataFrame, existing: DataFrame, batch_id: int) -> DataFrame:
    """Accepted rows whose (security, date) is not on record, ready to append."""
    keys = ["exchange", "symbol", "date"]
    new = classified.filter(F.col("reject_reason").isNull()).dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return new.select(
        *keys, "open", "high", "low", "close", "volume", F.lit(0.0).alias("value"),
        F.lit("dse_research_backfill").alias("source"), F.lit(False).alias("is_synthetic"), F.lit("raw").alias("adjustment_status"),
        F.lit(batch_id).cast("long").alias("batch_id"), F.array(*map(F.lit, fixed.RESEARCH_FLAGS)).alias("quality_flags"),
    )


def import_counters(classified: DataFrame) -> DataFrame:
    """Rows per outcome; the same table serves as the dry-run report."""
    return classified.groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


# header names accepted for each ledger field, first non-empty wins
BROKER_ALIASES = {
    "code": ["code", "trading_code", "symbol"],
    "exchange": ["exchange"],
    "quantity": ["quantity", "qty"],
    "price": ["price_per_share", "price", "avg_buy", "average_price"],
    "fees": ["fees", "fee", "charges"],
    "target_price": ["target_price", "target"],
    "date": ["transaction_date", "date"],
    "type": ["transaction_type", "type", "side"],
    "notes": ["notes", "note"],
}


def _alias(df: DataFrame, names: list[str]) -> Column:
    have = {c.strip().lower(): c for c in df.columns}
    picked = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
    return F.coalesce(*picked) if picked else F.lit(None).cast("string")


def classify_broker(raw: DataFrame, stocks: DataFrame, today: Column) -> DataFrame:
    """Typed ledger rows with an error text, null when the row is valid."""
    t = {k: _alias(raw, v) for k, v in BROKER_ALIASES.items()}
    df = raw.select(
        F.upper(t["code"]).alias("symbol"),
        F.upper(F.coalesce(t["exchange"], F.lit("DSE"))).alias("exchange"),
        t["quantity"].alias("_q"), t["price"].alias("_p"), F.coalesce(t["fees"], F.lit("0")).alias("_f"),
        t["target_price"].alias("_t"), t["date"].alias("_d"),
        F.upper(F.coalesce(t["type"], F.lit("BUY"))).alias("side"), t["notes"].alias("notes"),
        *[c for c in ("portfolio_id", "line") if c in raw.columns],
    )
    listed = stocks.filter("is_active").select("exchange", F.upper("symbol").alias("symbol"), F.lit(True).alias("_listed"))
    df = df.join(listed, ["exchange", "symbol"], "left").withColumns(
        {
            "quantity": F.col("_q").try_cast("decimal(18,4)"),
            "price": F.col("_p").try_cast("decimal(14,4)"),
            "fees": F.col("_f").try_cast("decimal(12,4)"),
            "target_price": F.col("_t").try_cast("decimal(14,4)"),
            "txn_date": F.when(F.col("_d").isNull(), today).otherwise(F.expr("try_to_date(_d, 'yyyy-MM-dd')")),
        }
    )
    q, p, f, target = (F.col(c) for c in ("quantity", "price", "fees", "target_price"))
    error = (
        # fixed values: texts a user sees
        F.when(F.coalesce("symbol", F.lit("")) == "", "code is required.")
        .when(~F.col("exchange").isin(fixed.EXCHANGES), "exchange must be DSE or CSE.")
        .when(F.col("_listed").isNull(), "not an available stock.")
        .when(q.isNull() | p.isNull() | f.isNull() | (F.col("_t").isNotNull() & target.isNull()), "quantity, price, fees, and target must be valid numbers.")
        .when((q <= 0) | (p < 0) | (f < 0) | (target < 0), "quantity must be positive; price, fees, and target cannot be negative.")
        .when(F.col("txn_date").isNull(), "date must use YYYY-MM-DD.")
        .when(~F.col("side").isin("BUY", "SELL"), "type must be BUY or SELL.")
        .when(q != F.floor(q), "DSE/CSE shares must be a whole number.")
    )
    return df.withColumn("error", error).drop("_q", "_p", "_f", "_t", "_d", "_listed")


def committed(classified: DataFrame, file: list[str] | None = None) -> DataFrame:
    """All rows of a file when none has an error, otherwise none; without `file` columns all rows are one file."""
    if not file:
        return classified.filter(classified.select(F.count("error")).scalar() == 0)
    faulty = classified.filter(F.col("error").isNotNull()).select(*file).distinct()
    return classified.join(faulty, file, "left_anti")


def safe_number(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("number", parse_number(F.col(column)))
