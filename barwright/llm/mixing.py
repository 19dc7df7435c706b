"""Mixing sources to target weights by capped water-filling.

Targets share the size of the whole corpus by weight; a source is clamped at `EPOCHS` times its own size and what
it leaves is dealt again by weight until none is above. A source's rate (target over size) gives every document
its whole repetitions; the fraction goes to documents in the order of a seeded hash until it is used up, so a
source misses its target by half of one document at most. Everything is DataFrame and SQL functions.

Defined results: a null text has size 0, a null source is a source of its own (last in order), a corpus without
words has targets of 0. Rows that repeat a doc_id share its place in the order and are counted one by one there;
rows equal in every column are interchangeable. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import global_rank, own_columns, stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20
DIGITS = 2  # hex digits of the hash that one step of the search for a source's last document settles
STEPS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("none"))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and place key of every document, stored."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(F.col("doc_id")).alias("key"))
    return stored(rows, "mix-sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target. Each round clamps in one aggregate over the table of sources and hands three
    numbers to the driver; the clamped set only grows, so the rounds end."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    sources = stored(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap")), "mix-weights")
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        one = sources.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if one["n"] == clamped or not one["open"] or not one["total"]:
            break
        clamped, level = one["n"], (one["total"] - one["capped"]) / one["open"]
    share = F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", F.when(share > F.col("cap"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, `whole` repetitions for all, and the place up to which documents
    get one more: all keys below or at `last`, and of key `edge` the first `edge_rows` rows.

    The search goes down the hash two digits at a time: sums by cell, the cell where the fraction runs out, then
    only the rows of that cell. No step gathers more than 256 cells of a source or one final cell of rows.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets(rows).withColumn("whole", whole.cast("int")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = stored(state.withColumn("prefix", F.lit("")), "mix-state")
    for step in range(1, STEPS + 1):
        open_ = state.select(F.col("source").alias("_source"), "prefix", "left")
        inside = rows.join(open_, rows["source"].eqNullSafe(open_["_source"]) & F.col("key").startswith(F.col("prefix")))
        cells = inside.groupBy("_source", "left", F.substring("key", 1, DIGITS * step).alias("cell")).agg(F.sum("size").alias("s"))
        before = Window.partitionBy("_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        run = cells.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).filter("before <= left and s > 0")
        edge = run.groupBy("_source").agg(F.max(F.struct("cell", "before")).alias("e"))
        state = stored(
            state.join(edge, state["source"].eqNullSafe(edge["_source"]), "left").select(
                "source", "source_size", "target", "whole", (F.col("left") - F.coalesce("e.before", F.lit(0))).alias("left"), F.coalesce("e.cell", F.lit("~")).alias("prefix")
            ),
            "mix-state",
        )
    open_ = state.select(F.col("source").alias("_source"), "prefix", "left")
    inside = rows.join(open_, rows["source"].eqNullSafe(open_["_source"]) & F.col("key").startswith(F.col("prefix")))
    by_key = Window.partitionBy("_source").orderBy("key", "size")
    before = F.coalesce(F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = inside.select("_source", "key", "left", "size", before.alias("before"), F.row_number().over(Window.partitionBy("_source", "key").orderBy("size")).alias("nth"))
    taken = taken.filter("before + size / 2.0 <= left")
    last = taken.groupBy("_source").agg(F.max(F.struct("key", "nth")).alias("e"))
    return stored(
        state.join(last, state["source"].eqNullSafe(last["_source"]), "left").select(
            "source", "source_size", "target", "whole", "prefix", F.col("e.key").alias("edge"), F.coalesce("e.nth", F.lit(0)).alias("edge_rows")
        ),
        "mix-plan",
    )


def mixed(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """rows (source, size, key, ...) with source_size, target and `reps`, the times each is taken."""
    p = plan_.withColumnRenamed("source", "_source")
    names = rows.columns
    out = rows.join(p, rows["source"].eqNullSafe(p["_source"]))
    below = (F.col("key") < F.col("prefix")) | F.coalesce(F.col("key") < F.col("edge"), F.lit(False))
    below = F.when(F.col("prefix") == "~", False).otherwise(below)
    single = out.filter(~F.coalesce(F.col("key") == F.col("edge"), F.lit(False))).withColumn("_more", below)
    ties = out.filter("key = edge")  # the rows of one doc_id of a source
    nth = F.row_number().over(Window.partitionBy("_source", "key").orderBy("size"))
    ties = ties.withColumn("_nth", nth).withColumn("_more", F.col("_nth") <= F.col("edge_rows")).drop("_nth")
    both = single.unionByName(ties)
    return both.select(*names, "source_size", "target", (F.col("whole") + F.col("_more").cast("int")).alias("reps"))


def op4_mix_sources(spark, folder: str) -> DataFrame:
    rows = sized(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text"))
    return mixed(rows, plan(rows)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total, CAST(sum(weight) AS DOUBLE) AS weights FROM s),
r AS (
  SELECT 0 AS i, total / weights AS level FROM t
  UNION ALL
  SELECT r.i + 1, CAST(any_value(t.total) - sum(CASE WHEN s.weight * r.level > {EPOCHS} * s.source_size THEN {EPOCHS} * s.source_size ELSE 0 END) AS DOUBLE)
    / CAST(sum(CASE WHEN s.weight * r.level > {EPOCHS} * s.source_size THEN 0 ELSE s.weight END) AS DOUBLE)
  FROM r, s, t WHERE r.i < 40 GROUP BY r.i, r.level
), f AS (
  SELECT source, source_size, CASE WHEN weight * level > {EPOCHS} * source_size THEN CAST({EPOCHS} * source_size AS DOUBLE) ELSE weight * level END AS target
  FROM s, r WHERE r.i = 40
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM f
), c AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS remains,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before + size / 2.0 <= remains THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


@own_columns
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: each document comes out as many times as the mix takes it, with its columns."""
    names = docs.columns
    made = plan(sized(docs.select("doc_id", "source", "text")))
    rows = docs.withColumns({"size": words(F.col("text")), "key": order_key(F.col("doc_id"))})
    return mixed(rows, made).filter("reps > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("reps")))).select(*names)
