"""Exact top-k by inner product: columnar branch and bound.

Vectors are quantised to integers. All rows are dealt into groups of bounded size, each held in vertical layout
(one row for each dimension, dimensions of most mass first); the stated queries stream past every group in blocks.
Scores grow one block of dimensions at a time. What the remaining dimensions can still add lies within the product
of the remaining masses (norms) of query and candidate, so candidates whose upper bound falls below the k-th best
lower bound are dropped and the rest are compacted. Each group hands on its own k best; the k best of those are
the answer. Nothing is approximate.

Defined results: rows without vec_id, null vectors, and vectors with null, NaN or infinite components take no part.
A shorter vector counts as filled up with zeros. Rows that repeat a query's vec_id are one query (the smallest
vector) and never its candidates; other repeated rows are candidates each. Scores have to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import partitions

K = 20
SCALE = 64
EVERY = 20
BLOCK = 16
GROUP_ROWS = 65_536
QUERY_BLOCK = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and integer components `v` of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite).select("vec_id", whole.alias("v"))


def matrix(rows: list) -> np.ndarray:
    """Vectors as columns."""
    wide = max((len(r) for r in rows), default=0)
    out = np.zeros((wide, len(rows)), np.int64)
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out


class Group:
    """Candidates in vertical layout with their remaining masses."""

    def __init__(self, ids: list, rows: list, block: int = BLOCK):
        self.ids, x = np.array(ids, np.int64), matrix(rows)
        self.wide = len(x)
        f = x.astype(np.float64)
        self.order = np.argsort(-(f * f).sum(1), kind="stable")
        x, f = x[self.order], f[self.order]
        self.largest = np.abs(f).max(initial=0.0)
        self.cells = x
        self.floats = f if self.largest < 2**31 else None
        self.cuts = list(range(0, self.wide, block)) or [0]
        self.left = [np.sqrt((f[c:] ** 2).sum(0)) for c in self.cuts[1:]] + [np.zeros(len(ids))]

    def best(self, query_id: int, vector: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates' vec_id and score, ties to the smaller vec_id."""
        q = np.zeros(self.wide, np.int64)
        q[: min(self.wide, len(vector))] = vector[: self.wide]
        q = q[self.order]
        masses = q.astype(np.float64) ** 2
        exact = self.floats is not None and self.largest * np.abs(q).max(initial=0) * max(1, self.wide) < 2**53
        cells, row = (self.floats, q.astype(np.float64)) if exact else (self.cells, q)
        alive, score = np.flatnonzero(self.ids != query_id), None
        floor = -np.inf
        for cut, left in zip(self.cuts, self.left):
            part = slice(cut, cut + BLOCK)
            whole = len(alive) > 0.7 * len(self.ids)
            added = (row[part] @ cells[part])[alive] if whole else row[part] @ cells[part][:, alive]
            score = added if score is None else score + added
            if len(alive) <= k:
                continue
            rest = np.sqrt(masses[cut + BLOCK :].sum()) * left[alive] * (1 + 1e-9) + 1e-6
            floor = max(floor, np.partition(score - rest, -k)[-k])
            keep = score + rest >= floor
            alive, score = alive[keep], score[keep]
        if score is None:
            score = np.zeros(len(alive), np.int64)
        ids, score = self.ids[alive], score.astype(np.int64)
        top = np.lexsort((ids, -score))[:k]
        return ids[top], score[top]


def searched(k: int):
    """For mapInPandas over one group: candidates first, then queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, group = [], [], None
        for batch in batches:
            asks = batch["asks"].to_numpy(bool)
            own = batch[~asks]
            ids += own["vec_id"].tolist()
            rows += own["v"].tolist()
            if not asks.any() or not ids:
                continue
            group = group or Group(ids, rows)
            rows = []
            for at in range(0, int(asks.sum()), QUERY_BLOCK):
                some = batch[asks].iloc[at : at + QUERY_BLOCK]
                found = [(q, *group.best(q, np.asarray(v, np.int64), k)) for q, v in zip(some["vec_id"], some["v"])]
                yield pd.DataFrame({
                    "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
                    "vec_id": np.concatenate([f[1] for f in found]),
                    "score": np.concatenate([f[2] for f in found]),
                })

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of `vectors` for each of `queries` (both vec_id, v)."""
    groups = max(partitions(vectors.sparkSession), -(-vectors.count() // GROUP_ROWS))
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = one.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    held = vectors.select(dealt.alias("group"), F.lit(False).alias("asks"), "vec_id", "v")
    placed = held.unionByName(asked).repartitionById(groups, "group").sortWithinPartitions("asks")
    found = placed.select("asks", "vec_id", "v").mapInPandas(searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, folder: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors.filter(F.col("vec_id") % EVERY == 0), vectors)


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
