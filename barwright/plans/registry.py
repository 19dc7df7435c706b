"""Registration of queries together with their ANSI SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.plans import oracle
from barwright.sources.adapters import Market


def _rounded(c, digits: int):
    """Round with the cut a little below one half, so that exact halves which differ in
    the last bit between two evaluation orders print alike."""
    scale = float(10**digits)
    x = c.cast("double")
    near = F.signum(x) * F.floor(F.abs(x) * scale + 0.5137) / scale
    return F.when(F.abs(x) < 1e12, near).otherwise(x) + 0.0


# one-letter column types of a result: how each side is cast and rounded
SPARK_CAST = {
    "s": lambda c: c.cast("string"),
    "i": lambda c: c.cast("long"),
    "b": lambda c: c.cast("boolean"),
    "d": lambda c: c.cast("date"),
    "t": lambda c: c.cast("timestamp_ntz"),
    "f": lambda c: _rounded(c, 6),
    "m": lambda c: _rounded(c, 2),
}
_SQL_ROUND = "sign(CAST({0} AS DOUBLE)) * floor(abs(CAST({0} AS DOUBLE)) * {1} + 0.5137) / {1} + 0.0"
SQL_CAST = {
    "s": "CAST({0} AS VARCHAR)",
    "i": "CAST({0} AS BIGINT)",
    "b": "CAST({0} AS BOOLEAN)",
    "d": "CAST({0} AS DATE)",
    "t": "CAST({0} AS TIMESTAMP)",
    "f": _SQL_ROUND.format("{0}", "1000000.0"),
    "m": _SQL_ROUND.format("{0}", "100.0"),
}


@dataclass(frozen=True)
class Query:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[[Market], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Market(spark, folder))
        return df.select(*[SPARK_CAST[t](F.col(c)).alias(c) for c, t in self.columns])


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, ctes: str = "", given: dict[str, tuple[str, str]] | None = None):
    """Decorator: register a Spark query; `columns` reads like "symbol s, close f"."""
    spec = [tuple(part.split()) for part in columns.split(",")]

    def wrap(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            picked = ", ".join(f"{SQL_CAST[t].format(c)} AS {c}" for c, t in spec)
            text = oracle.compose(ctes, sql, picked, given)
        CATALOG[name] = Query(name, spec, fn, text)
        return fn

    return wrap
