"""Row-frame windows over one security's history.

A security has at most one bar per calendar day, so a window partition is
bounded by the length of the calendar (about 250 rows a year) however large
the bar table grows: it is the number of securities that scales, and they
spread over tasks.  All windows below use one partition and order spec so
that a chain of them costs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["exchange", "symbol"]


def history(*order: str) -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(*(order or ("date",)))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def guarded(agg, c: Column, w: WindowSpec, n: int, least: int) -> Column:
    """Rolling aggregate over n rows, null until `least` non-null inputs are in frame."""
    frame = trailing(w, n)
    return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))


def mean(c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return guarded(F.avg, c, w, n, max(1, n // 2) if least is None else least)


def change(c: Column, w: WindowSpec, n: int = 1) -> Column:
    """Relative change over n rows, null where the base is missing or zero."""
    return F.try_divide(c, F.lag(c, n).over(w)) - 1.0


def ahead(c: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(F.lead(c, n).over(w), c) - 1.0
