"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barwright import fixed


def parse_number(c: Column) -> Column:
    """Number from feed text: commas dropped, placeholders become null."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")


def parse_count(c: Column) -> Column:
    """Whole number from feed text, 0 when unreadable."""
    return F.coalesce(parse_number(c).cast("long"), F.lit(0).cast("long"))


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (greatest/least would drop it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def ratio(a: Column, b: Column) -> Column:
    """a / b with null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def tick_price(c: Column, tick: float = 0.10) -> Column:
    """Price on the exchange's 0.10 grid, half-even at both steps."""
    return F.bround(F.bround(c / F.lit(tick)) * F.lit(tick), 2)


def peak_price(last: Column, expected_return_pct: Column) -> Column:
    return F.bround(last * (F.lit(1.0) + expected_return_pct / 100.0), 2)


def banded(c: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first bound that c reaches, bounds given from high to low."""
    out = None
    for low, label in bounds:
        out = F.when(c >= F.lit(low), label) if out is None else out.when(c >= F.lit(low), label)
    return out.otherwise(otherwise)


def confidence_label(c: Column) -> Column:
    return banded(clip(c, 0.0, 1.0), fixed.CONFIDENCE_BANDS, fixed.CONFIDENCE_FLOOR)


def evidence_label(n: Column) -> Column:
    return banded(n, fixed.EVIDENCE_BANDS, fixed.EVIDENCE_NONE)


def sentiment_score(adv: Column, dec: Column, unch: Column) -> Column:
    total = adv + dec + unch
    return F.coalesce(F.bround(ratio((adv - dec) * 100.0, total), 1), F.lit(0.0))


def sentiment_label(adv: Column, dec: Column, unch: Column) -> Column:
    score = sentiment_score(adv, dec, unch)
    out = F.when((adv + dec + unch) <= 0, F.lit("No data"))
    for ceiling, label in fixed.SENTIMENT_BOUNDS:
        out = out.when(score < F.lit(float(ceiling)), F.lit(label))
    return out


def schema_hash(columns: Column) -> Column:
    """First 16 hex digits of sha256 over the sorted, comma-joined names."""
    return F.substring(F.sha2(F.array_join(F.array_sort(columns), ","), 256), 1, 16)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def mask_middle(c: Column, keep: int = 3) -> Column:
    """Keep the ends of an identifier and star out what lies between."""
    n = F.length(c)
    return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(c, 1, keep), F.repeat(F.lit("*"), n - 2 * keep), c.substr(n - keep + 1, F.lit(keep)))
    )


def nested_get(json_col: Column, path: str) -> Column:
    return F.get_json_object(json_col, "$." + path)


def flags_overlap(flags: Column, excluded: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, excluded)))
