"""Holiday and corporate-event notices to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.expr import collapse_spaces
from barwright.operators.calendar import is_weekend

# Date cell forms and words that mark an extraordinary meeting
SINGLE_DAY = r"^(\d{1,2})\s+([A-Za-z]+)$"
SAME_MONTH = r"^(\d{1,2})\s*-\s*(\d{1,2})\s+([A-Za-z]+)$"
CROSS_MONTH = r"^(\d{1,2})\s+([A-Za-z]+)\s*-\s*(\d{1,2})\s+([A-Za-z]+)$"
EXTRAORDINARY_WORDS = ["egm", "extraordinary", "article"]
VENUE_PREFIX = r"(?i)^(venue\s*/\s*(mode|platform)|venue|mode of agm|mode)\s*:\s*"


def _day(year: Column, day: Column, month: Column) -> Column:
    text = F.concat_ws(" ", day, F.initcap(F.lower(month)), year.cast("string"))
    return F.try_to_timestamp(text, F.lit("d MMMM yyyy")).cast("date")


def _spans(notices: DataFrame) -> DataFrame:
    """ord, year, date_cell, cleaned name and the first and last day of each notice (null where unreadable)."""
    cell = collapse_spaces(F.col("date_cell"))
    part = lambda pattern, i: F.regexp_extract(cell, pattern, i)
    y = F.col("year")
    forms = [
        (SINGLE_DAY, _day(y, part(SINGLE_DAY, 1), part(SINGLE_DAY, 2)), _day(y, part(SINGLE_DAY, 1), part(SINGLE_DAY, 2))),
        (SAME_MONTH, _day(y, part(SAME_MONTH, 1), part(SAME_MONTH, 3)), _day(y, part(SAME_MONTH, 2), part(SAME_MONTH, 3))),
        (CROSS_MONTH, _day(y, part(CROSS_MONTH, 1), part(CROSS_MONTH, 2)), _day(y, part(CROSS_MONTH, 3), part(CROSS_MONTH, 4))),
    ]
    first = last = F.lit(None).cast("date")
    for pattern, a, b in reversed(forms):
        first = F.when(cell.rlike(pattern), a).otherwise(first)
        last = F.when(cell.rlike(pattern), b).otherwise(last)
    name = F.trim(F.regexp_replace(F.regexp_replace("name", r"\s*\(\*\)\s*$", ""), r"\*\s*$", ""))
    return notices.select("ord", "year", "date_cell", name.alias("name"), first.alias("a"), last.alias("b"))


def unreadable(notices: DataFrame) -> DataFrame:
    """Notices whose date cell gives no span of days; an import stops or reports on them."""
    return _spans(notices).filter(~F.coalesce(F.col("b") >= F.col("a"), F.lit(False))).select("ord", "year", "name", "date_cell")


def holiday_days(notices: DataFrame) -> DataFrame:
    """(year, ord, name, date_cell) rows to one row per weekday and its first name; see `unreadable` for the rest."""
    df = _spans(notices).filter(F.col("b") >= F.col("a"))
    days = df.select("ord", "name", F.explode(F.sequence("a", "b")).alias("date")).filter(~is_weekend(F.col("date")))
    return days.groupBy("date").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


def upsert_holidays(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Dates are added or renamed, never removed."""
    old = existing.select("date", F.col("name").alias("_old"))
    return old.join(fresh.select("date", F.col("name").alias("_new")), "date", "full_outer").select(
        "date", F.coalesce("_new", "_old").alias("name"),
        F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNotNull() & (F.col("_new") != F.col("_old")), "updated").otherwise("unchanged").alias("outcome"),
    )


def notice_date(c: Column) -> Column:
    """dd-Mon-yy, null for placeholder text."""
    return F.try_to_timestamp(F.regexp_replace(collapse_spaces(c), r"\.+$", ""), F.lit("d-MMM-yy")).cast("date")


def event_rows(notices: DataFrame) -> DataFrame:
    """One row per known date of a notice: the meeting and the record date."""
    low = F.lower(F.coalesce("purpose", F.lit("")))
    special = F.lit(False)
    for word in EXTRAORDINARY_WORDS:
        special = special | F.contains(low, F.lit(word))
    venue = F.regexp_replace(F.coalesce("venue", F.lit("")), VENUE_PREFIX, "")
    kind = F.when(special, "EGM").otherwise("AGM")
    label = F.coalesce(F.nullif(F.substring("purpose", 1, 160), F.lit("")), kind)
    row = lambda title, kind, day, details: F.struct(
        F.substring(title, 1, 240).alias("title"), kind.alias("event_type"), day.alias("event_date"), details.alias("details"), venue.alias("venue"),
        F.col("time").alias("event_time"),
    )
    meeting = row(F.concat(F.col("company"), F.lit(" — "), label), kind, notice_date(F.col("meeting_date")), F.lit(""))
    details = F.when(F.coalesce("purpose", F.lit("")) != "", F.concat(F.lit("Purpose: "), F.col("purpose"))).otherwise("")
    record = row(F.concat(F.col("company"), F.lit(" — Record date")), F.lit("RECORD_DATE"), notice_date(F.col("record_date")), details)
    rows = notices.select(F.explode(F.array(meeting, record)).alias("e")).select("e.*")
    return rows.filter(F.col("event_date").isNotNull())


def upsert_events(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest wording per (title, type, date); nothing is removed."""
    keys = ["title", "event_type", "event_date"]
    fresh = fresh.groupBy(*keys).agg(F.max(F.struct("details", "venue", "event_time")).alias("n"))
    old = existing.groupBy(*keys).agg(F.max(F.struct("details", "venue", "event_time")).alias("o"))
    outcome = F.when(F.col("o").isNull(), "created").when(F.col("n").isNotNull() & (F.col("n") != F.col("o")), "updated").otherwise("unchanged")
    j = old.join(fresh, keys, "full_outer").withColumns({"outcome": outcome, "r": F.coalesce("n", "o")})
    return j.select(*keys, "r.*", "outcome")
