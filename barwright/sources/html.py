"""Row extraction from landed HTML pages.

Pages are a table (page_id, url, html); each page is parsed inside the task
that holds it.  The parser only turns tables into cell text, all typing and
filtering is done on columns afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.expr import parse_count, parse_number

TABLE_SCHEMA = "page_id long, tables array<struct<table_class:string,cells:array<array<string>>>>"
PART_CHARS = 1 << 20
LINK_SCHEMA = "page_id long, link_no int, href string, text string, tail string, in_table boolean"


class _Reader(HTMLParser):
    """Collects table cells and anchors of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[str]]]] = []
        self.links: list[list] = []
        self._open: list[int] = []
        self._cell: list[str] | None = None
        self._link: list | None = None
        self._tail: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "a") and self._tail is not None:
            self._tail = None
        if tag == "table":
            self.tables.append((dict(attrs).get("class") or "", []))
            self._open.append(len(self.tables) - 1)
        elif tag == "tr" and self._open:
            self.tables[self._open[-1]][1].append([])
        elif tag in ("td", "th") and self._open and self.tables[self._open[-1]][1]:
            self._cell = []
        elif tag == "a":
            self._link = [dict(attrs).get("href") or "", [], [], bool(self._open)]
            self.links.append(self._link)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self.tables[self._open[-1]][1][-1].append(" ".join(" ".join(self._cell).split()))
            self._cell = None
        elif tag == "table" and self._open:
            self._open.pop()
        elif tag == "a" and self._link is not None:
            self._tail, self._link = self._link, None
        elif self._tail is not None:
            self._tail = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)
        if self._link is not None:
            self._link[1].append(data)
        elif self._tail is not None:
            self._tail[2].append(data)


# rows of cells that hold text alone: no attribute, no nested tag, no character reference
PLAIN_ROWS = re.compile(r"(?:<tr>(?:<td>[^<&]*+</td>|<th>[^<&]*+</th>)*+</tr>)++")
CELL_ENDS = re.compile(r"</t[dh]><t[dh]>")


def _plain_rows(run: str) -> Iterator[list[str]]:
    spaced = len(run.split(None, 1)) > 1
    for row in run[4:-5].split("</tr><tr>"):
        cells = CELL_ENDS.split(row[4:-5]) if row else []
        yield [" ".join(c.split()) for c in cells] if spaced else cells


def _whole(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader


def _read(html: str | None) -> _Reader:
    """Tables and links of a page. Runs of plain rows, most of a quote page, are split at once where the parser stands
    between the rows of a table; a page where it stands elsewhere (a comment, script, cell or link) is parsed tag by tag."""
    html, reader, at = html or "", _Reader(), 0
    for run in PLAIN_ROWS.finditer(html):
        reader.feed(html[at : run.start()])
        if reader.rawdata or reader.cdata_elem is not None or not reader._open or any(x is not None for x in (reader._cell, reader._link, reader._tail)):
            return _whole(html)
        reader.tables[reader._open[-1]][1].extend(_plain_rows(run.group()))
        at = run.end()
    reader.feed(html[at:])
    reader.close()
    return reader


def page_parts(batch: pa.RecordBatch, least: int = PART_CHARS) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Pages of a batch in parts of about `least` characters, so that what a task holds does not grow with the batch."""
    ids, pages, at, held, n = batch.column("page_id"), batch.column("html"), 0, [], 0
    for i in range(batch.num_rows):
        held.append(pages[i].as_py())
        n += len(held[-1] or "")
        if n >= least:
            yield ids.slice(at, len(held)), held
            at, held, n = i + 1, [], 0
    if held:
        yield ids.slice(at, len(held)), held


def table_rows(pages: DataFrame) -> DataFrame:
    """Every row of every table on every page, as an array of cell texts, and the first rows of all the page's tables."""
    kind = pa.list_(pa.struct([("table_class", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in page_parts(batch):
                found = [[{"table_class": cls, "cells": trs} for cls, trs in _read(html).tables] for html in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["page_id", "tables"])

    read = pages.select("page_id", "html").mapInArrow(parse, TABLE_SCHEMA)
    first = lambda t, i: F.struct(i.alias("table_no"), t["table_class"].alias("table_class"), F.get(t["cells"], F.lit(0)).alias("cells"))
    heads = F.filter(F.transform("tables", first), lambda h: h["cells"].isNotNull())
    tables = read.withColumn("heads", heads).select("page_id", "heads", F.posexplode("tables").alias("table_no", "t"))
    return tables.select("page_id", "table_no", "t.table_class", "heads", F.posexplode("t.cells").alias("row_no", "cells"))


def links(pages: DataFrame) -> DataFrame:
    """Every anchor with its text and the text right behind it."""
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in page_parts(batch):
                rows = [
                    (page, i, href, " ".join("".join(text).split()), " ".join("".join(tail).split()), inside)
                    for page, html in zip(ids.to_pylist(), texts)
                    for i, (href, text, tail, inside) in enumerate(_read(html).links)
                ]
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "link_no", "href", "text", "tail", "in_table"])

    return pages.select("page_id", "html").mapInArrow(parse, LINK_SCHEMA)


def _chosen_table(rows: DataFrame, marker: str) -> DataFrame:
    """Rows of each page's shares table, or of the first table whose header has the marker."""

    def wish(h):
        marked = F.contains(F.upper(F.array_join(h["cells"], " ")), F.lit(marker))
        pref = F.when(F.contains(h["table_class"], F.lit("shares-table")), 0).when(marked, 1)
        return F.struct(pref.alias("pref"), h["table_no"].alias("table_no"), h["cells"].alias("header"))

    best = F.array_min(F.filter(F.transform("heads", wish), lambda w: w["pref"].isNotNull()))
    df = rows.filter(F.col("row_no") > 0).withColumn("_best", best)
    return df.filter(F.col("table_no") == F.col("_best.table_no")).withColumn("header", F.col("_best.header")).drop("_best", "heads")


def _at(i: int):
    return F.get("cells", F.lit(i))


def quote_rows(rows: DataFrame) -> DataFrame:
    """Quote table with eleven fixed columns."""
    df = _chosen_table(rows, "TRADING CODE").filter(F.size("cells") >= 10)
    code = F.upper(F.trim(_at(1)))
    return df.filter((code != "") & (code != "#")).select(
        "page_id", code.alias("symbol"), parse_number(_at(2)).alias("ltp"), parse_number(_at(3)).alias("high"),
        parse_number(_at(4)).alias("low"), parse_number(_at(5)).alias("close"), parse_number(_at(6)).alias("ycp"),
        parse_number(_at(7)).alias("change"), parse_count(_at(8)).alias("trades"), parse_number(_at(9)).alias("value"),
        parse_count(_at(10)).alias("volume"),
    )


def positional_quote_rows(rows: DataFrame) -> DataFrame:
    """Quote table read by position of its numeric cells."""
    code = F.upper(F.trim(F.when(F.coalesce(_at(1), F.lit("")) != "", _at(1)).otherwise(_at(0))))
    df = rows.filter((F.col("table_no") == 0) & (F.col("row_no") > 0) & (F.size("cells") >= 5)).withColumn("symbol", code)
    df = df.filter((F.col("symbol") != "") & (F.length("symbol") <= 20) & ~F.col("symbol").isin("SL.", "STOCK CODE"))
    nums = F.array_compact(F.transform(F.slice("cells", 3, F.size("cells")), lambda c: parse_number(c)))
    df = df.withColumn("n", nums).filter(F.size("n") > 0)
    n = lambda i, other: F.coalesce(F.get("n", F.lit(i)), other)
    ltp, last = F.get("n", F.lit(0)), F.element_at("n", -1)
    return df.select(
        "page_id", "symbol", ltp.alias("ltp"), n(2, ltp).alias("high"), n(3, ltp).alias("low"), n(4, ltp).alias("ycp"),
        n(5, F.lit(0.0)).alias("change"), F.when(last > 100, F.floor(last)).otherwise(0).cast("long").alias("volume"),
    )


def archive_rows(rows: DataFrame, start, end) -> DataFrame:
    """Day-end archive with columns found by header name, limited to a date range."""
    df = _chosen_table(rows, "CLOSEP").withColumn(
        "h", F.transform("header", lambda c: F.trim(F.regexp_replace(F.lower(c), r"\*", "")))
    )

    def cell(*names):
        spots = [F.nullif(F.array_position("h", n), F.lit(0).cast("long")) for n in names]
        return F.get("cells", F.coalesce(*spots).cast("int") - 1)

    day = cell("date")
    parsed = F.coalesce(F.try_to_timestamp(day, F.lit("dd-MMM-yyyy")), F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("date")
    close = parse_number(cell("closep", "close"))
    priced = lambda *names: F.coalesce(F.nullif(parse_number(cell(*names)), F.lit(0.0)), close)
    symbol = F.upper(cell("trading code"))
    return (
        df.select(
            "page_id", symbol.alias("symbol"), parsed.alias("date"), priced("openp", "open").alias("open"), priced("high").alias("high"),
            priced("low").alias("low"), close.alias("close"), parse_count(cell("volume")).alias("volume"),
            F.coalesce(parse_number(cell("value (mn)", "value")), F.lit(0.0)).alias("value"),
        )
        .filter(F.col("date").between(start, end) & F.col("close").isNotNull())
        .dropDuplicates(["page_id", "symbol", "date"])
    )


def pe_rows(rows: DataFrame) -> DataFrame:
    """Trailing P/E per code; unknown and non-positive values are dropped."""
    df = _chosen_table(rows, "TRADE CODE").filter(F.size("cells") >= 11)
    code, pe = F.upper(F.trim(_at(1))), parse_number(_at(10))
    return df.filter((code != "") & (code != "#") & (pe > 0)).select("page_id", code.alias("symbol"), pe.alias("pe_ratio"))


def sector_rows(pages: DataFrame) -> DataFrame:
    """(sector, code, company) from sector pages; the label comes from the page's own heading."""
    heading = F.trim(F.regexp_extract("html", r"(?i)Selected Industry\s*:\s*([^<\n]+)", 1))
    labels = pages.select("page_id", F.nullif(heading, F.lit("")).alias("sector"))
    found = links(pages).filter(F.col("in_table") & F.contains("href", F.lit("displayCompany.php")) & (F.col("text") != ""))
    name = F.trim(F.regexp_replace("tail", r"^[\s()]+|[\s()]+$", ""))
    return found.join(labels.filter(F.col("sector").isNotNull()), "page_id").select(
        "page_id", "sector", F.col("text").alias("symbol"), name.alias("company_name")
    )
