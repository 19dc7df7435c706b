"""Import, extraction and upsert queries (survey 2.1)."""

from pyspark.sql import functions as F

from barwright.functions.rolling import KEY
from barwright.operators import ledger
from barwright.plans.cat_ledger import _rows as holding_rows
from barwright.plans.oracle import define
from barwright.plans.registry import query
from barwright.sources import export, feeds, html, importers, notices, upsert

K = "exchange s, symbol s, date d"


def _day():
    return F.dayofmonth("date")


# A text feed with faults: the bars of one exchange printed as CSV fields.
define(
    "textfeed", "bars_raw",
    """
SELECT *, CASE WHEN day(date) = 3 THEN 'XX' || symbol ELSE ' ' || lower(symbol) END AS code, CASE WHEN day(date) = 5 THEN 'n/a' ELSE CAST(date AS VARCHAR) END AS dtext,
  CASE WHEN day(date) = 9 THEN 'abc' ELSE CAST(CAST(volume AS BIGINT) AS VARCHAR) END AS vtext, CASE WHEN day(date) = 12 THEN -close ELSE close END AS c2
FROM bars_raw""",
)


def text_feed(m):
    return m.bars_raw.select(
        F.when(_day() == 3, F.concat(F.lit("XX"), "symbol")).otherwise(F.concat(F.lit(" "), F.lower("symbol"))).alias("Trading_Code"),
        F.when(_day() == 5, "n/a").otherwise(F.col("date").cast("string")).alias("Date"),
        F.col("open").cast("string").alias("Open"), F.col("high").cast("string").alias("High"), F.col("low").cast("string").alias("Low"),
        F.when(_day() == 12, -F.col("close")).otherwise(F.col("close")).cast("string").alias("Close"),
        F.when(_day() == 9, "abc").otherwise(F.col("volume").cast("string")).alias("Volume"),
    )


define(
    "classified", "textfeed stocks",
    """
SELECT t.*, upper(trim(code)) AS sym, CASE WHEN dtext = 'n/a' OR NOT (date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') THEN 'out_of_range'
  WHEN s.symbol IS NULL THEN 'unknown_ticker' WHEN vtext = 'abc' OR least(open, high, low, c2) <= 0 THEN 'invalid' END AS reject_reason
FROM textfeed t LEFT JOIN (SELECT symbol FROM stocks WHERE exchange = 'DSE') s ON s.symbol = upper(trim(code))""",
)


def _classified(m):
    day = lambda s: F.lit(s).cast("date")
    return importers.classify_research(text_feed(m), m.stocks, day("1996-01-01"), day("2000-12-31"))


@query(
    "src_03_research_import_counters", "outcome s, rows i",
    "SELECT coalesce(reject_reason, 'eligible') AS outcome, count(*) AS rows FROM classified GROUP BY 1", "classified",
)
def _(m):
    return importers.import_counters(_classified(m))


@query(
    "src_03_research_import_rows", f"{K}, close f, volume i, source s, flags s",
    """
SELECT 'DSE' AS exchange, sym AS symbol, date, close, volume, 'dse_research_backfill' AS source,
       'external_research_backfill,unadjusted_prices,traded_value_unavailable' AS flags
FROM classified WHERE reject_reason IS NULL AND NOT (year(date) = 1998)""",
    "classified",
)
def _(m):
    on_record = m.bars_raw.filter(F.year("date") == 1998)
    return importers.research_bars(_classified(m), on_record, 1).withColumn("flags", F.array_join("quality_flags", ","))


define(
    "bulk", "bars_raw",
    """
SELECT symbol, date, CASE WHEN day(date) = 4 THEN close ELSE open END AS open, high, low, close, CASE WHEN day(date) = 6 THEN 0 ELSE volume END AS volume, value
FROM bars_raw WHERE exchange = 'CSE' AND day(date) <> 8""",
)


@query("src_04_bulk_feed", "symbol s, date d, open f, high f, low f, close f, volume i, value f", "SELECT * FROM bulk", "bulk")
def _(m):
    cse = m.bars_raw.filter(F.col("exchange") == "CSE")
    raw = cse.select(
        F.col("date").cast("string").alias("TRADE_DATE"), F.concat(F.lit(" "), F.lower("symbol")).alias("company_code"),
        F.when(_day() == 4, None).otherwise(F.col("open")).cast("string").alias("open_price"), F.col("high").cast("string").alias("day_high"),
        F.col("low").cast("string").alias("day_low"), F.when(_day() == 8, 0.0).otherwise(F.col("close")).cast("string").alias("close_price"),
        F.when(_day() == 6, "-").otherwise(F.col("volume").cast("string")).alias("volume"), F.col("value").cast("string").alias("turnover"),
    )
    return feeds.normalise(raw.unionByName(raw.filter(F.dayofmonth(F.col("TRADE_DATE").cast("date")) == 9)), feeds.BULK_HEADERS)


@query(
    "src_05_history_feed", "symbol s, date d, open f, high f, low f, close f, volume i, value f",
    "SELECT symbol, date, open, close AS high, close AS low, close, volume, 0 AS value FROM bars_raw WHERE exchange = 'DSE'", "bars_raw",
)
def _(m):
    dse = m.bars_raw.filter(F.col("exchange") == "DSE")
    raw = dse.select(F.col("date").alias("Date"), F.col("symbol").alias("Trading Code"), F.col("open").alias("OpenP"), F.col("close").alias("CloseP"), "volume")
    return feeds.normalise(raw, feeds.HISTORY_HEADERS, drop_unpriced=False)


@query(
    "src_06_merged_history", f"{K}, close f, feed s",
    """
SELECT exchange, symbol, date, CASE WHEN day(date) <= 20 THEN close ELSE close + 1 END AS close, CASE WHEN day(date) <= 20 THEN 'library' ELSE 'archive' END AS feed FROM bars_raw""",
    "bars_raw",
)
def _(m):
    library = m.bars_raw.filter(_day() <= 20).select(*KEY, "date", "close")
    archive = m.bars_raw.filter(_day() >= 15).select(*KEY, "date", (F.col("close") + 1).alias("close"))
    return feeds.merge_by_precedence([("library", library), ("archive", archive)], [*KEY, "date"])


def _td(*cells):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _page(rows, head, cls, *group):
    """Pages of at most fifty securities each, written from the bars."""
    body = F.array_join(F.array_sort(F.collect_list("row")), "")
    g = rows.groupBy(*group).agg(F.concat(F.lit(f"<html><body><table class='{cls}'>{head}"), body, F.lit("</table></body></html>")).alias("html"))
    return g.withColumn("page_id", F.xxhash64(*group))


def _two(c):
    return F.format_string("%.2f", F.floor(c * 100.0 + 0.5137) / 100.0)


_HEAD = "<tr><th>#</th><th>TRADING CODE</th><th>LTP</th><th>HIGH</th><th>LOW</th><th>CLOSEP*</th><th>YCP</th><th>CHANGE</th><th>TRADE</th><th>VALUE</th><th>VOLUME</th></tr>"
_R2 = "floor({0} * 100.0 + 0.5137) / 100.0"


def _shelf():
    return F.floor(F.substring("symbol", 2, 18).cast("long") / 50)


@query(
    "src_07_quote_pages", "symbol s, ltp f, high f, low f, close f, change f, trades i, value f, volume i",
    f"""
SELECT symbol, {_R2.format('close')} AS ltp, {_R2.format('high')} AS high, {_R2.format('low')} AS low, {_R2.format('close')} AS close,
       CASE WHEN day(date) = 2 THEN NULL ELSE 1.5 END AS change, 1200 AS trades, {_R2.format('value')} AS value, volume
FROM bars""",
    "bars",
)
def _(m):
    b = m.bars
    rows = b.select(
        "date", _shelf().alias("shelf"),
        _td(F.lit("1"), F.lower("symbol"), _two(F.col("close")), _two(F.col("high")), _two(F.col("low")), _two(F.col("close")), F.lit("N/A"),
            F.when(_day() == 2, "-").otherwise("1.5"), F.lit("1,200"), _two(F.col("value")), F.col("volume").cast("string")).alias("row"),
    )
    pages = _page(rows, _HEAD, "table shares-table", "date", "shelf")
    return html.quote_rows(html.table_rows(pages))


@query(
    "src_07_positional_quotes", "symbol s, ltp f, high f, low f, ycp f, change f, volume i",
    f"""
SELECT symbol, {_R2.format('close')} AS ltp, {_R2.format('high')} AS high, {_R2.format('low')} AS low, {_R2.format('open')} AS ycp, 0.9 AS change,
       CASE WHEN volume > 100 THEN volume ELSE 0 END AS volume FROM bars""",
    "bars",
)
def _(m):
    b = m.bars
    c = F.col
    rows = b.select(
        "date", _shelf().alias("shelf"),
        _td(F.lit("1"), c("symbol"), _two(c("close")), F.lit("1.20"), _two(c("high")), _two(c("low")), _two(c("open")), F.lit("0.90"), c("volume").cast("string")).alias("row"),
    )
    head = "<tr><th>SL.</th><th>Stock Code</th><th>LTP</th><th>Change%</th><th>High</th><th>Low</th><th>YCP</th><th>Change</th><th>Volume</th></tr>"
    return html.positional_quote_rows(html.table_rows(_page(rows, head, "", "date", "shelf")))


@query(
    "src_07_page_links", "page_id i, link_no i, href s, text s",
    None,
)
def _(m):
    return html.links(m.table("pages"))


@query(
    "src_07_page_link_targets", "page_id i, link_no i, href s",
    """
SELECT page_id, generate_subscripts(h, 1) - 1 AS link_no, replace(unnest(h), '&amp;', '&') AS href
FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages)""",
)
def _(m):
    return html.links(m.table("pages"))


@query(
    "src_08_archive_pages", "symbol s, date d, open f, high f, low f, close f, volume i",
    f"""
SELECT symbol, date, CASE WHEN day(date) = 3 THEN {_R2.format('close')} ELSE {_R2.format('open')} END AS open, {_R2.format('high')} AS high, {_R2.format('low')} AS low,
       {_R2.format('close')} AS close, volume FROM bars WHERE exchange = 'DSE' AND date BETWEEN DATE '1997-03-01' AND DATE '1999-06-30'""",
    "bars",
)
def _(m):
    b = m.bars.filter(F.col("exchange") == "DSE")
    c = F.col
    rows = b.select(
        "symbol", F.year("date").alias("year"),
        _td(F.date_format("date", "dd-MMM-yyyy"), c("symbol"), F.when(_day() == 3, "-").otherwise(_two(c("open"))), _two(c("high")), _two(c("low")), _two(c("close")), c("volume").cast("string")).alias("row"),
    )
    head = "<tr><th>DATE</th><th>TRADING CODE</th><th>OPENP*</th><th>HIGH</th><th>LOW</th><th>CLOSEP*</th><th>VOLUME</th></tr>"
    day = lambda s: F.lit(s).cast("date")
    return html.archive_rows(html.table_rows(_page(rows, head, "shares-table", "symbol", "year")), day("1997-03-01"), day("1999-06-30"))


@query(
    "src_09_pe_enrichment", "exchange s, symbol s, pe_ratio f",
    f"SELECT exchange, symbol, CASE WHEN exchange = 'DSE' AND is_active AND eps > 0 THEN {_R2.format('(eps + 1)')} ELSE pe_ratio END AS pe_ratio FROM stocks", "stocks",
)
def _(m):
    s = m.stocks.filter(F.col("exchange") == "DSE")
    pe = F.when(F.col("eps") > 0, _two(F.col("eps") + 1.0)).otherwise("n/a")
    blank = [F.lit("n/a")] * 8
    rows = s.select(_shelf().alias("shelf"), _td(F.lit("1"), "symbol", *blank, pe).alias("row"))
    head = "<tr><th>#</th><th>Trade Code</th>" + "<th>x</th>" * 9 + "</tr>"
    found = html.pe_rows(html.table_rows(_page(rows, head, "", "shelf"))).withColumn("exchange", F.lit("DSE"))
    return feeds.enrich_stocks(m.stocks, found, ["pe_ratio"])


define(
    "notice_rows", "",
    """
SELECT o_orderkey AS ord, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS b, 'Holiday ' || (o_custkey % 50) AS name
FROM orders WHERE year(o_orderdate) = year(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER))""",
)


def notice_table(m):
    """Holiday notices in the three printed date forms, from order dates."""
    o = m.table("orders")
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 4).cast("int"))
    text = (
        F.when(a == b, F.date_format(a, "d MMMM"))
        .when(F.month(a) == F.month(b), F.concat(F.date_format(a, "d"), F.lit(" - "), F.date_format(b, "d MMMM")))
        .otherwise(F.concat(F.date_format(a, "d MMMM"), F.lit("-"), F.date_format(b, "d MMMM")))
    )
    return o.filter(F.year(a) == F.year(b)).select(
        F.col("o_orderkey").alias("ord"), F.year(a).alias("year"), F.concat(F.lit("Holiday "), (F.col("o_custkey") % 50).cast("string"), F.lit(" (*)")).alias("name"), text.alias("date_cell")
    )


@query(
    "src_10_holiday_notices", "date d, name s, outcome s",
    """
SELECT coalesce(f.date, h.date) AS date, coalesce(f.name, h.name) AS name,
  CASE WHEN h.date IS NULL THEN 'created' WHEN f.name IS NOT NULL AND f.name <> h.name THEN 'updated' ELSE 'unchanged' END AS outcome
FROM (SELECT date, arg_min(name, ord) AS name FROM (SELECT ord, name, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM notice_rows)
      WHERE dayofweek(date) NOT IN (5, 6) GROUP BY date) f FULL JOIN holidays h ON h.date = f.date""",
    "notice_rows holidays",
)
def _(m):
    return notices.upsert_holidays(m.holidays, notices.holiday_days(notice_table(m)))


@query(
    "src_10_unreadable_notices", "ord i, name s, date_cell s",
    "SELECT ord, name, CASE WHEN ord % 2 = 0 THEN 'to be announced' ELSE '31 February' END AS date_cell FROM notice_rows WHERE ord % 25 = 0", "notice_rows",
)
def _(m):
    n = notice_table(m)
    bad = F.when(F.col("ord") % 25 == 0, F.when(F.col("ord") % 2 == 0, "to be announced").otherwise("31 February")).otherwise(F.col("date_cell"))
    return notices.unreadable(n.withColumn("date_cell", bad))


@query(
    "src_11_sector_directory", "exchange s, symbol s, sector s, company_name s",
    "SELECT exchange, symbol, CASE WHEN exchange = 'DSE' AND sector <> '' THEN 'New ' || sector ELSE sector END AS sector, CASE WHEN exchange = 'DSE' AND sector <> '' THEN company_name || ' PLC' ELSE company_name END AS company_name FROM stocks",
    "stocks",
)
def _(m):
    return feeds.enrich_stocks(m.stocks, html.sector_rows(sector_pages(m)).withColumn("exchange", F.lit("DSE")), ["sector", "company_name"], only_active=False)


def sector_pages(m):
    s = m.stocks.filter((F.col("exchange") == "DSE") & (F.col("sector") != ""))
    extra = s.withColumn("symbol", F.concat(F.lit("Q"), "symbol")).filter(F.length("symbol") == 3)
    row = F.concat(F.lit("<tr><td><a href='displayCompany.php?name=x'>"), "symbol", F.lit("</a> ("), "company_name", F.lit(" PLC)</td></tr>"))
    rows = s.unionByName(extra).select("sector", F.floor(F.regexp_extract("symbol", r"(\d+)", 1).cast("long") / 50).alias("shelf"), row.alias("row"))
    body = F.array_join(F.array_sort(F.collect_list("row")), "")
    page = F.concat(F.lit("<html><h2>Selected Industry : New "), "sector", F.lit("</h2><table class='table-borderless'>"), body, F.lit("</table></html>"))
    return rows.groupBy("sector", "shelf").agg(page.alias("html")).withColumn("page_id", F.xxhash64("sector", "shelf"))


@query(
    "src_11_unmatched_codes", "exchange s, symbol s",
    "SELECT 'DSE' AS exchange, 'Q' || symbol AS symbol FROM stocks WHERE exchange = 'DSE' AND sector <> '' AND length(symbol) = 2", "stocks",
)
def _(m):
    return feeds.unmatched(html.sector_rows(sector_pages(m)).withColumn("exchange", F.lit("DSE")), m.stocks)


define(
    "event_src", "",
    """
SELECT o_orderkey AS k, 'Company ' || o_custkey AS company, CASE o_orderstatus WHEN 'O' THEN 'Annual accounts' WHEN 'P' THEN 'Extraordinary resolution' ELSE '' END AS purpose,
       CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 = 0 AS no_meeting, o_orderkey % 5 = 0 AS no_record FROM orders""",
)


def event_notices(m):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    purpose = F.when(F.col("o_orderstatus") == "O", "Annual accounts").when(F.col("o_orderstatus") == "P", "Extraordinary  resolution").otherwise("")
    shown = lambda c: F.date_format(c, "dd-MMM-yy")
    return m.table("orders").select(
        F.concat(F.lit("Company "), F.col("o_custkey").cast("string")).alias("company"), F.regexp_replace(purpose, r"\s+", " ").alias("purpose"),
        F.when(k % 3 == 0, "Will be notified later").otherwise(F.concat(F.lit(" "), shown(d), F.lit("."))).alias("meeting_date"),
        F.when(k % 5 == 0, "-").otherwise(shown(F.date_sub(d, 20))).alias("record_date"),
        F.concat(F.lit("Venue/Mode : Hall "), (k % 9).cast("string")).alias("venue"), F.lit("10:00").alias("time"),
    )


# two-digit years are read as 20yy, so 1995 becomes 2095 on both sides
@query(
    "src_12_corporate_events", "title s, event_type s, event_date d, details s, venue s",
    """
WITH e AS (
SELECT company || ' — ' || CASE WHEN purpose = '' THEN 'AGM' ELSE purpose END AS title, CASE WHEN lower(purpose) LIKE '%extraordinary%' THEN 'EGM' ELSE 'AGM' END AS event_type,
       d AS event_date, '' AS details, 'Hall ' || (k % 9) AS venue FROM event_src WHERE NOT no_meeting
UNION ALL
SELECT company || ' — Record date', 'RECORD_DATE', d - 20, CASE WHEN purpose = '' THEN '' ELSE 'Purpose: ' || purpose END, 'Hall ' || (k % 9) FROM event_src WHERE NOT no_record)
SELECT title, event_type, CASE WHEN year(event_date) < 2000 THEN event_date + INTERVAL 100 YEAR ELSE event_date END AS event_date, (max((details, venue))).details AS details, (max((details, venue))).venue AS venue
FROM (SELECT title, event_type, event_date, {'details': details, 'venue': venue} AS r, details, venue FROM e) GROUP BY title, event_type, e_date""".replace(
        "(max((details, venue))).details AS details, (max((details, venue))).venue AS venue", "max(r).details AS details, max(r).venue AS venue"
    ).replace("GROUP BY title, event_type, e_date", "GROUP BY title, event_type, event_date"),
    "event_src",
)
def _(m):
    fresh = notices.event_rows(event_notices(m))
    nothing = fresh.limit(0)
    return notices.upsert_events(nothing, fresh)


@query(
    "src_13_safe_number", "event_id i, number f",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 1000 END AS number FROM events",
)
def _(m):
    e = m.table("events")
    text = F.when(F.col("event_id") % 14 == 0, "N/A").when(F.col("event_id") % 7 == 0, " - ").otherwise(F.format_number(F.col("value") * 1000.0, 2))
    return importers.safe_number(e.select("event_id", text.alias("shown")), "shown")


@query(
    "src_14_broker_ledger_errors", "error s, rows i",
    """
SELECT error, count(*) AS rows FROM (
SELECT CASE WHEN s.symbol IS NULL THEN 'not an available stock.' WHEN l.txn_id % 13 = 0 THEN 'quantity, price, fees, and target must be valid numbers.'
  WHEN l.txn_id % 11 = 0 THEN 'quantity must be positive; price, fees, and target cannot be negative.' WHEN l.txn_id % 17 = 0 THEN 'date must use YYYY-MM-DD.' ELSE 'valid' END AS error
FROM ledger l LEFT JOIN (SELECT exchange, symbol FROM stocks WHERE is_active) s ON s.exchange = l.exchange AND s.symbol = l.symbol) GROUP BY error""",
    "ledger stocks",
)
def _(m):
    return _broker(m).groupBy(F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "src_14_broker_commit", "portfolio_id i, rows i",
    """
SELECT portfolio_id, count(*) AS rows FROM ledger l JOIN stocks k ON k.exchange = l.exchange AND k.symbol = l.symbol AND k.is_active
ANTI JOIN (SELECT DISTINCT portfolio_id AS fp, symbol AS fs FROM ledger WHERE txn_id % 211 = 0) b ON b.fp = l.portfolio_id AND b.fs = l.symbol GROUP BY portfolio_id""",
    "ledger stocks",
)
def _(m):
    # each portfolio's rows of a security are a file of their own: it is taken whole or not at all
    rows = importers.committed(_broker(m, 211), ["portfolio_id", "symbol"])
    return rows.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("rows"))


def _broker(m, every=13):
    """Ledger rows as a broker's CSV would have them; quantities at every so many ids, and more at 13, are faulty."""
    t = F.col("txn_id")
    more = F.lit(every == 13)
    raw = m.ledger.select(
        "portfolio_id",
        F.lower("symbol").alias("Code"), F.lower("exchange").alias("Exchange"),
        F.when(t % every == 0, "many").otherwise(F.col("quantity").cast("string")).alias("Qty"),
        F.when(more & (t % 11 == 0), "-1").otherwise(F.col("price").cast("string")).alias("avg_buy"), F.col("fees").cast("string").alias("Charges"),
        F.when(more & (t % 17 == 0), F.date_format("txn_date", "dd/MM/yyyy")).otherwise(F.col("txn_date").cast("string")).alias("Date"), F.lower("side").alias("Side"),
    )
    return importers.classify_broker(raw, m.stocks, F.lit("2001-11-04").cast("date"))


@query(
    "src_15_holdings_export", "portfolio_id i, code s, exchange s, quantity f, average_buy f, current_price f, market_value f, gain_loss f, allocation_pct f",
    """
SELECT portfolio_id, symbol AS code, exchange, quantity, average_price AS average_buy, price AS current_price, market_value, unrealized_pl AS gain_loss,
       round(market_value / sum(market_value) OVER (PARTITION BY portfolio_id) * 100, 2) AS allocation_pct FROM holding""",
    "holding",
)
def _(m):
    rows = holding_rows(m)
    return export.holdings_export(rows, ledger.allocation(rows))


@query(
    "src_23_ticket_export", "reference_number s, category s, reporter_priority s, admin_priority s, status s, title s, created_at t, resolved_at t",
    "SELECT *, reference AS reference_number FROM tickets", "tickets",
)
def _(m):
    return export.ticket_export(m.tickets)


define(
    "daybars", "quotes",
    """
SELECT symbol, CAST(ts AS DATE) AS date, arg_min(coalesce(nullif(open, 0), ltp), (ts, event_id)) AS open, max(greatest(coalesce(high, ltp), ltp)) AS high,
  min(least(coalesce(low, ltp), ltp)) AS low, arg_max(ltp, (ts, event_id)) AS close, arg_max(volume, (ts, event_id)) AS volume, max(ts) AS fetched_at
FROM quotes WHERE ltp > 0 AND dayofweek(ts) NOT IN (5, 6) GROUP BY ALL""",
)


def day_bars(m):
    from barwright.operators.calendar import calendar, span_of

    c = calendar(span_of(m.quotes.select(F.to_date("ts")), slack=1), m.holidays)
    return upsert.quotes_to_bars(m.quotes, c)


@query("src_16_quotes_to_bars", "symbol s, date d, open f, high f, low f, close f, volume i, fetched_at t", "SELECT * FROM daybars", "daybars")
def _(m):
    return day_bars(m)


# live quotes over stored bars: every third day of a security is stored already, with another open, and some without one
define(
    "stored_live", "daybars",
    """
SELECT 'DSE' AS exchange, symbol, date, CASE WHEN day(date) % 2 = 0 THEN 0.0 ELSE open * 0.9 END AS open, high * 0.8 AS high, low * 1.2 AS low, close * 0.95 AS close, volume + 1 AS volume,
       0.0::DOUBLE AS value, 'dse_history' AS source FROM daybars WHERE day(date) % 3 = 0""",
)


def live_bars(m):
    return day_bars(m).select(F.lit("DSE").alias("exchange"), "symbol", "date", "open", "high", "low", "close", "volume", F.lit(0.0).alias("value"), F.lit("dse_live").alias("source"))


def stored_live(m):
    day = F.dayofmonth("date")
    return live_bars(m).filter(day % 3 == 0).select(
        *KEY, "date", F.when(day % 2 == 0, 0.0).otherwise(F.col("open") * 0.9).alias("open"), (F.col("high") * 0.8).alias("high"), (F.col("low") * 1.2).alias("low"),
        (F.col("close") * 0.95).alias("close"), (F.col("volume") + 1).alias("volume"), "value", F.lit("dse_history").alias("source"),
    )


@query(
    "src_16_live_upsert", f"{K}, open f, high f, low f, close f, volume i, source s",
    """
SELECT 'DSE' AS exchange, n.symbol, n.date, coalesce(nullif(o.open, 0), n.open) AS open, CASE WHEN o.date IS NULL THEN n.high ELSE greatest(o.high, n.high, n.close) END AS high,
  CASE WHEN o.date IS NULL THEN n.low ELSE least(o.low, n.low, n.close) END AS low, n.close, n.volume, 'dse_live' AS source
FROM daybars n LEFT JOIN stored_live o ON o.symbol = n.symbol AND o.date = n.date""",
    "daybars stored_live",
)
def _(m):
    return upsert.upsert_live(stored_live(m), live_bars(m))


@query(
    "src_16_quote_refresh", "symbol s, last_price f, last_volume i, last_date d",
    "SELECT symbol, arg_max(close, date) AS last_price, arg_max(volume, date) AS last_volume, max(date) AS last_date FROM daybars GROUP BY symbol", "daybars",
)
def _(m):
    return upsert.refreshed_quotes(m.quotes.select("symbol").distinct(), day_bars(m), ["symbol"])


define(
    "archive", "bars_raw",
    """
SELECT exchange, symbol, date, open * 1.01 AS open, high * 1.02 AS high, low * 0.98 AS low, CASE WHEN day(date) = 10 THEN close ELSE close * 1.005 END AS close,
       volume, value, CASE WHEN day(date) = 20 THEN 'synthetic_demo' ELSE 'dse_history' END AS source FROM bars_raw WHERE day(date) >= 10""",
)
define(
    "merged", "bars_raw archive",
    """
SELECT coalesce(o.exchange, n.exchange) AS exchange, coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.date, n.date) AS date, 
  CASE WHEN keepold THEN o.open WHEN today THEN coalesce(nullif(o.open, 0), n.open) ELSE n.open END AS open,
  CASE WHEN keepold THEN o.high WHEN today THEN greatest(o.high, n.high, o.close) ELSE n.high END AS high,
  CASE WHEN keepold THEN o.low WHEN today THEN least(o.low, n.low, o.close) ELSE n.low END AS low,
  CASE WHEN keepold OR today THEN o.close ELSE n.close END AS close, CASE WHEN keepold OR today THEN o.volume ELSE n.volume END AS volume,
  CASE WHEN keepold OR today THEN o.source ELSE n.source END AS source,
  CASE WHEN n.date IS NULL THEN 'kept' WHEN keepold THEN 'protected' WHEN o.date IS NULL THEN 'inserted' WHEN today THEN 'merged_today' ELSE 'replaced' END AS outcome
FROM (SELECT * FROM bars_raw WHERE day(date) <> 15) o FULL JOIN archive n ON o.exchange = n.exchange AND o.symbol = n.symbol AND o.date = n.date,
LATERAL (SELECT n.date IS NULL OR coalesce(n.source = 'synthetic_demo' AND o.source NOT IN ('unknown', 'synthetic_fallback'), false) AS keepold,
                coalesce(o.date = DATE '2001-10-12', false) AS today)""",
)


def _archive(m):
    c = F.col
    return m.bars_raw.filter(_day() >= 10).select(
        *KEY, "date", (c("open") * 1.01).alias("open"), (c("high") * 1.02).alias("high"), (c("low") * 0.98).alias("low"),
        F.when(_day() == 10, c("close")).otherwise(c("close") * 1.005).alias("close"), "volume", "value",
        F.when(_day() == 20, "synthetic_demo").otherwise("dse_history").alias("source"),
    )


def _merged(m):
    existing = m.bars_raw.filter(_day() != 15)
    return existing, upsert.merge_history(existing, _archive(m), F.lit("2001-10-12").cast("date"))


@query("src_17_history_merge", f"{K}, open f, high f, low f, close f, volume i, source s, outcome s", "SELECT * FROM merged", "merged")
def _(m):
    return _merged(m)[1]


@query(
    "src_18_revision_audit", f"{K}, previous_open f, previous_close f, previous_volume i, previous_source s, new_source s",
    """
SELECT o.exchange, o.symbol, o.date, o.open AS previous_open, o.close AS previous_close, o.volume AS previous_volume, o.source AS previous_source, n.source AS new_source
FROM bars_raw o JOIN merged n USING (exchange, symbol, date) WHERE day(o.date) <> 15 AND (abs(o.open - n.open) > 1e-9 OR abs(o.high - n.high) > 1e-9 OR abs(o.low - n.low) > 1e-9
  OR abs(o.close - n.close) > 1e-9 OR o.volume <> n.volume)""",
    "bars_raw merged",
)
def _(m):
    existing, merged = _merged(m)
    return upsert.revisions(existing, merged, "history_upsert")


@query("src_19_synthetic_guard", "source s, outcome s, rows i", "SELECT source, outcome, count(*) AS rows FROM merged GROUP BY ALL", "merged")
def _(m):
    return _merged(m)[1].groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "src_20_mirror_bars", f"{K}, open f, high f, low f, close f, volume i, is_synthetic b",
    """
SELECT 'CSE' AS exchange, symbol, DATE '2001-11-05' AS date, last_price * 0.998 AS open, last_price * 0.998 * 1.01 AS high, last_price * 0.998 * 0.99 AS low,
       last_price * 0.998 AS close, floor(last_volume * 0.3) AS volume, true AS is_synthetic FROM quoted WHERE exchange = 'DSE' AND last_price IS NOT NULL""",
    "quoted",
)
def _(m):
    return feeds.mirror_bars(m.quoted, F.lit("2001-11-05").cast("date"))


@query(
    "src_21_batch_accounting", "batch_id i, row_count i, stock_count i, first_date d, last_date d",
    "SELECT batch_id, count(*) AS row_count, count(DISTINCT (exchange, symbol)) AS stock_count, min(date) AS first_date, max(date) AS last_date FROM bars_raw GROUP BY batch_id", "bars_raw",
)
def _(m):
    return upsert.batch_accounting(m.bars_raw)
