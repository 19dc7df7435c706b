"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by path inside each host; a page is paired with the neighbour whose path shares more leading
segments, the two pages' text lines are aligned by their longest common subsequence, and shared lines are deleted.

A parser turns a page into lines (one for each block of text) and notes where each stands. Lines of menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, as their tags, roles and class
names say, never become text. A class or id is read by whole tokens, inside code not at all, and a form or a name of the
layout does not drop an element that holds an article or main part. Lines inside an `article` element stay even where both pages have them: pages of a
host repeat whole passages of article text, and deleting those would lose it. Differencing thus decides on lines
that no article element holds, in pages that have none, and is reported (`n_shared`) for all.

Defined results: a null or empty page has empty text; a null or odd URL has an empty host or path; a page is not
differenced against one that shares all of its lines (its copy). Rows that repeat a page_id are pages of their own.
Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import LOWEST, partitions, range_edges, range_of

PLAIN, MAIN, ARTICLE = "1", "2", "3"
WORDS = {"article": ARTICLE, "main": MAIN}
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea menu dialog object head title canvas audio video map".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|title|select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
ENDS_P = BLOCKS - {"html", "body", "option", "tbody", "thead", "tfoot", "tr", "li", "dt", "dd", "caption", "legend"}
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social comment comments commentlist reply replies respond disqus sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer header masthead toolbar related recommended recommendations copyright login signup search skip".split()
)
ARTICLE_JUNK = frozenset("ad ads advert advertisement comment comments reply replies related recommended sponsored".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-z/][^>]*\Z",
    re.S | re.I,
)
ATTR = re.compile(r"([a-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# whole class or id tokens: a junk name alone, or with words that only say where or how the part stands
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PLACES = frozenset("site main top bottom left right primary secondary global sticky fixed inner outer box block bar area section container wrapper list item items links link post entry slot unit image inline button buttons icons".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDER = re.compile(r"<(?:article|main)\b|<[^>]*\brole\s*=\s*[\"']?main\b", re.I)


def _named(value: str, names: frozenset) -> bool:
    """Whether a class or id has a token that is one of `names`, alone or only with other such words and places."""
    for token in value.split():
        parts = [p.lower() for p in PARTS.findall(token)]
        if any(p in names for p in parts) and all(p in JUNK_NAMES or p in PLACES or p.isdigit() for p in parts):
            return True
    return False


def _junk(tag: str, attrs: str) -> str:
    """Why an element is no text: "sure", "name" (a class, id or form, which may wrap a whole page) or empty."""
    if tag in DROPPED and tag != "form":
        return "sure"
    why = "name" if tag == "form" else ""
    if not attrs or tag in ("html", "body"):
        return why
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "sure"
    if found.get("role", "").lower() in JUNK_ROLES:
        return "sure"
    # ids of headings and inline elements are anchors named after what they head
    keys = ("class",) if tag in HEADINGS or tag not in BLOCKS else ("class", "id")
    values = [found.get(k, "") for k in keys]
    if any(_named(v, ARTICLE_JUNK) for v in values):
        return "sure"
    return "name" if tag not in WORDS and any(_named(v, JUNK_NAMES) for v in values) else why


class _Holders:
    """Which elements of a page hold an article or main part that is text, found in one pass over its tags."""

    def __init__(self, page: str):
        self.starts: list[int] = []  # where such parts start
        self.ends: dict[int, int] = {}  # where the element whose content starts at a place ends
        if not HOLDER.search(page):
            return
        open_ones: dict[str, list[int]] = {}
        for m in TOKEN.finditer(page):
            name = (m["tag"] or "").lower()
            if not name:
                continue
            if not m["end"]:
                open_ones.setdefault(name, []).append(m.end())
                if HOLDER.match(m[0]) and _junk(name, m["attrs"]) != "sure":
                    self.starts.append(m.start())
            elif open_ones.get(name):
                self.ends[open_ones[name].pop()] = m.start()

    def inside(self, at: int) -> bool:
        """Whether the element whose content starts at `at` holds one; an element without an end reaches to the last."""
        k = bisect_left(self.starts, at)
        return k < len(self.starts) and self.starts[k] < self.ends.get(at, self.starts[k] + 1)


def lines_of(page: str) -> tuple[list[str], str]:
    """Text lines of a page and, as one digit each, where they stand: in an article, a main part or elsewhere."""
    lines, zones, held = [], [], []
    stack: list[tuple[str, str, bool]] = []  # tag, zone, dropped
    zone, dropped, at, holders = PLAIN, False, 0, None

    def flush() -> None:
        if held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                lines.append(line)
                zones.append(zone)

    def text(end: int) -> None:
        if end > at and not dropped:
            piece = page[at:end]
            held.append(html.unescape(piece) if "&" in piece else piece)

    def close(depth: int) -> None:
        nonlocal zone, dropped
        if any(t in BLOCKS for t, _, _ in stack[depth:]):
            flush()
        _, zone, dropped = stack[depth]
        del stack[depth:]

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not dropped:
                held.append(" ")
            continue
        if tag in ("td", "th") and not dropped:
            held.append(" ")
        if tag in ENDS_P or tag in ("li", "dt", "dd"):
            ends = ("p",) if tag in ENDS_P else (tag,)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    close(depth)
                    break
                if stack[depth][0] in ("article", "main", "div", "section", "blockquote", "td", "table", "ul", "ol"):
                    break
        if tag in BLOCKS:
            flush()
        if m["attrs"].endswith("/") and tag not in BLOCKS:
            continue
        stack.append((tag, zone, dropped))
        if not dropped:
            why = _junk(tag, m["attrs"])
            in_code = why and any(t in ("pre", "code") for t, _, _ in stack[:-1]) and tag not in DROPPED
            if why == "name" and not in_code and holders is None:
                holders = _Holders(page)
            dropped = why == "sure" and not in_code or why == "name" and not in_code and not holders.inside(at)
        mark = WORDS.get(tag, MAIN if "main" in m["attrs"] and re.search(r"role\s*=\s*[\"']?main\b", m["attrs"]) else zone)
        zone = max(zone, mark)
    text(len(page))
    flush()
    return lines, "".join(zones)


def _row_bits(a: list, b: list) -> list[int]:
    """Bit-parallel rows of the LCS table: bit j of row i is 0 where the LCS of a[:i] and b[:j+1] grows with b[j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _counts(bits: int, n: int) -> list[int]:
    out = [0]
    for c in reversed(f"{bits:0{n}b}" if n else ""):
        out.append(out[-1] + (c == "0"))
    return out


def shared_lines(a: list, b: list, room: int = 1 << 28) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`. Large tables are halved instead of stored."""
    found, low, high = [], 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found += range(low)
    mid_a, mid_b = a[low : len(a) - high], b[low : len(b) - high]
    if mid_a and mid_b:
        if len(mid_a) * len(mid_b) > room and len(mid_a) > 1:
            half, n = len(mid_a) // 2, len(mid_b)
            head = _counts(_last(mid_a[:half], mid_b), n)
            tail = _counts(_last(mid_a[half:][::-1], mid_b[::-1]), n)
            cut = max(range(n + 1), key=lambda j: head[j] + tail[n - j])
            found += [low + i for i in shared_lines(mid_a[:half], mid_b[:cut], room)]
            found += [low + half + i for i in shared_lines(mid_a[half:], mid_b[cut:], room)]
        else:
            rows, i, j, picked = _row_bits(mid_a, mid_b), len(mid_a), len(mid_b), []
            while i and j:
                if rows[i] >> (j - 1) & 1:  # b[j-1] adds nothing here
                    j -= 1
                elif not rows[i - 1] >> (j - 1) & 1:  # it did so without a[i-1]
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    picked.append(low + i)
            found += picked[::-1]
    found += range(len(a) - high, len(a))
    return found


def _last(a: list, b: list) -> int:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return row


def nearness(a: str, b: str) -> int:
    """Leading path segments in common."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def main_text(lines: list[str], zones: str, nearest: list[list[str]]) -> tuple[str, int]:
    """Main text and number of shared lines; `nearest` has the paired page's lines, then the other neighbour's."""
    shared: list[int] = []
    for other in nearest:
        shared = shared_lines(lines, other)
        if len(shared) < len(lines):
            break
        shared = []  # a copy of this page shows nothing about its template
    best = max(zones, default=PLAIN)
    gone = set(shared) if best != ARTICLE else set()
    kept = [t for i, (t, z) in enumerate(zip(lines, zones)) if z == best and i not in gone]
    return "\n\n".join(kept), len(shared)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)"
    return F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


PLACED = "page_id string, url string, host string, path string, id long, lines string, zones string, part int, side int"
RESULT = "page_id long, url string, text string, n_chars long, n_shared long"


def placed_lines(edges: list[tuple[tuple, tuple]]):
    """For mapInPandas: pages to lines, sent to their range and, at its edges, to the neighbouring one."""
    firsts = [a for a, _ in edges]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, host, path, key, page in zip(*(batch[c] for c in ("page_id", "url", "host", "path", "id", "html"))):
                lines, zones = lines_of(page or "")
                row = (page_id, url, host, path, key, "\n".join(lines), zones)
                i = range_of(firsts, (host, path, key))
                rows.append((*row, i, 0))
                if (host, path, key) == edges[i][1] and i + 1 < len(edges):
                    rows.append((*row, i + 1, -1))
                if (host, path, key) == firsts[i] and i:
                    rows.append((*row, i - 1, 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACED.split(", ")])

    return run


def differenced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: pages of one range in order, with one row before and after it, to their main text."""

    def result(row, before, after) -> tuple:
        lines = row.lines.split("\n") if row.lines else []
        near = [x for x in (before, after) if x is not None and x.host == row.host]
        near.sort(key=lambda x: -nearness(row.path, x.path))  # stable: the page before goes first
        text, shared = main_text(lines, row.zones, [x.lines.split("\n") if x.lines else [] for x in near])
        return None if row.page_id is None else int(row.page_id), row.url, text, len(text), shared

    before = here = None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.side > 0 and here is not None and here.side > 0:
                continue
            if here is not None and here.side == 0:
                out.append(result(here, before, row))
            before, here = here, row
        yield table(out)
    if here is not None and here.side == 0:
        yield table([result(here, before, None)])


def table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_shared"]).astype({"page_id": "Int64"})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared of every row of pages (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("string"), "url", host.alias("host"), path.alias("path"), F.coalesce("page_id", F.lit(LOWEST)).alias("id"), "html")
    edges = range_edges(rows.select("host", "path", "id"), partitions(pages.sparkSession))
    placed = rows.mapInPandas(placed_lines(edges), PLACED)
    return placed.repartitionById(max(1, len(edges)), "part").sortWithinPartitions("side", "host", "path", "id").mapInPandas(differenced, RESULT)


def op2_html_text(spark, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))
