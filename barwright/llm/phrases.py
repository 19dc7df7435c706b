"""Document fingerprints by locally consistent parsing.

Each level reads a text's symbols (first its code points), joins runs of one symbol, and cuts the rest at landmarks
found by deterministic coin tossing: the lowest bit in which a symbol differs from its left neighbour gives a short
label, which four rounds shrink to six values of which no two neighbours are equal; a local maximum of the labels
starts a phrase. A phrase is named by a hash of its symbols, and the names are the next level's symbols. A cut
depends on a few symbols around it only, so equal substrings get equal names inside, whatever stands before them.

The fingerprint is a sketch of the set of all names from level `LOWEST_LEVEL` up: its `SKETCH` smallest 32-bit
hashes in ascending order. Two fingerprints' likeness is the share of common ones among the smallest of their union,
which estimates the Jaccard similarity of the two sets of phrases.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is like itself (1) and
unlike all others (0). Rows without doc_id come first in the order, rows that repeat a doc_id follow each other by
a hash of their text. The last row's next document is the first, so a single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import LOWEST, partitions, range_edges, range_of

LOWEST_LEVEL = 2
SKETCH = 64
CHUNK_CHARS = 400_000
ROUNDS = 4
_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowest_bit_table() -> np.ndarray:
    i = np.arange(128)
    return np.where(i == 0, 0, np.log2(np.maximum(i & -i, 1))).astype(np.uint8)


_LOW = _lowest_bit_table()


def _labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, unequal for neighbours of one text; `sym` has no equal neighbours inside a text."""
    left = np.empty_like(sym)
    left[1:] = sym[:-1]
    left[first] = sym[first] ^ np.uint64(1)
    differs = left ^ sym
    low = differs & (~differs + np.uint64(1))
    bit = ((low.astype(np.float64).view(np.int64) >> 52) - 1023).astype(np.uint64)
    label = (2 * bit + ((sym >> bit) & np.uint64(1))).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        left8 = np.empty_like(label)
        left8[1:] = label[:-1]
        left8[first] = label[first] ^ 1
        low8 = _LOW[left8 ^ label]
        label = 2 * low8 + ((label >> low8) & 1)
    return label


def parse(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of phrases and the positions in them of each text's first phrase.

    `first` has the start of each text in `sym`; every text has a symbol.
    """
    begins = np.zeros(len(sym), bool)
    begins[first] = True
    # runs of one symbol become a symbol of their own
    new = begins.copy()
    new[1:] |= sym[1:] != sym[:-1]
    at = np.flatnonzero(new)
    if len(at) < len(sym):
        run = np.diff(at, append=len(sym)).astype(np.uint64)
        sym = np.where(run > 1, _mix(sym[at] * _G + run), sym[at])
        begins = begins[at]
        first = np.flatnonzero(begins)
        again = np.flatnonzero(sym[1:] == sym[:-1]) + 1  # only by a collision of hashes
        sym[again[~begins[again]]] ^= np.uint64(1)
    label = _labels(sym, first)
    higher = np.ones(len(sym), bool)
    higher[1:] = label[1:] > label[:-1]
    top = np.zeros(len(sym), bool)
    top[1:-1] = higher[1:-1] & ~higher[2:]
    last = np.append(first[1:], len(sym)) - 1
    top[last] = False  # a text's last symbol starts no phrase, nor does the next text's first count as lower
    cut = top | begins
    start = np.flatnonzero(cut)
    inside = (np.arange(len(sym)) - np.repeat(start, np.diff(start, append=len(sym)))).astype(np.uint64)
    names = _mix(np.add.reduceat(_mix(sym + inside * _G), start))
    return names, np.flatnonzero(begins[start])


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as ascending unsigned 32-bit hashes."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    owner = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(owner):
        return out
    size = np.array([len(texts[i]) for i in owner])
    sym = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
    first = np.cumsum(size) - size
    names, owners, level = [], [], 0
    while len(owner):
        sym, first = parse(sym, first)
        level += 1
        size = np.diff(first, append=len(sym))
        done = size == 1
        mine = np.repeat(np.arange(len(owner)), size)
        take = done[mine] if level < LOWEST_LEVEL else np.ones(len(sym), bool)  # a text that ends early keeps its root
        names.append(_mix(sym[take] + np.uint64(level)) >> np.uint64(32))
        owners.append(owner[mine[take]])
        if done.any():
            go = ~done[mine]
            sym, owner, size = sym[go], owner[~done], size[~done]
            first = np.cumsum(size) - size
    both = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | np.concatenate(names))
    whose = (both >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(whose, np.arange(len(texts) + 1))
    low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for i in range(len(texts)):
        out[i] = low[edges[i] : min(edges[i + 1], edges[i] + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity as two sketches show it, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.count_nonzero(np.isin(union, a) & np.isin(union, b))) / len(union)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def _documents(pairs: list[tuple]) -> pd.DataFrame:
    """pairs: (doc_id, text, next text)."""
    changed = [edited(t, f) for _, t, f in pairs]
    every = list(dict.fromkeys([x for (_, t, f), c in zip(pairs, changed) for x in (t, c, f)]))
    sketch = dict(zip(every, sketches(every)))
    rows = []
    for (doc_id, t, f), c in zip(pairs, changed):
        own, new = sketch[t], sketch[c]
        sha = hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((doc_id, len(t), sha, written(own), written(new), likeness(own, new), likeness(own, sketch[f])))
    out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return out.astype({"doc_id": "Int64"})


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: rows of one range in order, the first row after the range last (`follows`)."""
    before, pairs, held = None, [], 0
    for batch in batches:
        for doc_id, text, follows in zip(batch["doc_id"], batch["text"], batch["follows"]):
            text = text if isinstance(text, str) else ""
            if before is not None:
                pairs.append((*before, text))
                held += len(before[1]) + 1
                if held > CHUNK_CHARS:
                    yield _documents(pairs)
                    pairs, held = [], 0
            before = None if follows else (None if doc_id is None else int(doc_id), text)
            if follows:
                break
    if pairs:
        yield _documents(pairs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text), of its edited text, and their likenesses.

    The order by doc_id is cut into ranges of equal rows; the first row of each range is also sent to the range
    before it (the first of all to the last), so each range sees the row that follows it."""
    rows = docs.select("doc_id", "text").withColumns({"k1": F.coalesce("doc_id", F.lit(LOWEST)), "k2": F.xxhash64("text")})
    firsts = [first for first, _ in range_edges(rows.select("k1", "k2"), partitions(docs.sparkSession))]

    @F.pandas_udf("array<int>")
    def ranges(k1: pd.Series, k2: pd.Series) -> pd.Series:
        out = []
        for key in zip(k1.tolist(), k2.tolist()):
            i = range_of(firsts, key)
            out.append([i, (i - 1) % len(firsts)] if key == firsts[i] else [i])
        return pd.Series(out)

    dealt = rows.withColumn("both", ranges("k1", "k2")).select("*", F.posexplode("both").alias("follows", "part"))
    placed = dealt.repartitionById(max(1, len(firsts)), "part").sortWithinPartitions("follows", "k1", "k2")
    return placed.select(F.col("doc_id").cast("string"), "text", (F.col("follows") > 0).alias("follows")).mapInPandas(with_next, RESULT)


def op5_fingerprints(spark, folder: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{folder}/documents.parquet"))
