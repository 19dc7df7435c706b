"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q (words q apart are identical) of at least max(6, 4q) words that no
neighbouring word extends. For every B = 1, 2, 4, ... the words are cut into blocks of B. A run of period q in
[B, 2B) holds a whole block together with its copy q words further on, so the block has zero mismatches with the
window that follows it at distance q. The mismatches at all distances in [B, 2B) are sums of squared differences of
word numbers: two sums of squares less twice a correlation, which is computed modulo primes by number-theoretic
transforms. As many primes are taken as make their product larger than any possible sum, so a sum is zero exactly if
it is zero modulo each of them. Distances found this way are seeds; a seed is extended word by word to both sides.

What keeps the work linear apart from the transforms, without losing a run:

* A block takes part only if each of its words comes again within 2B words; ordinary prose leaves few such blocks.
* A block whose window lies inside a known run (period q < B) has copies at multiples of q only: it is skipped.
* A block inside a known run [s, e) of period q <= B/4 has copies in steps of q. A run of a larger period that holds
  it ends the inner run at the same places in both copies, so only the distances that carry s to the start, or e to
  the end, of the copy's own run of period q are seeds.
* Other blocks have no period up to B/4, so at most five copies in the window.

A text is worked on by itself, in memory proportional to its words.

Defined results: null counts as an empty text; texts without words have no runs and collapse to an empty text. Rows
that repeat a doc_id are separate rows. Only doc_id and the text column are read, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import text_slices

LEAST = 6
TIMES = 4
#: p - 1 is a multiple of a large power of two; with a generator of each group
PRIMES = ((2013265921, 31), (2281701377, 3), (469762049, 3))
DIRECT = 16  # blocks up to this length: the squared differences are summed without a transform
CELLS = 1 << 19  # numbers that a transform works on at once
SPACE = r"[\x20\x09-\x0D]+"


def powers(base: int, count: int, p: int) -> np.ndarray:
    out = np.ones(max(count, 1), np.uint64)
    have, step = 1, base % p
    while have < count:
        more = min(have, count - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(p)
        have, step = have + more, step * step % p
    return out


class Transform:
    """Number-theoretic transform of rows of `size` numbers modulo p, and its inverse on the transformed order."""

    def __init__(self, size: int, p: int, generator: int):
        self.size, self.p = size, np.uint64(p)
        root = pow(generator, (p - 1) // size, p)
        self.roots, self.back = powers(root, size // 2, p), powers(pow(root, -1, p), size // 2, p)
        self.scale = np.uint64(pow(size, -1, p))

    def forward(self, a: np.ndarray) -> np.ndarray:
        p, half = self.p, self.size // 2
        while half:
            v = a.reshape(len(a), -1, 2, half)
            one, two = v[:, :, 0], v[:, :, 1]
            total = one + two
            apart = (one + (p - two)) * self.roots[:: self.size // (2 * half)] % p
            v[:, :, 0], v[:, :, 1] = np.minimum(total, total - p), apart
            half //= 2
        return a

    def inverse(self, a: np.ndarray) -> np.ndarray:
        p, half = self.p, 1
        while half < self.size:
            v = a.reshape(len(a), -1, 2, half)
            one, two = v[:, :, 0], v[:, :, 1] * self.back[:: self.size // (2 * half)] % p
            total, apart = one + two, one + (p - two)
            v[:, :, 0], v[:, :, 1] = np.minimum(total, total - p), np.minimum(apart, apart - p)
            half *= 2
        return a * self.scale % p


def zero_distances(x: np.ndarray, starts: np.ndarray, block: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every pair of a block and a copy of it at a distance in [block, 2 block).

    `x` holds numbers up to `largest` and reaches at least 3 blocks past every start.
    """
    found = []
    bound = block * largest * largest
    primes, product = [], 1
    for p in PRIMES:
        if product <= bound:
            primes.append(p)
            product *= p[0]
    if product <= bound:
        raise ValueError("a text has more words than the primes allow for")
    plans = [Transform(2 * block, *p) for p in primes] if block > DIRECT else []
    some = max(1, CELLS // (2 * block if plans else block * block))
    for at in range(0, len(starts), some):
        mine = starts[at : at + some, None]
        own, ahead = x[mine + np.arange(block)], x[mine + block + np.arange(2 * block - 1)]
        if not plans:
            shifted = np.lib.stride_tricks.sliding_window_view(ahead, block, axis=1)
            zero = ((own[:, None, :] - shifted) ** 2).sum(2) == 0
        else:
            zero = np.ones((len(mine), block), bool)
            for plan in plans:
                p = plan.p
                left, right = np.zeros((len(mine), 2 * block), np.uint64), np.zeros((len(mine), 2 * block), np.uint64)
                left[:, 0], left[:, : -block : -1], right[:, :-1] = own[:, 0], own[:, 1:], ahead
                cross = plan.inverse(plan.forward(left) * plan.forward(right) % p)[:, :block]
                squares = np.zeros((len(mine), 2 * block), np.uint64)
                np.cumsum((ahead.astype(np.uint64) ** 2) % p, axis=1, out=squares[:, 1:])
                total = (squares[:, block:] - squares[:, :block]) % p + ((own.astype(np.uint64) ** 2) % p).sum(1, keepdims=True) % p
                zero &= (total + 2 * (p - cross)) % p == 0
        row, lag = np.nonzero(zero)
        found.append((mine[row, 0], lag + block))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def agreement(x: np.ndarray, i: int, j: int) -> int:
    """How many numbers from i on equal those from j on (j > i)."""
    done, step = 0, 64
    while j + done < len(x):
        there = x[j + done : j + done + step]
        other = np.flatnonzero(x[i + done : i + done + len(there)] != there)
        if len(other):
            return done + int(other[0])
        done, step = done + len(there), step * 2
    return done


def stretch(x: np.ndarray, back: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch of period d (start, end exclusive) around a place where x repeats at distance d."""
    n = len(x)
    return at - agreement(back, n - at - d, n - at), at + d + agreement(x, at, at + d)


def aligned(x: np.ndarray, back: np.ndarray, at: int, block: int, distances: np.ndarray, run: tuple[int, int, int]) -> list[int]:
    """Of the distances of a block inside `run` (start, end, period): those that carry an end of it to an end of the copy's."""
    start, end, q = run
    heads = distances[np.concatenate([[True], np.diff(distances) != q])]
    wanted = set()
    for d in heads.tolist():
        first, last = stretch(x, back, at + d, q)
        if first != start:
            wanted |= {first - start, last - end}
    return [d for d in distances.tolist() if d in wanted]


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers from 0, by start and period."""
    n = len(x)
    if n < LEAST:
        return []
    order = np.argsort(x, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the next place of the same number
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    pad = int(x.max()) + 1
    back = x[::-1]
    wide = np.concatenate([x, np.full(3 * max(1, n // TIMES), pad, x.dtype)])
    found: dict[tuple[int, int], int] = {}
    block, reach = 1, again
    while TIMES * block <= n:
        starts = np.flatnonzero(reach[: n // block - 1] < 2 * block) * block
        if len(starts):
            inner = {}
            skip = np.zeros(n // block + 1, bool)
            for (s, e), q in found.items():
                if q < block:
                    skip[-(-s // block) : max(0, (e - 3 * block) // block + 1)] = True
                if q <= block // TIMES:
                    inner.update(dict.fromkeys(range(-(-s // block), e // block), (s, e, q)))
            at, distance = zero_distances(wide, starts[~skip[starts // block]], block, pad)
            cuts = np.flatnonzero(np.diff(at)) + 1
            seen: dict[int, int] = {}
            for mine, distances in zip(at[np.concatenate([[0], cuts])] if len(at) else (), np.split(distance, cuts)):
                mine = int(mine)
                run = inner.get(mine // block)
                for d in aligned(x, back, mine, block, distances, run) if run else distances.tolist():
                    if seen.get(d, -1) >= mine + block + d:
                        continue
                    s, e = stretch(x, back, mine, d)
                    seen[d] = e
                    if e - s >= max(LEAST, TIMES * d):
                        found.setdefault((s, e), d)
        whole = len(reach) // 2 * 2
        reach, block = np.maximum(reach[0:whole:2], reach[1:whole:2]), 2 * block
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch, "text"):
            all_runs, kept = [], []
            for text in texts:
                words = text.encode().split()  # bytes split at space and 0x09 to 0x0D alone
                found = runs(numbered(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(all_runs, pa.list_(RUN)), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, `runs` (array of start, length, period by start and period) and `collapsed` text of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_marked, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")


def best_run(found: Column) -> Column:
    """The run of greatest length over period; the first of equal ones."""
    none = F.lit(None).cast("struct<start long, length long, period long>")
    better = lambda held, x: held.isNull() | (x["length"] * held["period"] > held["length"] * x["period"])
    return F.aggregate(found, none, lambda held, x: F.when(better(held, x), x).otherwise(held))


def looped(doc_id: Column, text: Column) -> Column:
    """The text as it is, or for every tenth document by checksum with a phrase repeated up to the end."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)

    def damaged(w: Column, n: Column) -> Column:
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    # the word array is bound once, not written out at each of its uses
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, damaged(w, F.size(w))).otherwise(F.lit(""))), 1)
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op12_periodic_runs(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
