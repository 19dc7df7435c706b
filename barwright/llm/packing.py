"""Packing documents into token sequences: linear grouping of the long pieces, then best fit of the short ones.

Documents longer than a sequence are cut. What has to be known to plan the packing is how many pieces there are of
each length, a table of at most `SEQUENCE` rows, whatever the size of the corpus; the plan is made from it on the
driver. All that touches pieces is done by Spark, and no step needs the pieces of one length or one group together:

1. Pieces get their place in the order of lengths, longest first (sorted ranges and their sizes).
2. Linear grouping: pieces of more than `SMALL` tokens are cut by place into groups of equal numbers, and each group
   counts as long as its longest piece.
3. With few sizes, the fractional optimum of filling sequences is found by column generation: a pattern says how many
   pieces of each group one sequence takes, a knapsack over the sizes' prices gives the next pattern, until none pays.
   Patterns are used a whole number of times; what that leaves is filled by best fit of the rounded sizes.
4. Substitution: the n-th piece of a group takes the n-th slot of its group. Where that slot lies follows from the
   numbers of uses of the patterns by arithmetic, so no sequence table is needed.
5. Best fit of the short pieces, longest first, into the room that the actual pieces leave: computed for counts of
   sequences by room (again at most `SEQUENCE` rows), which gives intervals of sequences that take the same short
   lengths; pieces find their sequence by their place in their length.

Defined results: a null or empty text has only the end id, so every row has a piece. Rows that repeat a doc_id, or
have none, are packed each for itself; they are told apart inside the operator by a row number. An empty table gives
no rows. Only doc_id and text are read. Texts of any length are cut into pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barwright.llm.shared import placed, stored, text_slices
from barwright.llm.units import units

SEQUENCE = 2048
SMALL = 512
GROUPS = 192
END_ID = 0
TOKENIZER = "word_bpe_49k.json"


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, row (a number of the row), piece, start, length and ids_crc32 of every piece of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = units(path, spaced=False)
        for batch in batches:
            for part, texts in text_slices(batch, "text", 4_000_000):
                flat, counts = enc.encode(pa.array(texts, pa.string()))
                out, at = [], 0
                for i, n in enumerate(counts.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, length)):
                        some = ids[start : start + length]
                        out.append((i, k, start, len(some), zlib.crc32(some.tobytes())))
                found = np.array(out, np.int64).T
                rows = [part.column(0).take(pa.array(found[0])), part.column(1).take(pa.array(found[0])), pa.array(found[1], pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows, *[pa.array(c) for c in found[2:]]], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def priced(sizes: list[int], prices: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The multiset of sizes that fits `room` at the highest total price, by an unbounded knapsack."""
    value, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, price = sizes[i], prices[i]
        if price <= 0:
            continue
        for low in range(size, room + 1, size):  # a slice reads only entries that are final for this size
            high = min(low + size, room + 1)
            better = value[low - size : high - size] + price
            win = better > value[low:high] + 1e-12
            value[low:high][win], taken[low:high][win] = better[win], i
    # rooms that take nothing new inherit from smaller ones only through their own value, so walk down from the best
    at, counts = int(np.argmax(value)), [0] * len(sizes)
    best = float(value[at])
    while at > 0 and taken[at] >= 0:
        counts[taken[at]] += 1
        at -= sizes[taken[at]]
    return best, counts


def patterns(sizes: list[int], demand: list[int], room: int, rounds: int = 4000) -> list[tuple[list[int], float]]:
    """Fractional optimum of filling sequences with `demand` pieces of each size: patterns and how often each is used."""
    k = len(sizes)
    basis = np.diag([float(room // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    use = inverse @ np.array(demand, float)
    for step in range(rounds):
        worth, counts = priced(sizes, inverse.sum(0), room)
        if worth <= 1 + 1e-7:
            break
        column = inverse @ np.array(counts, float)
        ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = counts
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
            use = inverse @ np.array(demand, float)
            continue
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        use -= column * ratio[out]
        use[out] = ratio[out]
    return [([int(c) for c in basis[:, j]], max(0.0, float(use[j]))) for j in range(k)]


def whole_patterns(sizes: list[int], demand: list[int], room: int) -> list[tuple[list[int], int]]:
    """Patterns with whole numbers of uses that hold exactly `demand`: the optimum rounded down, the rest by best fit."""
    made, left = [], list(demand)
    for counts, use in patterns(sizes, demand, room):
        use = min([int(use + 1e-6), *[have // c for have, c in zip(left, counts) if c]])
        if use > 0:
            made.append((counts, use))
            left = [have - use * c for have, c in zip(left, counts)]
    bins: list[tuple[int, int]] = []  # (room, number of the bin), ascending
    held: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for _ in range(left[i]):
            at = bisect_left(bins, (sizes[i], -1))
            free, n = bins.pop(at) if at < len(bins) else (room, len(held))
            if n == len(held):
                held.append([0] * len(sizes))
            held[n][i] += 1
            bins.insert(bisect_left(bins, (free - sizes[i], n)), (free - sizes[i], n))
    return made + [(counts, 1) for counts in held]


class Slots:
    """Where the n-th piece of each group lies."""

    def __init__(self, made: list[tuple[list[int], int]], groups: int):
        first = [0, *accumulate(use for _, use in made)]
        self.sequences = first[-1]
        self.starts, self.rows = [], []
        for g in range(groups):
            starts, rows, n = [], [], 0
            for (counts, use), at in zip(made, first):
                if counts[g]:
                    starts.append(n)
                    rows.append((n, at, counts[g]))
                    n += use * counts[g]
            self.starts.append(np.array(starts, np.int64))
            self.rows.append(np.array(rows, np.int64).reshape(-1, 3))

    def sequence(self, group: int, nth: np.ndarray) -> np.ndarray:
        rows = self.rows[group][np.searchsorted(self.starts[group], nth, side="right") - 1]
        return rows[:, 1] + (nth - rows[:, 0]) // rows[:, 2]


class Grouping:
    """Lengths (ascending by place from 0, longest first) to groups of equal numbers of pieces."""

    def __init__(self, counts: dict[int, int], room: int, small: int, groups: int):
        self.long = sum(n for length, n in counts.items() if length > small)
        self.whole = counts.get(room, 0)  # these fill a sequence each
        self.each = max(1, -(-(self.long - self.whole) // groups))
        ordered = sorted(((length, n) for length, n in counts.items() if length > small), reverse=True)
        ends = list(accumulate(n for _, n in ordered))
        number = -(-(self.long - self.whole) // self.each)
        self.sizes = [ordered[bisect_right(ends, self.whole + g * self.each)][0] for g in range(number)]
        self.demand = [min(self.each, self.long - self.whole - g * self.each) for g in range(number)]


def best_fit(rooms: dict[int, int], short: dict[int, int], room: int) -> tuple[dict[int, tuple], int]:
    """Best fit of short lengths, longest first, by counts.

    Returns for each length its fills (first piece, pieces in each sequence, room of the sequences before any fill,
    first sequence of that room), and the number of new sequences; new sequences have room `room + 1` as their mark.
    """
    new = 0
    # stretches of sequences that are alike: (room now, mark, first, count)
    alike = sorted((r, r, 0, n) for r, n in rooms.items() if r > 0)
    fills: dict[int, list] = {}
    for length in sorted(short, reverse=True):
        left, at, mine = short[length], 0, []
        while left:
            k = bisect_left(alike, (length,))
            if k == len(alike):
                each = room // length
                count = -(-left // each)
                alike.append((room, room + 1, new, count))
                new += count
                continue
            free, mark, first, count = alike.pop(k)
            each = free // length
            full = min(count, left // each)
            parts = [(full, each)]
            if full < count and left > full * each:
                parts.append((1, left - full * each))
            for n, each in parts:
                if n:
                    mine.append((at, each, mark, first))
                    at, left, first, count = at + n * each, left - n * each, first + n, count - n
                    if free > each * length:
                        entry = (free - each * length, mark, first - n, n)
                        alike.insert(bisect_left(alike, entry), entry)
            if count:
                alike.insert(bisect_left(alike, (free, mark, first, count)), (free, mark, first, count))
        fills[length] = np.array(mine, np.int64).reshape(-1, 4)
    return fills, new


def packed(found: DataFrame, room: int = SEQUENCE, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """`found` (doc_id, row, piece, length, ...) with sequence_id and offset."""
    small = min(small, room // 2)
    order = [F.col("length").desc(), F.col("row"), F.col("piece")]
    ranked = placed(found, order, "place", "pack-places")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    grouping = Grouping(counts, room, small, groups)
    slots = Slots(whole_patterns(grouping.sizes, grouping.demand, room), len(grouping.sizes))
    whole, each, sequences = grouping.whole, grouping.each, grouping.whole + slots.sequences

    def substitute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            where = place.copy()
            group = np.where(place < whole, -1, (place - whole) // each)
            for g in np.unique(group[group >= 0]):
                mine = group == g
                where[mine] = whole + slots.sequence(int(g), place[mine] - whole - g * each)
            yield batch.append_column("sequence_id", pa.array(where))

    with_one = lambda name: StructType([*ranked.schema.fields, StructField(name, LongType())])
    long_ones = stored(ranked.filter(F.col("length") > small).mapInArrow(substitute, with_one("sequence_id")), "pack-long")
    filled = long_ones.groupBy("sequence_id").agg((F.lit(room) - F.sum("length")).alias("room")).filter("room > 0")
    by_room = placed(filled, [F.col("room"), F.col("sequence_id")], "at", "pack-rooms")
    rooms = {r["room"]: r["n"] for r in by_room.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    before = dict(zip(sorted(rooms), accumulate((rooms[r] for r in sorted(rooms)), initial=0)))
    short = {length: n for length, n in counts.items() if length <= small}
    fills, new = best_fit(rooms, short, room)
    longer = dict(zip(sorted(counts, reverse=True), accumulate((counts[c] for c in sorted(counts, reverse=True)), initial=0)))
    known = sum(rooms.values())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            at = np.zeros(len(place), np.int64)
            for size in np.unique(length):
                mine = length == size
                nth = place[mine] - longer[int(size)]
                rows = fills[int(size)]
                start = np.array([known if m == room + 1 else before[m] for m in rows[:, 2].tolist()])
                of = np.searchsorted(rows[:, 0], nth, side="right") - 1
                at[mine] = start[of] + rows[of, 3] + (nth - rows[of, 0]) // rows[of, 1]
            yield batch.append_column("at", pa.array(at))

    short_ones = ranked.filter(F.col("length") <= small).mapInArrow(fill, with_one("at"))
    target = by_room.select("at", "sequence_id")
    # `at` names one sequence; sequences that are new are numbered on from the last
    short_ones = short_ones.join(target, "at", "left").withColumn("sequence_id", F.coalesce("sequence_id", F.col("at") - known + sequences)).drop("at")
    both = long_ones.select(*short_ones.columns).unionByName(short_ones)
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("place")


def op11_best_fit_packing(spark, folder: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = stored(pieces(docs, path or public_tokenizers.path(TOKENIZER)), "pack-pieces")
    return packed(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
