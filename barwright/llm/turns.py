"""Repair of the turn structure of conversations at least cost.

The roles of a whole conversation are an optional system turn and then pairs of user and assistant; a conversation
may also be empty. Edits: keep a row (0), give it the role user or assistant (2), delete it (3; blank and repeated
rows have to go), insert an empty user or assistant turn (2); a row that breaks off and stays costs 1 more. The
cheapest edits win, of equally cheap ones those whose initials (K, R, D, I) come first in ASCII order.

A plan is one integer: its cost in the high digits, below it the initials of its edits as digits to base 256, first
edit first, zeros at the end up to a fixed width. The smaller integer is the better plan, so a dynamic program over the
rows from the last to the first with an ordinary integer minimum decides everything. Two plans of one stretch of rows
with the same cost are never prefixes of each other (they hold one K, R or D for each row, and a further I costs), so
best plans of neighbouring stretches can be joined.

A conversation of any length is spread over tasks: rows get their place by ranges of (conversation, turn) and are cut
every `CHUNK` places. A conversation inside one piece is decided there; of others each piece gives the best plan from
each state to each state, and the plans of `FAN` neighbouring pieces are joined, in rounds, until one is left. The
text of the repaired rows is put together piece by piece; only the digest of a conversation has to see its repaired
text in one sequence, as a stream.

Defined results: null role and text count as one space, null conv_id is a conversation of its own, rows without turn
come first, rows of one turn are ordered by role and digest of the text. A conversation without rows has zeros, an empty
audit and the digest of an empty text. The role's first letter counts, whatever follows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import partitions, placed, stored

CHUNK = 512
FAN = 64
BLOB = 1 << 20
REROLED, DELETED, INSERTED, BROKEN = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a user or assistant turn that is given or inserted
TAILS = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}  # what a conversation that ends in a state still needs
WHITE = " \t\n\x0b\x0c\r"
NO_TEXT = hashlib.sha256(b"").hexdigest()


def spoken(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with one space for a missing role or text."""
    return turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut short, repeated or given to the user by a checksum of conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = spoken(turns).withColumn("_h", F.crc32(key) % 20).filter("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def ordered(turns: DataFrame) -> DataFrame:
    """The rows with `place`, their position in the order of conversations and turns, and `digest` of role and text; stored."""
    digest = F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")), 256)
    rows = spoken(turns).withColumn("digest", digest).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("_row")]
    return placed(rows, order, "place", "turns").drop("_row")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, place, turn, `initial` of the role and `fault`: (b)lank, (d)uplicate, (t)runcated or none (o)."""
    kept = F.rtrim(F.col("text"), F.lit(WHITE))
    one = rows.select("conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), F.right(kept, F.lit(1)).alias("last"))
    # the places where a role and text come first: one row for each, so the join key never repeats
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "b").when(F.col("first").isNull(), "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("o")
    return one.join(firsts, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"))


class Weights:
    """Plans as integers: cost, then `width` letters."""

    def __init__(self, width: int):
        self.bits = 8 * width
        self.letters = (1 << self.bits) - 1

    def of(self, cost: int, audit: str) -> int:
        return cost << self.bits | int.from_bytes(audit.encode().ljust(self.bits // 8, b"\0"), "big")

    def first(self, letter: str, cost: int, plan: int) -> int:
        """The plan after one more edit at its start."""
        head = (plan >> self.bits) + cost << self.bits
        return head | ord(letter) << self.bits - 8 | (plan & self.letters) >> 8

    def read(self, plan: int) -> tuple[int, str]:
        return plan >> self.bits, (plan & self.letters).to_bytes(self.bits // 8, "big").rstrip(b"\0").decode()


def before_rows(w: Weights, initials: str, marks: str, ends: list[int | None]) -> list[int | None]:
    """The best plan from each state over rows (their initials and faults), given the best plans from their end."""
    best = ends
    for initial, mark in zip(reversed(initials), reversed(marks)):
        extra = BROKEN if mark == "t" else 0
        row = []
        for state in range(4):
            found = [w.first("D", DELETED, best[state])] if best[state] is not None else []
            if mark not in "bd":
                kept, given = AFTER.get((state, initial)), NEXT[state]
                if kept is not None and best[kept] is not None:
                    found.append(w.first("K", extra, best[kept]))
                if best[given] is not None:
                    found.append(w.first("R", REROLED + extra, best[given]))
            row.append(min(found, default=None))
        best = []
        for state in range(4):
            one, two = row[NEXT[state]], row[NEXT[NEXT[state]]]
            found = [row[state]] if row[state] is not None else []
            if one is not None:
                found.append(w.first("I", INSERTED, one))
            if two is not None:
                found.append(w.first("I", INSERTED, w.first("I", INSERTED, two)))
            best.append(min(found, default=None))
    return best


def decide(initials: str, marks: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    w = Weights(3 * len(initials) + 2)
    return w.read(before_rows(w, initials, marks, [w.of(INSERTED * len(TAILS[s]), TAILS[s]) for s in range(4)])[START])


def between(initials: str, marks: str) -> list[tuple[int, str] | None]:
    """Best plans of a piece of a conversation from each state (rows) to each state (columns)."""
    w = Weights(3 * len(initials) or 1)
    columns = [before_rows(w, initials, marks, [w.of(0, "") if s == end else None for s in range(4)]) for end in range(4)]
    return [None if columns[end][state] is None else w.read(columns[end][state]) for state in range(4) for end in range(4)]


def joined(pieces: list[list[tuple[int, str] | None]]) -> list[tuple[int, str] | None]:
    """Best plans over neighbouring pieces, from the last to the first."""
    total = pieces[-1]
    for piece in reversed(pieces[:-1]):
        w = Weights(max(len(p[1]) for p in piece if p) + max(len(p[1]) for p in total if p) or 1)
        made = []
        for state in range(4):
            for end in range(4):
                both = [(piece[4 * state + k], total[4 * k + end]) for k in range(4)]
                plans = [w.of(a[0] + b[0], a[1] + b[1]) for a, b in both if a and b]
                made.append(w.read(min(plans)) if plans else None)
        total = made
    return total


def finished(plans: list[tuple[int, str] | None]) -> tuple[int, str]:
    ends = [(plans[end], TAILS[end]) for end in range(4) if plans[end]]
    w = Weights(max(len(p[1]) + len(t) for p, t in ends) or 1)
    return w.read(min(w.of(p[0] + INSERTED * len(t), p[1] + t) for p, t in ends))


def unlawful(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


PLAN = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
PLAN_SQL = "array<struct<cost long, audit string>>"


def _plans(found: list) -> pa.Array:
    return pa.array([None if f is None else [None if p is None else {"cost": p[0], "audit": p[1]} for p in f] for f in found], pa.list_(PLAN))


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their rows: cost and audit of a whole conversation, or the plans of a part."""
    for batch in batches:
        rows = batch.to_pylist()
        done = [decide(r["initials"], r["marks"]) if r["pieces"] == 1 else (None, None) for r in rows]
        plans = [between(r["initials"], r["marks"]) if r["pieces"] > 1 else None for r in rows]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "piece", "n", "pieces")]
        more = [pa.array([unlawful(r["initials"]) for r in rows], pa.int64()), pa.array([r["initials"][:1] for r in rows]), pa.array([r["initials"][-1:] for r in rows])]
        yield pa.RecordBatch.from_arrays(
            [*kept, *more, pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), _plans(plans)],
            ["conv_id", "piece", "n", "pieces", "illegal", "head", "tail", "cost", "audit", "plans"],
        )


def _next_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [joined([[p and (p["cost"], p["audit"]) for p in one["plans"]] for one in parts]) for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _plans(found)], ["conv_id", "piece", "plans"])


def _last_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [finished([p and (p["cost"], p["audit"]) for p in plans]) for plans in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["conv_id", "cost", "audit"])


def _shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each conversation cut at its pieces: the letters of the rows of a piece, with the inserts before
    them, how many turns are kept before it, and whether the first kept turn is a system turn (then their number is odd)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            audit, at, kept = row["audit"], 0, 0
            leading = (len(audit) - audit.count("D")) % 2 == 1
            for k, piece in enumerate(row["sizes"]):
                end, left = at, piece["n"]
                while left:
                    left -= audit[end] != "I"
                    end += 1
                if k + 1 == len(row["sizes"]):
                    end = len(audit)
                part = audit[at:end]
                out.append({"conv_id": row["conv_id"], "piece": piece["piece"], "letters": part, "kept": kept, "leading": leading, "pieces": len(row["sizes"])})
                at, kept = end, kept + len(part) - part.count("D")
        yield pa.RecordBatch.from_pylist(out, schema=SHARES)


SHARES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("letters", pa.string()), ("kept", pa.int64()), ("leading", pa.bool_()), ("pieces", pa.int64())])
SHARES_SQL = "conv_id long, piece long, letters string, kept long, leading boolean, pieces long"


def plans(marked: DataFrame, fan: int = FAN, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """From rows with faults: (conv_id, cost, audit, illegal) and the letters of each piece; both stored."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("place", "initial", "fault"))), lambda r: F.struct(r["initial"], r["fault"]))
    piece = F.floor(F.col("place") / chunk).cast("long")
    rows = marked.groupBy("conv_id", piece.alias("piece")).agg(cells.alias("cells"))
    of = Window.partitionBy("conv_id")
    # roles that begin with another letter, or with none, are all the same to the program
    initial = lambda c: F.when(c["initial"].isin("s", "u", "a"), c["initial"]).otherwise("x")
    rows = rows.select(
        "conv_id", "piece", F.size("cells").cast("long").alias("n"), F.count(F.lit(1)).over(of).alias("pieces"),
        F.array_join(F.transform("cells", initial), "").alias("initials"), F.array_join(F.transform("cells", lambda c: c["fault"]), "").alias("marks"),
    )
    first = f"conv_id long, piece long, n long, pieces long, illegal long, head string, tail string, cost long, audit string, plans {PLAN_SQL}"
    solved = stored(rows.mapInArrow(_first_round, first), "turns-pieces")
    last = solved.agg(F.max("piece")).first()[0] or 0
    parts = solved.filter("pieces > 1").select("conv_id", "piece", "plans")
    while last > 0:
        last //= fan
        together = F.transform(F.array_sort(F.collect_list(F.struct("piece", "plans"))), lambda r: F.struct(r["plans"].alias("plans")))
        grouped = parts.groupBy("conv_id", F.floor(F.col("piece") / fan).cast("long").alias("piece")).agg(together.alias("parts"))
        parts = stored(grouped.mapInArrow(_next_round, f"conv_id long, piece long, plans {PLAN_SQL}"), "turns-plans")
    whole = parts.select("conv_id", "plans").mapInArrow(_last_round, "conv_id long, cost long, audit string")
    decided = solved.filter("pieces = 1").select("conv_id", "cost", "audit").unionByName(whole)
    before = F.lag("tail").over(of.orderBy("piece"))
    broken = F.when(before.isNotNull() & ~F.concat(before, F.col("head")).isin("su", "ua", "au"), 1).otherwise(0)
    seams = solved.select("conv_id", "piece", "n", (F.col("illegal") + broken).alias("illegal"))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("piece", "n"))), lambda r: r)
    lists = seams.groupBy("conv_id").agg(sizes.alias("sizes"), F.sum("illegal").alias("illegal"))
    table = stored(decided.join(lists.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"), "turns-audits")
    shares = table.select("conv_id", "audit", "sizes").mapInArrow(_shared_out, SHARES_SQL)
    return table.select("conv_id", "cost", "audit", "illegal"), shares


def turn_role(nth: int, leading: bool) -> str:
    return "user" if (nth - leading) % 2 == 0 else "assistant"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted pieces, each a head and its rows: (head, role, text) of each repaired turn, and (head, None, None) at
    the end of each piece."""
    head, at, nth = None, 0, 0

    def inserts(stop: bool):
        nonlocal at, nth
        while at < len(head["letters"]) and head["letters"][at] == "I":
            yield head, turn_role(nth, head["leading"]), ""
            at, nth = at + 1, nth + 1
        if stop:
            yield head, None, None

    for batch in batches:
        for row in batch.to_pylist():
            if row["letters"] is not None:
                if head:
                    yield from inserts(True)
                head, at, nth = row, 0, row["kept"]
                continue
            yield from inserts(False)
            letter = head["letters"][at]
            at += 1
            if letter != "D":
                yield head, row["role"] if letter == "K" else turn_role(nth, head["leading"]), row["text"]
                nth += 1
    if head:
        yield from inserts(True)


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, size, last, nth = [], 0, None, 0
    for head, role, text in _walk(batches):
        if head is not last:
            last, nth = head, head["kept"]
        if role is not None:
            out.append({"conv_id": head["conv_id"], "nth": nth, "role": role, "text": text})
            nth, size = nth + 1, size + len(text)
        if size > BLOB or len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's repaired `role:text` lines, a line end before each: the digest if the piece is a whole
    conversation, else the bytes in parts of bounded size."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("part", pa.int64()), ("bytes", pa.binary()), ("repaired_sha256", pa.string())])
    out, held, size, part, sha, begun = [], [], 0, 0, hashlib.sha256(), False

    def line(head, parts: bytes | None, digest: str | None) -> dict:
        return {"conv_id": head["conv_id"], "piece": head["piece"], "part": part, "bytes": parts, "repaired_sha256": digest}

    for head, role, text in _walk(batches):
        if role is not None:
            said = f"\n{role}:{text}".encode()
            if head["pieces"] == 1:
                sha.update(said if begun else said[1:])
                begun = True
                continue
            held.append(said)
            size += len(said)
            if size < BLOB:
                continue
        if head["pieces"] > 1:
            out.append(line(head, b"".join(held), None))
            held, size, part = [], 0, part + 1
        else:
            out.append(line(head, None, sha.hexdigest()))
        if role is None:
            sha, begun, part = hashlib.sha256(), False, 0
        if len(out) > 1000 or out[-1]["bytes"]:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of conversations, as a stream: their digests."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, sha, begun, any_yet, out = None, None, False, False, []
    for batch in batches:
        for conv, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not any_yet or conv != now:
                if any_yet:
                    out.append({"conv_id": now, "repaired_sha256": sha.hexdigest()})
                now, sha, begun, any_yet = conv, hashlib.sha256(), False, True
            said = memoryview(data.as_buffer())
            sha.update(said if begun else said[1:])
            begun = begun or len(said) > 0
    if any_yet:
        out.append({"conv_id": now, "repaired_sha256": sha.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _dealt(rows: DataFrame, shares: DataFrame, chunk: int) -> DataFrame:
    """Rows of a piece in order after the piece's letters."""
    piece = F.floor(F.col("place") / chunk).cast("long").alias("piece")
    heads = shares.select("conv_id", "piece", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "letters", "kept", "leading", "pieces")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("letters", "string"), ("kept", "long"), ("leading", "boolean"), ("pieces", "long"))]
    both = heads.unionByName(rows.select("conv_id", piece, "place", "role", "text", *none))
    return both.repartition(partitions(rows.sparkSession), "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")


def repaired_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, nth (from 0), role and text of every turn after repair."""
    rows = ordered(turns)
    return _dealt(rows, plans(faults(rows), chunk=chunk)[1], chunk).mapInArrow(_repaired_rows, "conv_id long, nth long, role string, text string")


def repairs(turns: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row for each conversation that has rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = ordered(turns)
    marked = stored(faults(rows), "turns-faults")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = marked.groupBy("conv_id").agg(gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    audits, shares = plans(marked, fan, chunk)
    made = stored(_dealt(rows, shares, chunk).mapInArrow(_put_together, "conv_id long, piece long, part long, bytes binary, repaired_sha256 string"), "turns-texts")
    long_ones = made.filter("bytes is not null").repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece", "part")
    digests = long_ones.select("conv_id", "bytes").mapInArrow(_digested, "conv_id long, repaired_sha256 string")
    digests = made.filter("bytes is null").select("conv_id", "repaired_sha256").unionByName(digests)
    return _beside(_beside(counts, audits), digests)


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("conv_id", "_conv")
    return left.join(right, left["conv_id"].eqNullSafe(right["_conv"]), how).drop("_conv")


def op13_conversation_repair(spark, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = _beside(turns.select("conv_id").distinct(), repairs(damaged(turns)), "left")

    def known(name: str, missing) -> Column:
        return F.coalesce(F.col(name), F.lit(missing)).alias(name)

    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, known("audit", ""), known("repaired_sha256", NO_TEXT))
