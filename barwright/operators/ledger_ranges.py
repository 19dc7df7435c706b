"""Positions with very many ledger rows, replayed by ranges of rows in parallel, equal to the walk to the last digit.

Rows of such positions are sorted over tasks and cut into ranges of `RANGE` rows. What a range does depends on what
came before in two ways, and each is carried over ranges by a scan of one small row for each range:

* Quantity. Whether a sale is covered depends on the quantity held. A range maps the quantity at its start to that at
  its end by a step function (pieces of equal shift); the scan applies one function after the other.
* Cost. A sale removes its share of the cost, rounded to a unit, so exact costs cannot be added up. With quantities
  known, a range without rounding is a linear map (factor, sum) in long decimals, and its rounding errors stay within a
  bound that sales shrink. The scan gives each range a short interval of whole numbers that holds its true starting
  cost; the range walks all of them, most of which soon meet; a last scan picks the true one. The same for fees.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.rolling import KEY
from barwright.session import work_folder

POSITION = ["portfolio_id", *KEY]
RANGE = 20_000
OUT_ROWS = 2_000
AT = [*POSITION, "part", "block"]
AT_SCHEMA = "portfolio_id long, exchange string, symbol string, part int, block long"
LONG = Context(prec=80)
FEE_TO_MONEY, VALUE_TO_MONEY = 1_000_000, 100


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with part, block and nth: blocks hold at most `size` consecutive rows of a sorted part."""
    keys = [*POSITION, *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    nth = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = sorted_rows.withColumns({"part": F.shiftright("_id", 33).cast("int"), "nth": nth, "block": F.floor(nth / size).cast("long")})
    return _stored(out.drop("_id", *[c for c in order if c != "txn_id"]), "ledger-ranges")


def steps(sides: list[str], quantities: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The quantity at the end of some rows as a function of that at their start: starts of pieces from 0, and shifts."""
    low, shift = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for side, q in zip(sides, quantities):
        if side == "BUY":
            shift = shift + q
            continue
        high = np.append(low[1:], np.iinfo(np.int64).max)
        cut = q - shift  # a start of at least this much covers the sale
        inside = (cut > low) & (cut < high)
        if inside.any():
            low = np.concatenate([low, cut[inside]])
            shift = np.concatenate([shift, shift[inside]])
            order = np.argsort(low, kind="stable")
            low, shift = low[order], shift[order]
        shift = np.where(low + shift >= q, shift - q, shift)
    keep = np.append(True, np.diff(shift) != 0)
    return low[keep], shift[keep]


def covered(sides: list[str], quantities: list[int], held: int) -> tuple[list[int], list[bool]]:
    """Quantity before each row, and whether the row is taken."""
    before, taken = [], []
    for side, q in zip(sides, quantities):
        ok = side == "BUY" or q <= held
        before.append(held)
        taken.append(ok)
        held += (q if side == "BUY" else -q) if ok else 0
    return before, taken


def linear(rows: list[tuple[str, int, int]], before: list[int], taken: list[bool]) -> tuple[Decimal, Decimal, Decimal]:
    """(factor, sum, error): rows (side, quantity, amount) take a cost x to factor * x + sum, rounding off by at most
    error for an exact start."""
    factor, total, error = Decimal(1), Decimal(0), Decimal(0)
    for (side, q, amount), held, ok in zip(rows, before, taken):
        if not ok:
            continue
        if side == "BUY":
            total = LONG.add(total, Decimal(amount))
        elif q == held and held:
            factor = total = error = Decimal(0)
        elif q and held:
            kept = LONG.divide(Decimal(held - q), Decimal(held))
            factor, total, error = LONG.multiply(factor, kept), LONG.multiply(total, kept), LONG.add(LONG.multiply(error, kept), Decimal("0.5"))
    return factor, total, error


def walked(rows: list[tuple[str, int, int]], before: list[int], taken: list[bool], starts: range) -> list[int]:
    """The exact cost at the end for each starting cost; starts that meet are walked once."""
    values = list(starts)
    of = list(range(len(values)))  # which distinct value each start has come to
    for (side, q, amount), held, ok in zip(rows, before, taken):
        if not ok:
            continue
        if side == "BUY":
            values = [v + amount for v in values]
            continue
        values = [v - ((2 * v * q + held) // (2 * held) if held else 0) for v in values]
        if len(set(values)) < len(values):
            place: dict[int, int] = {}
            index = [place.setdefault(v, len(place)) for v in values]
            values, of = list(place), [index[i] for i in of]
    return [values[i] for i in of]


def _amounts(sides: list[str], q: list[int], prices: list[int], fees: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (side, quantity, amount) of the cost and of the fees."""
    return [(s, a, a * p * VALUE_TO_MONEY) for s, a, p in zip(sides, q, prices)], [(s, a, f * FEE_TO_MONEY) for s, a, f in zip(sides, q, fees)]


def _ranges(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Key and columns of each range of sorted rows; a range may span batches."""
    key, held = None, []
    for pdf in batches:
        keys, table = list(zip(*(pdf[c].tolist() for c in AT))), [pdf[c].tolist() for c in columns]
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            here = [c[start:end] for c in table]
            if keys[start] == key:
                for c, more in zip(held, here):
                    c += more
                continue
            if key is not None:
                yield key, held
            key, held = keys[start], here
    if key is not None:
        yield key, held


def _by_range(rows: DataFrame, columns: list[str], found, schema: str) -> DataFrame:
    """Rows of `found(key, *columns)` for each range; ranges of a task stream by in order, so that a short one costs little."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, table in _ranges(batches, columns):
            out += found(key, *table)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.select(*AT, "nth", *columns).repartition(*AT).sortWithinPartitions(*AT, "nth").select(*AT, *columns).mapInPandas(run, schema)


def _by_position(df: DataFrame, scan, schema: str) -> DataFrame:
    """A scan over the ranges of each position in order; rows stream by, the state is that of one position."""
    return df.repartition(*POSITION).sortWithinPartitions(*AT).mapInPandas(scan, schema)


def starting_quantities(rows: DataFrame) -> DataFrame:
    """AT and `held`, the quantity at the start of each range."""

    def first(key: tuple, sides: list[str], q: list[int]) -> list[tuple]:
        low, shift = steps(sides, q)
        return [(*key, low.tolist(), shift.tolist())]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r[:3] != key:
                    key, held = r[:3], 0
                out.append((*r[:5], held))
                held += int(r.shift[np.searchsorted(r.low, held, side="right") - 1])
            yield pd.DataFrame(out, columns=[*AT, "held"])

    functions = _by_range(rows, ["side", "_q"], first, f"{AT_SCHEMA}, low array<long>, shift array<long>")
    return _stored(_by_position(functions, scan, f"{AT_SCHEMA}, held long"), "ledger-held")


def replayed(rows: DataFrame, held: DataFrame) -> DataFrame:
    """POSITION, txn_id, before and accepted of every row, each range from its starting quantity."""

    def run(key: tuple, ids: list[int], sides: list[str], q: list[int], start: list[int]) -> list[tuple]:
        before, taken = covered(sides, q, start[0])
        return [(*key[:3], *row) for row in zip(ids, before, taken)]

    schema = "portfolio_id long, exchange string, symbol string, txn_id long, before long, accepted boolean"
    return _by_range(rows.join(held, AT), ["txn_id", "side", "_q", "held"], run, schema)


_MAPS = ["factor", "cost_sum", "cost_error", "fee_sum", "fee_error"]
_TOTALS = ["end_held", "gained", "paid", "bought", "cost_in", "fee_in", "n", "skipped", "last_skipped"]


def end_states(rows: DataFrame, held: DataFrame) -> DataFrame:
    """POSITION and, as text, held, cost, fees, realized, paid, bought, rows, skipped, last_skipped."""

    def maps(key: tuple, ids: list[int], sides: list[str], q: list[int], prices: list[int], paid: list[int], start: list[int]) -> list[tuple]:
        costs, fees = _amounts(sides, q, prices, paid)
        before, taken = covered(sides, q, start[0])
        factor, cost_sum, cost_error = linear(costs, before, taken)
        _, fee_sum, fee_error = linear(fees, before, taken)
        ok = [i for i, t in enumerate(taken) if t]
        buys, sales = [i for i in ok if sides[i] == "BUY"], [i for i in ok if sides[i] != "BUY"]
        last = before[-1] + ((q[-1] if sides[-1] == "BUY" else -q[-1]) if taken[-1] else 0)
        missed = [ids[i] for i, t in enumerate(taken) if not t]
        totals = (
            last, sum(costs[i][2] - fees[i][2] for i in sales), sum(fees[i][2] for i in ok), sum(q[i] for i in buys),
            sum(costs[i][2] for i in buys), sum(fees[i][2] for i in buys), len(q), len(missed), missed[-1] if missed else None,
        )
        return [(*key, *map(str, (factor, cost_sum, cost_error, fee_sum, fee_error)), *[None if t is None else str(t) for t in totals])]

    text = lambda names: ", ".join(f"{c} string" for c in names)
    given = ["side", "_q", "_p", "_f", "held"]
    mapped = _stored(_by_range(rows.join(held, AT), ["txn_id", *given], maps, f"{AT_SCHEMA}, {text([*_MAPS, *_TOTALS])}"), "ledger-maps")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for pdf in batches:
            out = []
            for r in pdf[[*AT, *_MAPS]].itertuples(index=False):
                if r[:3] != key:
                    key, state = r[:3], [(Decimal(0), Decimal(0))] * 2
                # half a unit more than the bound covers what 80 digits leave out
                out.append((*r[:5], *[str(int(x.to_integral_value()) + s * (int(e) + 2)) if e else str(int(x.to_integral_value())) for x, e in state for s in (-1, 1)]))
                factor = Decimal(r.factor)
                after = []
                for (x, e), total, error in zip(state, (r.cost_sum, r.fee_sum), (r.cost_error, r.fee_error)):
                    x, e = LONG.add(LONG.multiply(factor, x), Decimal(total)), LONG.add(LONG.multiply(factor, e), Decimal(error))
                    after.append((x, e if x != x.to_integral_value() or e else Decimal(0)))
                state = after
            yield pd.DataFrame(out, columns=[*AT, "cost_from", "cost_to", "fee_from", "fee_to"])

    windows = _stored(_by_position(mapped, scan, f"{AT_SCHEMA}, {text(['cost_from', 'cost_to', 'fee_from', 'fee_to'])}"), "ledger-windows")
    starts = held.join(windows, AT)

    def walk(key: tuple, sides: list[str], q: list[int], prices: list[int], paid: list[int], start: list[int], *bounds: list[str]) -> list[tuple]:
        before, taken = covered(sides, q, start[0])
        cost_from, cost_to, fee_from, fee_to = (max(0, int(b[0])) if i % 2 == 0 else int(b[0]) for i, b in enumerate(bounds))
        costs, fees = _amounts(sides, q, prices, paid)
        ends = [walked(costs, before, taken, range(cost_from, cost_to + 1)), walked(fees, before, taken, range(fee_from, fee_to + 1))]
        return [(*key, str(cost_from), str(fee_from), *[list(map(str, e)) for e in ends])]

    bounds = ["cost_from", "cost_to", "fee_from", "fee_to"]
    exact = _by_range(rows.join(starts, AT), [*given, *bounds], walk, f"{AT_SCHEMA}, cost_from string, fee_from string, costs array<string>, fees array<string>")
    picked = exact.join(mapped.select(*AT, *_TOTALS), AT)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def done() -> pd.DataFrame:
            amounts = [format(Decimal(v).scaleb(-d), "f") for v, d in zip(state, (4, 10, 10, 10, 10, 4))]
            return pd.DataFrame([(*key, *amounts, *[None if v is None else str(v) for v in state[6:]])], columns=[*POSITION, *END])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r[:3] != key:
                    if key is not None:
                        yield done()
                    key, state = r[:3], [0] * 8 + [None]
                cost = int(r.costs[state[1] - int(r.cost_from)])
                fees = int(r.fees[state[2] - int(r.fee_from)])
                gone = state[1] + int(r.cost_in) - cost + state[2] + int(r.fee_in) - fees
                state = [
                    int(r.end_held), cost, fees, state[3] + int(r.gained) - gone, state[4] + int(r.paid), state[5] + int(r.bought),
                    state[6] + int(r.n), state[7] + int(r.skipped), state[8] if r.last_skipped is None else int(r.last_skipped),
                ]
        if key is not None:
            yield done()

    return _by_position(picked, pick, f"portfolio_id long, exchange string, symbol string, {text(END)}")


END = ["held", "cost", "fees", "realized", "paid", "bought", "rows", "skipped", "last_skipped"]
