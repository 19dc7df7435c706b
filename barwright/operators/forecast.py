"""Next-close forecasts: blend, settlement, bias and skill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright import fixed
from barwright.functions.expr import clip, ratio
from barwright.functions.ranking import ranked_by_day
from barwright.functions.rolling import KEY
from barwright.operators import analogue
from barwright.operators.joins import append_new


def learned_return(probs: DataFrame) -> DataFrame:
    """Expected return and move confidence from class probabilities.

    probs: KEY, p_down, p_flat, p_up, r_down, r_flat, r_up. Below the direction
    threshold the model abstains: return 0 at full confidence.
    """
    top = F.greatest("p_down", "p_flat", "p_up")
    sure = top >= fixed.MIN_DIRECTION_CONFIDENCE
    mean = F.col("p_down") * F.col("r_down") + F.col("p_flat") * F.col("r_flat") + F.col("p_up") * F.col("r_up")
    return probs.select(
        *KEY, F.when(sure, mean).otherwise(0.0).alias("ml_ret"), F.when(sure, F.lit(1.0) - F.col("p_flat")).otherwise(1.0).alias("move_confidence")
    )


def next_close(bars: DataFrame, learned: DataFrame | None = None, bias: DataFrame | None = None) -> DataFrame:
    """Forecast of every security with at least 40 bars.

    bias: KEY, return_bias.
    """
    df = analogue.one_day(bars).filter((F.col("n_rows") >= fixed.MIN_HISTORY) & (F.col("last_close") > 0))
    if learned is not None:
        df = df.join(learned, KEY, "left")
    else:
        df = df.withColumns({"ml_ret": F.lit(None).cast("double"), "move_confidence": F.lit(None).cast("double")})
    df = df.join(bias, KEY, "left") if bias is not None else df.withColumn("return_bias", F.lit(0.0))
    ml = F.col("ml_ret")
    raw = F.when(ml.isNull(), F.col("analogue_ret")).otherwise((F.col("analogue_ret") + ml) * 0.5) * F.coalesce("move_confidence", F.lit(1.0))
    shift = F.coalesce("return_bias", F.lit(0.0))
    corrected = clip(raw - shift, -0.12, 0.12)
    confidence = clip(F.lit(0.35) + F.least(F.col("samples"), F.lit(80)) / 160.0 - F.col("spread") * 4.0, 0.15, 0.85)
    return df.select(
        *KEY, "as_of", F.bround("last_close", 4).alias("last_close"), F.bround(F.col("last_close") * (corrected + 1.0), 4).alias("predicted_close"),
        F.bround(corrected, 6).alias("predicted_return"), F.bround(raw, 6).alias("raw_return"), F.bround(shift, 6).alias("return_bias"),
        F.bround(confidence, 3).alias("confidence"), F.when(ml.isNull(), "analogue+ctx+bias").otherwise("analogue+ml+ctx+bias").alias("method"), "samples",
    )


def generate(bars: DataFrame, existing: DataFrame, target_date: Column, naive_gate: bool, **kw) -> DataFrame:
    """New forecasts for a target session; existing (security, target) rows stay untouched.

    With the naive gate the unchanged close is served and the candidate kept.
    """
    f = next_close(bars, **kw).withColumn("target_date", target_date).withColumn("candidate_return", F.col("predicted_return"))
    if naive_gate:
        f = f.withColumns(
            {"predicted_close": F.col("last_close"), "predicted_return": F.lit(0.0), "method": F.concat("method", F.lit("+naive_gate"))}
        )
    return append_new(existing, f, [*KEY, "target_date"])


def settle(forecasts: DataFrame, bars: DataFrame, through: Column) -> DataFrame:
    """Errors of pending forecasts whose exact target bar exists and traded."""
    actual = bars.select(*KEY, F.col("date").alias("target_date"), F.col("close").alias("actual_close"), F.col("volume").alias("_v"))
    due = forecasts.drop("actual_close").filter((F.col("target_date") <= through) & (F.col("last_close") > 0))
    j = due.join(actual, [*KEY, "target_date"]).filter((F.col("actual_close") != 0) & (F.coalesce("_v", F.lit(1)) > 0)).drop("_v")
    err = F.abs(F.col("predicted_close") - F.col("actual_close"))
    return j.withColumns(
        {
            "abs_error": F.bround(err, 4),
            "pct_error": F.bround(err / F.col("actual_close") * 100.0, 4),
            "return_error": F.bround(F.col("predicted_return") - (F.col("actual_close") / F.col("last_close") - 1.0), 6),
        }
    )


def _maps(alpha: float, err: Column) -> Column:
    """One update of the capped bias as a map x -> clip(a*x + b, l, h)."""
    return F.struct(
        F.lit(1.0 - alpha).alias("a"), (err * alpha).alias("b"), F.lit(-fixed.BIAS_CAP).alias("l"), F.lit(fixed.BIAS_CAP).alias("h")
    )


def _after(f: Column, g: Column) -> Column:
    """g applied after f; the family is closed under composition for a >= 0."""
    inside = lambda x: F.least(F.greatest(g["a"] * x + g["b"], g["l"]), g["h"])
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), inside(f["l"]).alias("l"), inside(f["h"]).alias("h"))


def _compose(maps: Column) -> Column:
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1e300).alias("l"), F.lit(1e300).alias("h"))
    return F.aggregate(maps, identity, _after)


def global_bias(settled: DataFrame, start: float = 0.0, run: int = 1000) -> DataFrame:
    """Capped EMA of return errors over all settlements in (target_date, symbol) order.

    Updates are composed over runs of `run` neighbours of a day's order, then per
    day, then over days, so the ordered fold is an ordinary tree of groupings.
    """
    key = F.concat_ws(":", "symbol", "exchange")
    place = F.row_number().over(Window.partitionBy("target_date").orderBy(key))
    rows = settled.select("target_date", F.floor(place / run).alias("_p"), key.alias("_k"), _maps(fixed.BIAS_ALPHA_GLOBAL, F.col("return_error")).alias("m"))
    fold = lambda df, by, order: df.groupBy(*by).agg(
        _compose(F.transform(F.array_sort(F.collect_list(F.struct(order, "m"))), lambda s: s["m"])).alias("m")
    )
    days = fold(fold(rows, ["target_date", "_p"], "_k"), ["target_date"], "_p")
    total = days.agg(_compose(F.transform(F.array_sort(F.collect_list(F.struct("target_date", "m"))), lambda s: s["m"])).alias("m"), F.count(F.lit(1)).alias("days"))
    m = F.col("m")
    return total.select(F.least(F.greatest(m["a"] * start + m["b"], m["l"]), m["h"]).alias("return_bias"), "days")


def stock_bias(settled: DataFrame) -> DataFrame:
    """Capped EMA per security in date order (one settlement per day at most)."""
    g = settled.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("target_date", "return_error"))).alias("e"), F.count(F.lit(1)).alias("settled_count"))
    cap, a = fixed.BIAS_CAP, fixed.BIAS_ALPHA_STOCK
    step = lambda b, e: F.least(F.greatest(b * (1.0 - a) + e["return_error"] * a, F.lit(-cap)), F.lit(cap))
    return g.select(*KEY, F.aggregate("e", F.lit(0.0), step).alias("return_bias"), "settled_count")


def combined_bias(global_state: Column, per_stock: DataFrame, liquid: DataFrame) -> DataFrame:
    """Global bias plus the security's own once it has enough settlements."""
    own = F.when(F.col("settled_count") >= fixed.BIAS_MIN_SETTLES, F.col("return_bias")).otherwise(0.0)
    return per_stock.join(liquid.select(*KEY), KEY, "left_semi").select(*KEY, (own + global_state).alias("return_bias"))


def merge_running(batch: DataFrame, prior: DataFrame) -> DataFrame:
    """Running error means after a batch; both sides are per-exchange summaries.

    The weighted merge of the reference equals dividing merged sums.
    """
    def facts(df: DataFrame, p: str) -> DataFrame:
        actual = F.col("actual_close") / F.col("last_close") - 1.0
        moved = (F.abs(actual) > 1e-9) | (F.abs(F.col("predicted_return")) > 1e-9)
        hit = (F.col("predicted_return") >= 0) == (actual >= 0)
        err = F.abs(F.col("predicted_close") - F.col("actual_close"))
        return df.groupBy("exchange").agg(
            F.count(F.lit(1)).alias(f"{p}n"), F.avg(err).alias(f"{p}mae"), F.avg(err / F.col("actual_close") * 100.0).alias(f"{p}mape"),
            F.avg(F.when(moved, F.when(hit, 1.0).otherwise(0.0))).alias(f"{p}hit"),
        )

    j = facts(batch, "b_").join(facts(prior, "p_"), "exchange", "left")
    n0 = F.coalesce("p_n", F.lit(0))
    w = F.col("b_n") / (n0 + F.col("b_n"))
    mix = lambda c: F.when(n0 == 0, F.coalesce(f"b_{c}", F.lit(0.0))).otherwise(
        F.when(F.col(f"b_{c}").isNull(), F.col(f"p_{c}")).otherwise((F.lit(1.0) - w) * F.col(f"p_{c}") + w * F.col(f"b_{c}"))
    )
    return j.select("exchange", (n0 + F.col("b_n")).alias("settled_count"), mix("mae").alias("mae"), mix("mape").alias("mape"), mix("hit").alias("direction_hit_rate"))


def skill(settled: DataFrame, newest: int | None = None, since: Column | None = None, prediction: str = "predicted_return") -> DataFrame:
    """Served (or candidate) skill against the unchanged close, over all rows, those since a day, or the newest."""
    df = settled.filter((F.col("last_close") != 0) & (F.col("actual_close") != 0))
    if since is not None:
        df = df.filter(F.col("target_date") >= since)
    if newest is not None:
        df = df.orderBy(F.desc("target_date"), *KEY).limit(newest)
    actual, pred = F.col("actual_close") / F.col("last_close") - 1.0, F.coalesce(prediction, F.lit(0.0))
    m, b = F.abs(pred - actual), F.abs(actual)
    moved = (b > 1e-9) | (F.abs(pred) > 1e-9)
    hit = ((pred >= 0) & (actual >= 0)) | ((pred < 0) & (actual < 0))
    pct = lambda c: F.avg(F.abs(F.col(c) - F.col("actual_close")) / F.col("actual_close") * 100.0)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg(m), 6).alias("model_mae_return"), F.bround(F.avg(b), 6).alias("baseline_mae_return"),
        F.bround(pct("predicted_close"), 4).alias("model_mape"), F.bround(pct("last_close"), 4).alias("baseline_mape"),
        F.bround(F.when(F.avg(b) > 1e-12, F.lit(1.0) - F.avg(m) / F.avg(b)), 4).alias("skill_vs_naive"),
        F.bround(F.avg(F.when(m < b - 1e-12, 1.0).otherwise(0.0)), 4).alias("beats_naive_pct"),
        F.bround(F.avg(F.when(moved, F.when(hit, 1.0).otherwise(0.0))), 4).alias("direction_hit_rate"),
    )


def live_gates(served: DataFrame, candidate: DataFrame, least: int = 50) -> DataFrame:
    """Whether to take the model out of service and to serve the naive close."""
    naive = candidate.select(
        F.when((F.col("n") >= least) & F.col("skill_vs_naive").isNotNull(), F.col("skill_vs_naive") <= 0)
    ).scalar()
    return served.select(((F.col("n") >= least) & (F.col("skill_vs_naive") <= 0)).alias("downgrade_model"), naive.alias("serve_naive"))


class OrderStatistics:
    """Counts of seen values in a binary indexed tree over the ranks of all values; adding and picking take log n."""

    def __init__(self, values: np.ndarray, seen: int):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        self.rank = np.empty(len(values), np.int64)
        self.rank[order] = np.arange(1, len(values) + 1)
        marks = np.zeros(len(values) + 1, np.int64)
        marks[self.rank[:seen]] = 1
        sums, at = np.cumsum(marks), np.arange(len(values) + 1)
        self.tree = (sums - sums[at - (at & -at)]).tolist()
        self.top = 1 << max(len(values).bit_length() - 1, 0)
        self.size = seen

    def add(self, i: int) -> None:
        at = int(self.rank[i])
        while at < len(self.tree):
            self.tree[at] += 1
            at += at & -at
        self.size += 1

    def pick(self, k: int) -> float:
        """The k-th smallest seen value, k from 0."""
        at, step, left = 0, self.top, k + 1
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < left:
                at += step
                left -= self.tree[at]
            step >>= 1
        return float(self.sorted[at])

    def percentile(self, p: float) -> float:
        """Linear interpolation between neighbours in order."""
        place = (self.size - 1) * p
        low = int(place)
        a, b = self.pick(low), self.pick(min(low + 1, self.size - 1))
        return a + (b - a) * (place - low)


REPLAYED = "exchange string, symbol string, as_of date, target_date date, last_close double, actual_close double, raw double, spread double, samples int, used_bias double, predicted_return double, predicted_close double"


def _replayed(exchange: str, symbol: str, dates: np.ndarray, closes: np.ndarray, first_day) -> list[tuple]:
    """Forecast and settlement of one security, day by day; both state and percentiles go forward by one value a day."""
    fwd = closes[1:] / closes[:-1] - 1.0
    starts = [i for i in range(fixed.MIN_HISTORY - 1, len(closes) - 1) if dates[i + 1] >= first_day]
    if not starts:
        return []
    known = OrderStatistics(fwd, starts[0])
    alpha, cap, bias, rows = fixed.BIAS_ALPHA_STOCK, fixed.BIAS_CAP, 0.0, []
    for settles, i in enumerate(starts):
        while known.size < i:  # returns that ended at day i or before
            known.add(known.size)
        raw, spread = known.percentile(0.5), max(known.percentile(0.75) - known.percentile(0.25), 0.005)
        used = bias if settles >= fixed.BIAS_MIN_SETTLES else 0.0
        said = min(max(raw - used, -0.12), 0.12)
        rows.append((exchange, symbol, dates[i], dates[i + 1], float(closes[i]), float(closes[i + 1]), raw, spread, i, used, said, float(closes[i]) * (said + 1.0)))
        error = said - (closes[i + 1] / closes[i] - 1.0)
        bias = float(min(max(bias * (1.0 - alpha) + error * alpha, -cap), cap))
    return rows


def replay(bars: DataFrame, lookback: int, end: Column) -> DataFrame:
    """Walk-forward forecasts of the last days with per-security bias, no fitted model.

    Each security's closes are one calendar-bounded array. Expanding percentiles come from a tree of counts that takes one
    return a day, so a replay of the whole history takes n log n. Bars without a positive close are left out first.
    """
    arrays = analogue.close_arrays(bars.filter(F.col("close") > 0)).filter(F.size("closes") >= fixed.MIN_HISTORY + 5)
    names = [c.split()[0] for c in REPLAYED.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = _replayed(r.exchange, r.symbol, r.dates, np.asarray(r.closes, np.float64), r.first_day)
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    given = arrays.select(*KEY, "dates", "closes", F.date_sub(end, lookback).alias("first_day"))
    return given.mapInPandas(walk, REPLAYED)


def pending_and_settled(forecasts: DataFrame) -> DataFrame:
    """Newest pending and newest settled forecast per security."""
    open_day = F.when(F.col("actual_close").isNull(), F.col("target_date"))
    done_day = F.when(F.col("actual_close").isNotNull(), F.col("target_date"))
    return forecasts.groupBy(*KEY).agg(
        F.max(open_day).alias("pending_target"), F.max_by("predicted_close", open_day).alias("pending_close"),
        F.max(done_day).alias("settled_target"), F.max_by("predicted_close", done_day).alias("settled_predicted"), F.max_by("actual_close", done_day).alias("settled_actual"),
    )


def learn_status(forecasts: DataFrame) -> DataFrame:
    done = F.col("actual_close").isNotNull()
    return forecasts.agg(
        F.count_if(done).alias("settled_count"), F.count_if(~done).alias("pending_forecasts"), F.max(F.when(done, F.col("target_date"))).alias("last_settled"),
        F.max("as_of").alias("last_forecast"), F.bround(F.avg(F.abs(F.col("predicted_close") - F.col("actual_close"))), 4).alias("mae"),
    )


def shadow_report(settled: DataFrame) -> DataFrame:
    """MAE, skill, direction and recent-versus-prior trend per candidate."""
    r = ranked_by_day(settled, ["candidate"], "target_date", KEY, newest_first=True).withColumn("recent", F.col("rank") <= F.floor(F.col("group_size") / 2))
    err, base = F.abs(F.col("predicted_close") - F.col("actual_close")), F.abs(F.col("last_close") - F.col("actual_close"))
    part = lambda test: F.lit(1.0) - ratio(F.avg(F.when(test, err)), F.avg(F.when(test, base)))
    moved = F.col("actual_close") != F.col("last_close")
    same = F.signum(F.col("actual_close") - F.col("last_close")) == F.signum(F.col("predicted_close") - F.col("last_close"))
    g = r.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg(err), 4).alias("mae"), F.bround(F.avg(base), 4).alias("naive_mae"),
        F.bround(F.lit(1.0) - ratio(F.avg(err), F.avg(base)), 4).alias("skill"),
        F.bround(F.avg(F.when(moved, F.when(same, 1.0).otherwise(0.0))), 4).alias("direction"),
        (part(F.col("recent")) - part(~F.col("recent"))).alias("_d"),
    )
    trend = F.when((F.col("n") < 40) | F.col("_d").isNull(), F.lit(None).cast("string")).when(F.abs("_d") < 0.03, "stable").when(F.col("_d") > 0, "improving").otherwise("declining")
    return g.withColumn("trend", trend).drop("_d")
