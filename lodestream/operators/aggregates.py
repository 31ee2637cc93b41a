"""Aggregates over time windows.

An aggregate is a function of time: its result at T is that over the rows live at T. `aggregate` gives it as a history,
one row per key and moment at which a live set changes; `aggregate_asof` gives it at moments asked for, without
writing the history down. Rows live from their time on: for good in a "forever" window, for the duration and a
second in a continuous one, and in tumbling and hopping windows from the end of their window for one stride.

Counts and sums of continuous windows are sums of +1 at a row's start and -1 at its end, run up in two steps: within
time buckets of a key, and over the buckets' totals. No key is run up as a whole in one task. A unique count is such a
sum too: a value counts from a row of it until its next row or the end of the window. Decaying sums are run up in the
same way, with values brought to the end of a stretch of a hundred mean lives, and from stretch to stretch. The other aggregates
use range frames, over buckets where their windows are bounded. Tumbling and hopping windows are aggregated per stride
first, and windows are put together from strides; sessions are numbered in time buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.operators.temporal import VALID_TO, next_time, number_sessions
from lodestream.runtime import micros

SECOND_US = 1_000_000
#: A decayed sum of at most so much is none (a fixed value).
NOTHING = math.exp(-25)
BUCKET_US = 86_400_000_000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Spec:
    """An aggregate: of a column, over a window, into a field."""

    of: str | None = None
    window: Any = t.Continuous()
    into_field: str = ""

    invertible = False
    #: How the parts of strides become those of a window: "sum", "min", "max", "lists" or "sets".
    merges = ()

    def result(self, of: t.DType | None) -> t.DType:
        """The result's type; TypeError_ for columns the aggregate does not take."""
        raise NotImplementedError

    def value(self) -> Column:
        return _q(self.of) if self.of else F.lit(1)

    def parts(self, live: Column, rank: Column) -> list[Column]:
        """Aggregate columns over a group or frame; live marks the rows that count, rank orders them."""
        raise NotImplementedError

    def finish(self, parts: list[Column], at: Column) -> Column:
        return parts[0]

    def pane(self, live: Column, rank: Column) -> list[Column]:
        """The parts of a stride, one for each of merges."""
        return self.parts(live, rank)

    def merged(self, parts: list[Column], at: Column) -> Column:
        """The result from merged parts."""
        return self.finish(parts, at)

    def empty(self, of: t.DType | None) -> Column:
        return F.lit(None).cast(t.required(self.result(of)).spark())


def _when(live: Column, c: Column) -> Column:
    return F.when(live, c)


@dataclass(frozen=True)
class Count(Spec):
    unique: bool = False
    approx: bool = False
    dropnull: bool = False

    def __post_init__(self):
        if self.unique and not self.approx:
            raise t.TypeError_("a unique count needs approx=True")
        if (self.unique or self.dropnull) and not self.of:
            raise t.TypeError_("unique and dropnull need a column")

    @property
    def invertible(self):
        return not self.unique

    @property
    def merges(self):
        return ("sets",) if self.unique else ("sum",)

    def result(self, of):
        if self.unique and not t.hashable(of):
            raise t.TypeError_(f"{of} can't be counted uniquely")
        if self.dropnull and not of.optional:
            raise t.TypeError_(f"dropnull needs an optional column, not {of}")
        return t.Int

    def parts(self, live, rank):
        if self.unique:
            one = F.when(live & (_q(self.of).isNotNull() if self.dropnull else F.lit(True)), F.struct(_q(self.of).alias("v")))
            return [F.collect_set(one)]
        return [F.count(_when(live & (_q(self.of).isNotNull() if self.dropnull else F.lit(True)), F.lit(1)))]

    def finish(self, parts, at):
        return F.size(parts[0]).cast("bigint") if self.unique else parts[0]

    def deltas(self):
        return [F.when(_q(self.of).isNotNull(), 1).otherwise(0).cast("bigint") if self.dropnull else F.lit(1).cast("bigint")]

    def run_up(self, sums):
        return sums[0]

    def empty(self, of):
        return F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Sum(Spec):
    invertible = True
    merges = ("sum",)

    def result(self, of):
        if not t.numeric(of) and not isinstance(t.required(of), t.Decimal):
            raise t.TypeError_(f"{of} can't be summed")
        return t.required(of).base

    def parts(self, live, rank):
        return [F.sum(_when(live, _q(self.of)))]

    def finish(self, parts, at):
        return F.coalesce(parts[0], F.lit(0))

    def deltas(self):
        return [F.coalesce(_q(self.of), F.lit(0))]

    def run_up(self, sums):
        return sums[0]

    def empty(self, of):
        return F.lit(0).cast(self.result(of).spark())


def _default(value: Any, of: t.DType) -> Column:
    return F.lit(value).cast(t.required(of).spark())


@dataclass(frozen=True)
class Average(Spec):
    default: float | None = 0.0
    invertible = True
    merges = ("sum", "sum")

    def result(self, of):
        if not t.numeric(of) and not isinstance(t.required(of), t.Decimal):
            raise t.TypeError_(f"{of} has no average")
        out = t.required(of) if isinstance(t.required(of), t.Decimal) else t.Float
        return t.optional(out) if self.default is None else out

    def parts(self, live, rank):
        return [F.avg(_when(live, _q(self.of)))]

    def finish(self, parts, at):
        return parts[0] if self.default is None else F.coalesce(parts[0], F.lit(self.default))

    def pane(self, live, rank):
        return [F.sum(_when(live, _q(self.of))), F.count(_when(live, _q(self.of)))]

    def merged(self, parts, at):
        return self.run_up([F.coalesce(parts[0], F.lit(0)), parts[1]])

    def deltas(self):
        v = _q(self.of)
        return [F.coalesce(v, F.lit(0)), F.when(v.isNotNull(), 1).otherwise(0).cast("bigint")]

    def run_up(self, sums):
        mean = F.when(sums[1] > 0, sums[0].cast("double") / sums[1])
        return mean if self.default is None else F.coalesce(mean, F.lit(float(self.default)))

    def empty(self, of):
        return _default(self.default, self.result(of))


@dataclass(frozen=True)
class _Extreme(Spec):
    default: Any = None

    def result(self, of):
        inner = t.required(of).base
        if inner not in (t.Int, t.Float, t.Date, t.Datetime) and not isinstance(inner, t.Decimal):
            raise t.TypeError_(f"{of} has no least and greatest")
        return t.optional(inner) if self.default is None else inner

    def parts(self, live, rank):
        return [(F.min if isinstance(self, Min) else F.max)(_when(live, _q(self.of)))]

    def finish(self, parts, at):
        return parts[0] if self.default is None else F.coalesce(parts[0], F.lit(self.default))

    def empty(self, of):
        return _default(self.default, self.result(of))


@dataclass(frozen=True)
class Min(_Extreme):
    merges = ("min",)


@dataclass(frozen=True)
class Max(_Extreme):
    merges = ("max",)


@dataclass(frozen=True)
class Stddev(Spec):
    """Of the population."""

    default: float | None = -1.0

    def result(self, of):
        if not t.numeric(of) and not isinstance(t.required(of), t.Decimal):
            raise t.TypeError_(f"{of} has no standard deviation")
        return t.optional(t.Float) if self.default is None else t.Float

    def parts(self, live, rank):
        return [F.stddev_pop(_when(live, _q(self.of)))]

    def finish(self, parts, at):
        return parts[0] if self.default is None else F.coalesce(parts[0], F.lit(float(self.default)))

    merges = ("lists",)

    def pane(self, live, rank):
        v = _when(live, _q(self.of).cast("double"))
        return [F.array(F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v")))]

    def merged(self, parts, at):
        known = F.filter(parts[0], lambda x: x["n"] > 0)
        n = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x["n"] * x["m"]), n.cast("double"))
        square = F.aggregate(known, F.lit(0.0), lambda a, x: a + x["n"] * (x["v"] + (x["m"] - mean) * (x["m"] - mean)))
        return self.finish([F.sqrt(F.try_divide(square, n.cast("double")))], at)

    def empty(self, of):
        return _default(self.default, t.Float)


@dataclass(frozen=True)
class Quantile(Spec):
    """The value at position floor(p * n) of the n sorted values; with sketch, an approximation of bounded memory, which
    windows over all time always have (relative error of rank 1e-4, and none for up to 10,000 values)."""

    merges = ("lists",)

    p: float = 0.5
    default: float | None = None
    approx: bool = True
    sketch: bool = False

    def __post_init__(self):
        if not self.approx:
            raise t.TypeError_("a quantile needs approx=True")
        if not 0 <= self.p <= 1:
            raise t.TypeError_("p is between 0 and 1")

    def result(self, of):
        if not t.numeric(of) and not isinstance(t.required(of), t.Decimal):
            raise t.TypeError_(f"{of} has no quantiles")
        return t.optional(t.Float) if self.default is None else t.Float

    def parts(self, live, rank):
        v = _when(live, _q(self.of).cast("double"))
        # the sketch gives the value of rank ceil(p * n), counted from 1: the least step more makes it floor(p * n) + 1
        return [F.percentile_approx(v, min(1.0, self.p + 1e-12), 10_000) if self.sketched else F.collect_list(v)]

    @property
    def sketched(self) -> bool:
        return self.sketch or (isinstance(self.window, t.Continuous) and self.window.us is None)

    def pane(self, live, rank):
        return [F.collect_list(_when(live, _q(self.of).cast("double")))]

    def merged(self, parts, at):
        from dataclasses import replace

        return replace(self, window=t.Continuous("1d"), sketch=False).finish(parts, at)

    def finish(self, parts, at):
        if self.sketched:
            found = parts[0]
        else:
            n = F.size(parts[0])
            place = F.least(n - 1, F.floor(F.lit(self.p) * n)).cast("int")
            found = F.when(n > 0, F.get(F.sort_array(parts[0]), place))
        return found if self.default is None else F.coalesce(found, F.lit(float(self.default)))

    def empty(self, of):
        return _default(self.default, t.Float)


@dataclass(frozen=True)
class Distinct(Spec):
    """The distinct values, in ascending order with null first."""

    unordered: bool = False
    dropnull: bool = False
    merges = ("sets",)

    def __post_init__(self):
        if not self.unordered:
            raise t.TypeError_("distinct values need unordered=True")

    def result(self, of):
        if not t.hashable(of):
            raise t.TypeError_(f"{of} has no distinct values")
        return t.List(t.required(of) if self.dropnull else of)

    def parts(self, live, rank):
        return [F.collect_set(F.when(live & (_q(self.of).isNotNull() if self.dropnull else F.lit(True)), F.struct(_q(self.of).alias("v"))))]

    def finish(self, parts, at):
        return F.transform(F.sort_array(parts[0]), lambda x: x["v"])

    def empty(self, of):
        return F.array().cast(self.result(of).spark())


@dataclass(frozen=True)
class LastK(Spec):
    """The latest values, newest first."""

    limit: int = 1
    dedup: bool = False
    dropnull: bool = False
    merges = ("lists",)

    def result(self, of):
        if self.limit < 1:
            raise t.TypeError_("limit is at least 1")
        return t.List(t.required(of) if self.dropnull else of)

    def parts(self, live, rank):
        keep = live & (_q(self.of).isNotNull() if self.dropnull else F.lit(True))
        return [F.collect_list(F.when(keep, F.struct(rank.alias("r"), _q(self.of).alias("v"))))]

    def ordered(self, rows: Column) -> Column:
        return F.reverse(F.sort_array(F.transform(rows, lambda x: F.struct(x["r"], x["v"]))))

    def finish(self, parts, at):
        values = F.transform(self.ordered(parts[0]), lambda x: x["v"])
        return F.slice(F.array_distinct(values) if self.dedup else values, 1, self.limit)

    def pane(self, live, rank):
        rows = self.ordered(self.parts(live, rank)[0])
        return [F.transform(rows if self.dedup else F.slice(rows, 1, self.limit), lambda x: F.struct(x["r"].alias("r"), x["v"].alias("v")))]

    def empty(self, of):
        return F.array().cast(self.result(of).spark())


@dataclass(frozen=True)
class FirstK(LastK):
    """The earliest values, oldest first."""

    def ordered(self, rows: Column) -> Column:
        return F.sort_array(F.transform(rows, lambda x: F.struct(x["r"], x["v"])))


@dataclass(frozen=True)
class ExpDecaySum(Spec):
    """The sum of values that halve every half_life. A history holds the sum at its own times; see decay()."""

    half_life: str = ""

    def __post_init__(self):
        if t.duration_us(self.half_life) <= 0:
            raise t.TypeError_("a half life is positive")

    @property
    def rate(self) -> float:
        """Per second."""
        return math.log(2) / (t.duration_us(self.half_life) / SECOND_US)

    merges = ("lists",)

    def result(self, of):
        if not t.numeric(of):
            raise t.TypeError_(f"{of} can't be summed")
        return t.Float

    def parts(self, live, rank):
        return [F.collect_list(F.when(live & _q(self.of).isNotNull(), F.struct(rank.getField("t").alias("t"), _q(self.of).cast("double").alias("v"))))]

    def finish(self, parts, at):
        factor = lambda x: F.exp((x["t"] - at).cast("double") / SECOND_US * self.rate)
        side = lambda keep: F.aggregate(F.filter(parts[0], keep), F.lit(0.0), lambda a, x: a + F.abs(x["v"]) * factor(x))
        return self.told(side(lambda x: x["v"] > 0), side(lambda x: x["v"] < 0))

    def told(self, gains: Column, losses: Column) -> Column:
        """The sum from the decayed sums of the positive and of the negative values, each of which counts as nothing once it is at most NOTHING."""
        return F.when(gains > NOTHING, gains).otherwise(0.0) - F.when(losses > NOTHING, losses).otherwise(0.0)

    def decay(self, value: Column, since_us: Column) -> Column:
        """The sum after so much time without a change."""
        return value * F.exp(-since_us.cast("double") / SECOND_US * self.rate)

    def empty(self, of):
        return F.lit(0.0)


# -- continuous windows ----------------------------------------------------------------------------------------


def _until(window: Any, start: Column, valid_to: Column | None) -> Column:
    """The time at which a row stops being live; null for never."""
    ends = [] if window.us is None else [start + F.lit(window.us + SECOND_US)]
    if valid_to is not None:
        ends.append(valid_to)
    return F.lit(None).cast("bigint") if not ends else ends[0] if len(ends) == 1 else F.least(*ends)


def _reach(s: Spec) -> int | None:
    """How long after its time a row may still count; None for ever."""
    return s.window.us + SECOND_US if s.window.us is not None else None


def _bounded_list(s: Spec, both: DataFrame, keys: list[str], has_end: bool) -> tuple[DataFrame, Column] | None:
    """For lists of the first or last values over all time: both, with what the list needs of each row, and the column of
    rows to make it from, of at most limit rows at any time. None for other aggregates, whose frames hold what they must.

    Only the first limit rows of a key can be in its list of first values. The last ones at a time are those of the rows
    before it, so each row carries them, and a time takes them from its last row.
    """
    if not isinstance(s, LastK) or s.window.us is not None or has_end or s.dedup:
        return None
    rank = F.struct(F.col("_t").alias("t"), F.col("_o").alias("o"))
    counts = F.col("_row") & F.col("_own") & (_q(s.of).isNotNull() if s.dropnull else F.lit(True))
    entry = F.struct(rank.alias("r"), _q(s.of).alias("v"))
    name = f"_list_{s.into_field}"
    in_order = Window.partitionBy(*keys, counts).orderBy("_t", "_o")
    until = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    if isinstance(s, FirstK):
        marked = both.withColumn(name, F.when(counts & (F.row_number().over(in_order) <= s.limit), entry))
        return marked, F.collect_list(name).over(until)
    carried = both.withColumn(name, F.when(counts, F.struct(rank.alias("r"), F.collect_list(entry).over(in_order.rowsBetween(1 - s.limit, 0)).alias("l"))))
    return carried, F.coalesce(F.max_by(F.col(name)["l"], F.col(name)["r"]).over(until), F.array())


def run_up(deltas: DataFrame, keys: list[str], columns: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Running sums of columns by time _t (one row per key and time), in two steps through buckets."""
    deltas = deltas.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    over_buckets = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = deltas.groupBy(*keys, "_b").agg(*(F.sum(c).alias(c) for c in columns))
    carried = totals.select(*keys, "_b", *(F.coalesce(F.sum(c).over(over_buckets), F.lit(0)).alias(f"{c}_c") for c in columns))
    within = Window.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.join(carried, [*keys, "_b"]).select(*keys, "_t", *((F.sum(c).over(within) + F.col(f"{c}_c")).alias(c) for c in columns))


def _decayed(rows: DataFrame, keys: list[str], s: ExpDecaySum, end: Column, asked: DataFrame, kind: Any) -> DataFrame:
    """keys, _t and the decayed sum at the times asked for (distinct keys and _t).

    Time is cut into stretches of a hundred mean lives. A row adds its value, brought to the end of the stretch it is in, and
    its end takes it away again, brought to the end of that stretch; run up within the stretch, this gives the sum at any
    time of it. What earlier stretches leave is summed over eight of them: beyond that, a factor of exp(-800) makes
    nothing of any sum of doubles.
    """
    life_us = SECOND_US / s.rate
    stretch = max(1, int(100 * life_us))
    width = min(BUCKET_US, stretch)
    no = lambda c: F.floor(c / F.lit(stretch))
    value = _q(s.of).cast("double")
    brought = lambda at: F.exp((F.col("_t") - (no(at) + 1) * F.lit(stretch)).cast("double") / F.lit(life_us))
    side = lambda c, at, sign: F.when(c > 0, c * brought(at) * sign).otherwise(0.0)
    moves = F.array(*(F.struct(at.alias("_t"), side(value, at, sign).alias("_gain"), side(-value, at, sign).alias("_loss")) for at, sign in ((F.col("_t"), 1.0), (end, -1.0))))
    deltas = rows.where(value.isNotNull()).select(*keys, F.explode(moves).alias("_e")).select(*keys, "_e.*").where("_t IS NOT NULL")
    columns = ["_gain", "_loss"]
    deltas = deltas.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    deltas = deltas.groupBy(*keys, "_t").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns), F.max("_asked").alias("_asked")).withColumn("_n", no(F.col("_t")))
    summed = run_up(deltas, [*keys, "_n"], columns, width)
    totals = deltas.groupBy(*keys, "_n").agg(*(F.sum(c).alias(c) for c in columns))
    before = Window.partitionBy(*keys).orderBy("_n").rangeBetween(-9, -1)
    earlier = lambda c: F.collect_list(F.struct("_n", F.col(c).alias("s"))).over(before)
    left = [F.aggregate(earlier(c), F.lit(0.0), lambda a, x: a + x["s"] * F.exp((x["_n"] + 1 - F.col("_n")).cast("double") * 100.0)) for c in columns]
    carried = totals.select(*keys, "_n", *(x.alias(f"{c}_c") for x, c in zip(left, columns, strict=True)))
    met = summed.join(carried, [*keys, "_n"]).join(asked, [*keys, "_t"], "left_semi")
    start = F.col("_n") * F.lit(stretch)
    since = lambda at: (at - F.col("_t")).cast("double") / F.lit(life_us)
    now = [F.col(c) * F.exp(since(start + F.lit(stretch))) + F.col(f"{c}_c") * F.exp(since(start)) for c in columns]
    return met.select(*keys, "_t", s.told(*now).cast(kind).alias(s.into_field))


def _first_seen(rows: DataFrame, keys: list[str], s: Count, end: Column, column: str) -> DataFrame:
    """Changes of a unique count: +1 at a row of a value, -1 at the value's next row or where the row's life ends."""
    seen = rows.where(_q(s.of).isNotNull()) if s.dropnull else rows
    seen = seen.select(*keys, F.struct(_q(s.of).alias("v")).alias("_v"), "_t").distinct()
    ahead = next_time(seen, [*keys, "_v"], "_t", "_nx").withColumn("_until", F.least(F.col("_nx"), end))
    moves = F.array(F.struct(F.col("_t").alias("_t"), F.lit(1).cast("bigint").alias(column)), F.struct(F.col("_until").alias("_t"), F.lit(-1).cast("bigint").alias(column)))
    return ahead.select(*keys, F.explode(moves).alias("_e")).select(*keys, "_e.*").where("_t IS NOT NULL")


def _continuous(rows: DataFrame, keys: list[str], specs: list[Spec], types: dict[str, t.DType], points: DataFrame | None) -> DataFrame:
    """Values of specs at each change (points None), or at points (keys, _t). rows has _t, _end, _o and columns."""
    has_end = "_end" in rows.columns
    fast = [s for s in specs if s.invertible]
    uniques = [s for s in specs if isinstance(s, Count) and s.unique and not has_end]
    decays = [s for s in specs if isinstance(s, ExpDecaySum)]
    slow = [s for s in specs if s not in fast and s not in uniques and s not in decays]
    end_of = lambda s: _until(s.window, F.col("_t"), F.col("_end") if has_end else None)
    windows = list({s.window: None for s in specs})
    moments = F.array(F.col("_t"), *(end_of(s) for s in {w: next(x for x in specs if x.window == w) for w in windows}.values()))
    parts = []
    if fast or uniques:
        columns, made = [], []
        for i, s in enumerate(fast):
            for j, d in enumerate(s.deltas()):
                made.append((s, f"_s{i}_{j}", d))
                columns.append(f"_s{i}_{j}")
        events = []
        for w in dict.fromkeys(s.window for s in fast):
            member = next(s for s in fast if s.window == w)
            for at, sign in ((F.col("_t"), 1), (end_of(member), -1)):
                events.append(
                    F.struct(at.alias("_t"), *((d if sign > 0 else -d).alias(c) if s.window == w else (d * 0).alias(c) for s, c, d in made))
                )
        changes = [rows.select(*keys, F.explode(F.array(*events)).alias("_e")).select(*keys, "_e.*").where("_t IS NOT NULL")] if fast else []
        for i, s in enumerate(uniques):
            changes.append(_first_seen(rows, keys, s, end_of(s), f"_u{i}"))
            columns.append(f"_u{i}")
        if points is None and (slow or decays or uniques):
            changes.append(rows.select(*keys, F.explode(moments).alias("_t")).where("_t IS NOT NULL").distinct())
        if points is not None:
            changes.append(points.select(*keys, "_t").distinct().withColumn("_asked", F.lit(True)))
        deltas = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)
        asked = [F.max("_asked").alias("_asked")] if points is not None else []
        deltas = deltas.groupBy(*keys, "_t").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns), *asked)
        summed = run_up(deltas, keys, columns)
        if points is not None:
            summed = summed.join(points.select(*keys, "_t").distinct(), [*keys, "_t"], "left_semi")
        out = []
        for i, s in enumerate(fast):
            n = len(s.deltas())
            kind = t.required(s.result(types.get(s.of))).spark()
            out.append(s.run_up([F.col(f"_s{i}_{j}") for j in range(n)]).cast(kind).alias(s.into_field))
        out += [F.col(f"_u{i}").cast("bigint").alias(s.into_field) for i, s in enumerate(uniques)]
        parts.append(summed.select(*keys, "_t", *out))
    if decays:
        asked = points.select(*keys, "_t").distinct() if points is not None else rows.select(*keys, F.explode(moments).alias("_t")).where("_t IS NOT NULL").distinct()
        parts += [_decayed(rows, keys, s, end_of(s), asked, t.Float.spark()) for s in decays]
    if slow:
        used = list(dict.fromkeys(s.of for s in slow))
        base = rows.select(*keys, "_t", "_o", *(["_end"] if has_end else []), *map(_q, used), F.lit(True).alias("_row"))
        asked = points.select(*keys, "_t").distinct() if points is not None else rows.select(*keys, F.explode(moments).alias("_t")).where("_t IS NOT NULL").distinct()
        # frames of bounded windows reach back into the bucket before at most: rows near a bucket's end are given to
        # both, and no key is framed as a whole; frames without a bound go over the whole key
        reaches = [r for r in (_reach(s) for s in slow) if r is not None]
        width = max([BUCKET_US, *reaches])
        own = F.floor(F.col("_t") / F.lit(width))
        spill = F.col("_t") + F.lit(max(reaches, default=0)) >= (own + 1) * width
        buckets = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own)) if reaches else F.array(own)
        spread = base.withColumn("_home", own).withColumn("_b", F.explode(buckets)).withColumn("_own", F.col("_b") == F.col("_home")).drop("_home")
        both = spread.unionByName(asked.withColumns({"_row": F.lit(False), "_b": own, "_own": F.lit(True)}), allowMissingColumns=True)
        out = []
        for s in slow:
            if (short := _bounded_list(s, both, keys, has_end)) is not None:
                both, listed = short
                out.append((s, [listed]))
                continue
            reach = _reach(s)
            partition = [*keys, "_b"] if reach is not None else keys
            frame = Window.partitionBy(*partition).orderBy("_t").rangeBetween(Window.unboundedPreceding if reach is None else -(reach - 1), 0)
            counts = F.col("_row") if reach is not None else F.col("_row") & F.col("_own")
            rank = F.struct(F.col("_t").alias("t"), F.col("_o").alias("o"))
            if not has_end:
                out.append((s, [p.over(frame) for p in s.parts(counts, rank)]))
            else:
                # rows may end before the frame does: take the frame's rows, drop those that ended, and aggregate
                live = F.collect_list(F.when(counts, F.struct(rank.alias("r"), _q(s.of).alias("v"), F.col("_end").alias("e")))).over(frame)
                out.append((s, [live]))
        if not has_end:
            valued = both.select(*keys, "_t", "_row", *(p.alias(f"_p{i}_{j}") for i, (_, ps) in enumerate(out) for j, p in enumerate(ps))).where("NOT _row")
            finished = [
                s.finish([F.col(f"_p{i}_{j}") for j in range(len(ps))], F.col("_t")).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field)
                for i, (s, ps) in enumerate(out)
            ]
            parts.append(valued.select(*keys, "_t", *finished))
        else:
            valued = both.select(*keys, "_t", "_row", *(ps[0].alias(f"_p{i}") for i, (_, ps) in enumerate(out))).where("NOT _row")
            for i, (s, _) in enumerate(out):
                kept = F.filter(F.col(f"_p{i}"), lambda x: x["e"].isNull() | (x["e"] > F.col("_t")))
                valued = valued.withColumn(f"_p{i}", kept)
            finished = [_of_list(s, F.col(f"_p{i}")).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field) for i, (s, _) in enumerate(out)]
            parts.append(valued.select(*keys, "_t", *finished))
    return reduce(lambda a, b: a.join(b, [*keys, "_t"]), parts)


def _of_list(s: Spec, rows: Column) -> Column:
    """A spec over a list of struct(r, v, e) of live rows."""
    values = F.transform(rows, lambda x: x["v"])
    known = F.filter(values, lambda v: v.isNotNull())
    if isinstance(s, Count):
        return s.finish([F.array_distinct(known if s.dropnull else values)], F.col("_t"))
    if isinstance(s, _Extreme):
        return s.finish([F.array_min(known) if isinstance(s, Min) else F.array_max(known)], F.col("_t"))
    if isinstance(s, Stddev):
        n = F.size(known)
        mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v.cast("double")), n.cast("double"))
        square = F.aggregate(known, F.lit(0.0), lambda a, v: a + F.pow(v.cast("double") - mean, F.lit(2.0)))
        return s.finish([F.sqrt(F.try_divide(square, n.cast("double")))], F.col("_t"))
    if isinstance(s, Quantile):
        return Quantile(s.of, t.Continuous("1d"), s.into_field, s.p, s.default).finish([F.transform(known, lambda v: v.cast("double"))], F.col("_t"))
    if isinstance(s, Distinct):
        return F.sort_array(F.array_distinct(known if s.dropnull else values))
    if isinstance(s, LastK):
        kept = F.filter(rows, lambda x: x["v"].isNotNull()) if s.dropnull else rows
        return s.finish([kept], F.col("_t"))
    pairs = F.transform(F.filter(rows, lambda x: x["v"].isNotNull()), lambda x: F.struct(x["r"]["t"].alias("t"), x["v"].cast("double").alias("v")))
    return s.finish([pairs], F.col("_t"))


# -- discrete windows ------------------------------------------------------------------------------------------


def window_ends(at: Column, window: Any) -> Column:
    """Ends of the tumbling or hopping windows a time is in, on multiples of the stride since 1970."""
    stride = F.lit(window.stride_us)
    first = F.call_function("div", at, stride) * stride + stride  # the next multiple after at
    first = F.when((at < 0) & (F.pmod(at, stride) != 0), first - stride).otherwise(first)
    if isinstance(window, t.Tumbling) or window.us == window.stride_us:
        return F.array(first)
    if window.us is None:
        return F.array(first)
    # starts are multiples of the stride with start <= at < start + duration; ends are starts plus duration
    last_start = first - stride
    low = at - F.lit(window.us)
    earliest = (F.floor(low / stride) + 1) * stride
    return F.transform(F.sequence(earliest, last_start, stride), lambda s: s + F.lit(window.us))


def _frontier(rows: DataFrame, window: Any, until_us: int | None) -> Column:
    return rows.agg(F.max("_t") - window.lookback_us).scalar() if until_us is None else F.lit(until_us)


def _discrete(rows: DataFrame, keys: list[str], specs: list[Spec], types: dict[str, t.DType], window: Any, until_us: int | None = None) -> DataFrame:
    """(keys, _t, fields): values published at window ends, and the defaults once a window is over."""
    rank = F.struct(F.col("_t").alias("t"), F.col("_o").alias("o"))
    live = F.lit(True)
    names = [f"_p{i}_{j}" for i, s in enumerate(specs) for j in range(len(s.parts(live, rank)))]
    aggregates = [p.alias(n) for p, n in zip([p for s in specs for p in s.parts(live, rank)], names, strict=True)]

    def finished(df: DataFrame) -> DataFrame:
        out, k = [], 0
        for s in specs:
            n = len(s.parts(live, rank))
            out.append(s.finish([F.col(x) for x in names[k : k + n]], F.col("_t")).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field))
            k += n
        return df.select(*keys, "_t", *out)

    if isinstance(window, t.Session):
        numbered = number_sessions(rows, keys, "_t", window.gap_us, False, "_no")
        sessions = numbered.groupBy(*keys, "_no").agg(F.max("_t").alias("_last"), *aggregates)
        return finished(sessions.withColumn("_t", F.col("_last") + 1))
    frontier = _frontier(rows, window, until_us)
    if window.us is None:
        # never over: visible from the next stride on, running up over the strides
        ends = rows.withColumn("_at", F.element_at(window_ends(F.col("_t"), window), 1))
        used = list(dict.fromkeys(s.of for s in specs if s.of))
        moved = ends.select(*keys, F.col("_at").alias("_t"), "_o", *map(_q, used))
        values = _continuous(moved, keys, [_with_window(s, t.Continuous()) for s in specs], types, None)
        return values.where(F.col("_t") <= frontier)
    if window.us == window.stride_us:
        ended = rows.withColumn("_at", F.element_at(window_ends(F.col("_t"), window), 1))
        values = finished(ended.groupBy(*keys, "_at").agg(*aggregates).withColumnRenamed("_at", "_t"))
    else:
        values = _from_panes(rows, keys, specs, types, window)
    values = values.where(F.col("_t") <= frontier)
    over = values.select(*keys, (F.col("_t") + window.stride_us).alias("_t")).where(F.col("_t") <= frontier).join(values.select(*keys, "_t"), [*keys, "_t"], "left_anti")
    empties = over.select(*keys, "_t", *(s.empty(types.get(s.of)).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field) for s in specs))
    return values.unionByName(empties)


def _from_panes(rows: DataFrame, keys: list[str], specs: list[Spec], types: dict[str, t.DType], window: Any) -> DataFrame:
    """Values of hopping windows. Rows are aggregated to panes between neighbouring borders of windows (ends and starts), so
    not rows but panes, with what is left of their rows, are copied to the windows they are in."""
    rank = F.struct(F.col("_t").alias("t"), F.col("_o").alias("o"))
    names = [[f"_p{i}_{j}" for j in range(len(s.merges))] for i, s in enumerate(specs)]
    # rows that agree in the earliest and in the latest window they are in agree in all
    first = (F.floor((F.col("_t") - F.lit(window.us)) / F.lit(window.stride_us)) + 1).alias("_e1")
    panes = rows.groupBy(*keys, first, F.floor(F.col("_t") / F.lit(window.stride_us)).alias("_e2")).agg(
        F.min("_t").alias("_t"), *(p.alias(n) for s, ns in zip(specs, names, strict=True) for p, n in zip(s.pane(F.lit(True), rank), ns, strict=True))
    )
    spread = panes.withColumn("_at", F.explode(window_ends(F.col("_t"), window))).drop("_t", "_e1", "_e2")
    how = {"sum": F.sum, "min": F.min, "max": F.max, "lists": lambda c: F.flatten(F.collect_list(c)), "sets": lambda c: F.array_distinct(F.flatten(F.collect_list(c)))}
    merged = spread.groupBy(*keys, "_at").agg(*(how[m](n).alias(n) for s, ns in zip(specs, names, strict=True) for m, n in zip(s.merges, ns, strict=True)))
    merged = merged.withColumnRenamed("_at", "_t")
    out = [s.merged([F.col(n) for n in ns], F.col("_t")).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field) for s, ns in zip(specs, names, strict=True)]
    return merged.select(*keys, "_t", *out)


def _with_window(s: Spec, window: Any) -> Spec:
    from dataclasses import replace

    return replace(s, window=window)


def _prepared(df: DataFrame, keys: list[str], ts: str, specs: list[Spec], order: list[str] | None, along: str | None) -> DataFrame:
    used = list(dict.fromkeys(s.of for s in specs if s.of))
    ends = [micros(df, VALID_TO).alias("_end")] if VALID_TO in df.columns else []
    o = F.struct(*map(_q, order)) if order else F.lit(0)
    renamed = [_q(k).alias(k) for k in keys]
    return df.select(*renamed, micros(df, along or ts).alias("_t"), *ends, o.alias("_o"), *(_q(c) for c in used if c not in keys)).where("_t IS NOT NULL")


def aggregate(
    df: DataFrame, keys: list[str], ts: str, specs: list[Spec], types: dict[str, t.DType], order: list[str] | None = None, along: str | None = None, until_us: int | None = None
) -> DataFrame:
    """The history of the aggregates: keys, ts, the fields, and _valid_to.

    Values at one time are those after all changes of that time. With windows of different lengths every change of
    one gives a row with the values of all. Keyed inputs (with _valid_to) end a row's life there.
    """
    rows = _prepared(df, keys, ts, specs, order, along)
    if all(isinstance(s.window, t.Continuous) for s in specs):
        values = _continuous(rows, keys, specs, types, None)
    else:
        groups: dict[Any, list[Spec]] = {}
        for s in specs:
            groups.setdefault(s.window, []).append(s)
        made = [_discrete(rows, keys, group, types, w, until_us) for w, group in groups.items()]
        values = made[0]
        if len(made) > 1:
            # on all their times, each field as it was last published
            fields = [s.into_field for s in specs]
            every = reduce(lambda a, b: a.unionByName(b), [m.select(*keys, "_t") for m in made]).distinct()
            wide = every
            for m, group in zip(made, groups.values(), strict=True):
                packed = m.select(*keys, "_t", F.struct(*(s.into_field for s in group)).alias(f"_g{len(wide.columns)}"))
                wide = wide.join(packed, [*keys, "_t"], "left")
            past = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
            packs = [c for c in wide.columns if c.startswith("_g")]
            filled = wide.select(*keys, "_t", *(F.last(c, ignorenulls=True).over(past).alias(c) for c in packs))
            columns = []
            for pack, group in zip(packs, groups.values(), strict=True):
                for s in group:
                    empty = s.empty(types.get(s.of)).cast(t.required(s.result(types.get(s.of))).spark())
                    columns.append(F.when(F.col(pack).isNotNull(), F.col(pack)[s.into_field]).otherwise(empty).alias(s.into_field))
            values = filled.select(*keys, "_t", *columns).select(*keys, "_t", *fields)
    return next_time(values, keys, "_t", "_nx", max(BUCKET_US, 8 * max(getattr(s.window, "stride_us", 0) or 0 for s in specs))).select(
        *map(_q, keys), F.timestamp_micros("_t").alias(ts), *(_q(s.into_field) for s in specs), F.timestamp_micros("_nx").alias(VALID_TO)
    )


def aggregate_asof(
    df: DataFrame, keys: list[str], ts: str, specs: list[Spec], types: dict[str, t.DType], points: DataFrame, points_ts: str, order: list[str] | None = None
) -> DataFrame:
    """The aggregates of continuous windows at the times of points (keys, points_ts), without a history.

    One row per distinct point; keys without rows get the empty values.
    """
    if not all(isinstance(s.window, t.Continuous) for s in specs):
        raise ValueError("as-of aggregation takes continuous windows")
    rows = _prepared(df, keys, ts, specs, order, None)
    asked = points.select(*map(_q, keys), micros(points, points_ts).alias("_t")).dropna()
    return _continuous(rows, keys, specs, types, asked).withColumn(points_ts, F.timestamp_micros("_t")).drop("_t")


def aggregate_windows(
    df: DataFrame, keys: list[str], ts: str, window: Any, specs: list[Spec], types: dict[str, t.DType], order: list[str] | None = None, field: str = "window", until_us: int | None = None
) -> DataFrame:
    """One row per key and window: keys, the window as a struct (begin, end), ts (its end), and the fields.

    Tumbling and hopping windows come once they are over, as with aggregate(): also the first without rows after one
    with rows, with the empty values. Without specs the windows with rows come alone.
    """
    rows = _prepared(df, keys, ts, specs, order, None)
    if isinstance(window, t.Session):
        rank = F.struct(F.col("_t").alias("t"), F.col("_o").alias("o"))
        parts = [[p.alias(f"_p{i}_{j}") for j, p in enumerate(s.parts(F.lit(True), rank))] for i, s in enumerate(specs)]
        values = number_sessions(rows, keys, "_t", window.gap_us, False, "_no").groupBy(*keys, "_no").agg(F.min("_t").alias("_a"), (F.max("_t") + 1).alias("_z"), *(p for ps in parts for p in ps))
        out = [
            s.finish([F.col(f"_p{i}_{j}") for j in range(len(parts[i]))], F.col("_z")).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field) for i, s in enumerate(specs)
        ]
    else:
        if window.us is None:
            raise ValueError("a window that is a key can't be forever")
        if specs:
            values = _discrete(rows, keys, specs, types, window, until_us)
        else:
            frontier = _frontier(rows, window, until_us)
            values = rows.select(*keys, F.explode(window_ends(F.col("_t"), window)).alias("_t")).distinct().where(F.col("_t") <= frontier)
        values = values.select("*", (F.col("_t") - window.us).alias("_a"), F.col("_t").alias("_z"))
        out = [_q(s.into_field) for s in specs]
    made = F.struct(F.timestamp_micros("_a").alias("begin"), F.timestamp_micros("_z").alias("end"))
    return values.select(*map(_q, keys), made.alias(field), F.timestamp_micros("_z").alias(ts), *out)


def bucketize(at: Column, window: Any) -> Column:
    """The last window that ended at or before a time, as struct (begin, end)."""
    us = F.unix_micros(at)
    end = F.floor(us / F.lit(window.stride_us)) * window.stride_us
    if window.us is None:
        raise ValueError("bucketize takes a bounded window")
    end = end + F.lit(window.us % window.stride_us)
    end = F.when(end > us, end - window.stride_us).otherwise(end)
    return F.struct(F.timestamp_micros(end - window.us).alias("begin"), F.timestamp_micros(end).alias("end"))
