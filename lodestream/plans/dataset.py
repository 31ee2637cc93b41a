"""Datasets and pipelines: typed declarations whose operators build a lazy Spark plan.

A dataset is a class of typed fields with one timestamp and any number of keys. A pipeline is a method that derives it
from other datasets; it is traced once, on declaration, into a graph of nodes, each typed as it is made. Running a
graph turns its nodes into one DataFrame plan. Frames carry two hidden columns: _seq, the order of arrival that
settles ties, and, for keyed data, _valid_to.
"""

from __future__ import annotations

import typing
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as dc_field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.expr.ast import As, Expr
from lodestream.operators import aggregates as agg
from lodestream.operators import temporal
from lodestream.operators.temporal import VALID_TO
from lodestream.schema import Schema, SchemaError

SEQ = "_seq"


# -- running Python on rows ------------------------------------------------------------------------------------


def _to_pandas_view(pdf: pd.DataFrame, schema: Schema) -> pd.DataFrame:
    out = pdf[list(schema.fields)].copy()
    for n, k in schema.fields.items():
        if t.required(k) == t.Datetime and out[n].dt.tz is None:
            out[n] = out[n].dt.tz_localize("UTC")
    return out


def _from_pandas_view(pdf: pd.DataFrame, schema: Schema) -> pd.DataFrame:
    out = pdf.copy()
    for n, k in schema.fields.items():
        if t.required(k) == t.Datetime:
            times = pd.to_datetime(out[n], utc=True)
            out[n] = times.dt.tz_localize(None)
    return out


# -- nodes -----------------------------------------------------------------------------------------------------

Frames = Callable[["Dataset"], DataFrame]


class Node:
    """A point in a pipeline: a schema and the way to its frame."""

    schema: Schema

    def frame(self, frames: Frames) -> DataFrame:
        raise NotImplementedError

    def inputs(self) -> list[Node]:
        return []

    def _open(self) -> Schema:
        if self.schema.terminal:
            raise SchemaError(f"{self.schema.name} is terminal: nothing can follow an aggregate of continuous windows")
        return self.schema

    # -- operators --------------------------------------------------------------------------------------------

    def filter(self, condition: Expr | Callable) -> Node:
        return Filter(self, condition)

    def assign(self, *args: Any, **columns: Expr) -> Node:
        return Assign(self, *args, **columns)

    def transform(self, fn: Callable, schema: dict[str, Any] | None = None) -> Node:
        return Transform(self, fn, schema)

    def select(self, *names: Any) -> Node:
        names = [n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])]
        if set(self._open().fields) <= {*names, self.schema.ts}:
            warnings.warn("select of all fields has no effect", stacklevel=2)
            return self
        return Select(self, names)

    def drop(self, *names: Any) -> Node:
        return Select(self, drop=[n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])])

    def rename(self, names: dict[str, str]) -> Node:
        return Rename(self, names)

    def dropnull(self, *names: Any) -> Node:
        return DropNull(self, [n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])])

    def explode(self, *names: Any) -> Node:
        return Explode(self, [n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])])

    def union(self, other: Node) -> Node:
        return Union(self, other)

    __add__ = union

    def dedup(self, *by: Any, window: Any = None) -> Node:
        return Dedup(self, [n for x in by for n in (x if isinstance(x, (list, tuple)) else [x])], window)

    def groupby(self, *keys: Any, window: Any = None) -> GroupBy:
        return GroupBy(self, [n for x in keys for n in (x if isinstance(x, (list, tuple)) else [x])], window)

    def join(self, other: Node, how: str = "left", on: list[str] | None = None, left_on: list[str] | None = None, right_on: list[str] | None = None, within: tuple[str, str] = ("forever", "0s"), fields: list[str] | None = None) -> Node:
        return Join(self, other, how, on, left_on, right_on, within, fields)

    def changelog(self, delete: str | None = None, insert: str | None = None) -> Node:
        return Changelog(self, delete, insert)


class Filter(Node):
    def __init__(self, source: Node, condition: Expr | Callable):
        self.source, self.condition = source, condition
        self.schema = source._open()
        if isinstance(condition, Expr):
            kind = condition.typeof(self.schema.fields)
            if kind != t.Bool:
                raise SchemaError(f"a filter is bool, not {kind}")

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        df = self.source.frame(frames)
        if isinstance(self.condition, Expr):
            return df.where(self.condition.column(self.schema.fields))
        fn, schema = self.condition, self.schema

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[fn(_to_pandas_view(pdf, schema)).fillna(False).to_numpy(bool)]

        return df.mapInPandas(over, df.schema)


class Assign(Node):
    def __init__(self, source: Node, *args: Any, **columns: Expr):
        self.source, self.fn = source, None
        schema = source._open()
        if args:
            if len(args) != 3 or columns:
                raise SchemaError("assign takes a name, a type and a function, or expressions by name")
            name, kind, self.fn = args
            self.name = name
            self.schema = schema.assign({name: t.dtype(kind)})
            return
        if not columns:
            raise SchemaError("assign needs a column")
        for name, e in columns.items():
            if not isinstance(e, As):
                raise SchemaError(f"{name} needs a type: (expression).astype(type)")
            e.typeof(schema.fields)  # raises unless it fits
        self.columns = columns
        self.schema = schema.assign({n: e.want for n, e in columns.items()})

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        df = self.source.frame(frames)
        if self.fn is None:
            # all expressions see the input's columns
            return df.withColumns({n: e.column(self.source.schema.fields) for n, e in self.columns.items()})
        fn, name, before, after = self.fn, self.name, self.source.schema, self.schema
        kind = after.type_of(name)

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                values = fn(_to_pandas_view(pdf, before))
                if len(values) != len(pdf):
                    raise ValueError(f"{name}: {len(values)} values for {len(pdf)} rows")
                pdf = pdf.copy()
                pdf[name] = list(values)
                if t.required(kind) == t.Datetime:
                    pdf[name] = pd.to_datetime(pdf[name], utc=True).dt.tz_localize(None)
                yield pdf

        plain = df.drop(name)
        out = plain.schema.add(name, kind.spark(), True)
        return df.mapInPandas(lambda it: (p[[f.name for f in out.fields]] for p in over(it)), out)


class Transform(Node):
    def __init__(self, source: Node, fn: Callable, schema: dict[str, Any] | None):
        self.source, self.fn = source, fn
        before = source._open()
        if schema is None:
            self.schema = before
            return
        fields = {n: t.dtype(k) for n, k in schema.items()}
        for n in [*before.keys, before.ts]:
            if n not in fields or not t.same(fields[n], before.type_of(n)):
                raise SchemaError(f"transform must keep the key or timestamp {n} with its type")
        self.schema = Schema(before.keys, {n: k for n, k in fields.items() if n not in before.keys and n != before.ts}, before.ts, before.erase_keys, name=before.name)

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        df = self.source.frame(frames)
        fn, before, after = self.fn, self.source.schema, self.schema
        hidden = [c for c in df.columns if c not in before.fields]

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf.reset_index(drop=True)
                made = fn(_to_pandas_view(pdf, before)).reset_index(drop=True)
                if len(made) != len(pdf):
                    raise ValueError(f"transform made {len(made)} rows of {len(pdf)}")
                missing = [c for c in after.fields if c not in made.columns]
                if missing:
                    raise ValueError(f"transform gave no {missing}")
                yield pd.concat([_from_pandas_view(made[list(after.fields)], after), pdf[hidden]], axis=1)

        out = after.spark()
        for c in hidden:
            out = out.add(c, df.schema[c].dataType, True)
        return df.mapInPandas(over, out)


class Select(Node):
    def __init__(self, source: Node, names: list[str] | None = None, drop: list[str] | None = None):
        self.source = source
        before = source._open()
        if drop is not None:
            self.schema = before.drop(drop)
        else:
            self.schema = before.select([*names, before.ts])

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        df = self.source.frame(frames)
        return df.select(*(F.col(f"`{c}`") for c in df.columns if c in self.schema.fields or c in (SEQ, VALID_TO)))


class Rename(Node):
    def __init__(self, source: Node, names: dict[str, str]):
        self.source, self.names = source, names
        self.schema = source._open().rename(names)

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        df = self.source.frame(frames)
        return df.select(*(F.col(f"`{c}`").alias(self.names.get(c, c)) for c in df.columns))


class DropNull(Node):
    def __init__(self, source: Node, names: list[str]):
        self.source = source
        before = source._open()
        self.names = names or [n for n, k in before.values.items() if k.optional]
        if not self.names:
            raise SchemaError(f"{before.name} has no optional field")
        self.schema = before.dropnull(self.names)

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        return self.source.frame(frames).dropna(subset=self.names)


class Explode(Node):
    def __init__(self, source: Node, names: list[str]):
        self.source, self.names = source, names
        before = source._open()
        if before.keyed:
            raise SchemaError("explode takes data without keys")
        if not names:
            raise SchemaError("explode needs a column")
        made = {}
        for n in names:
            kind = before.type_of(n)
            if n not in before.values or not isinstance(t.required(kind), t.List):
                raise SchemaError(f"{n} is {kind}, not a list")
            made[n] = t.optional(t.required(kind).of)
        self.schema = Schema({}, {n: made.get(n, k) for n, k in before.values.items()}, before.ts, name=before.name)

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        return temporal.explode_lists(self.source.frame(frames), self.names)


class Union(Node):
    def __init__(self, left: Node, right: Node):
        self.left, self.right = left, right
        a, b = left._open(), right._open()
        if a.keyed or b.keyed:
            raise SchemaError("union takes data without keys")
        if why := a.matches(b):
            raise SchemaError(f"union of different schemas: {why}")
        self.schema = a

    def inputs(self):
        return [self.left, self.right]

    def frame(self, frames):
        return self.left.frame(frames).unionByName(self.right.frame(frames))


class Dedup(Node):
    def __init__(self, source: Node, by: list[str], window: Any):
        self.source, self.window = source, window
        before = source._open()
        if before.keyed:
            raise SchemaError("dedup takes data without keys")
        self.by = by or list(before.values)
        for n in self.by:
            if n not in before.values:
                raise SchemaError(f"dedup by {n}, which is no value")
        if window is not None and not isinstance(window, (t.Tumbling, t.Session)):
            raise SchemaError("dedup takes a tumbling or session window")
        if isinstance(window, t.Tumbling) and window.lookback_us:
            raise SchemaError("the window of dedup has no lookback")
        self.schema = before

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        window = self.window
        return temporal.dedup(
            self.source.frame(frames),
            self.by,
            self.schema.ts,
            window_us=window.us if isinstance(window, t.Tumbling) else None,
            gap_us=window.gap_us if isinstance(window, t.Session) else None,
            order=[SEQ],
        )


class Changelog(Node):
    def __init__(self, source: Node, delete: str | None, insert: str | None):
        self.source, self.delete, self.insert = source, delete, insert
        before = source._open()
        if not before.keyed:
            raise SchemaError("a changelog is of keyed data")
        if (delete is None) == (insert is None):
            raise SchemaError("give one of delete and insert")
        name = delete or insert
        if name in before.fields:
            raise SchemaError(f"{before.name} has a field {name!r} already")
        self.schema = Schema({}, {**before.keys, **before.values, name: t.Bool}, before.ts, name=before.name)

    def inputs(self):
        return [self.source]

    def frame(self, frames):
        return temporal.changelog(self.source.frame(frames), self.schema.ts, self.delete, self.insert)


class Join(Node):
    def __init__(self, left: Node, right: Node, how: str, on, left_on, right_on, within, fields):
        self.left, self.right, self.how = left, right, how
        a = left._open()
        if how not in ("inner", "left"):
            raise SchemaError("how is inner or left")
        if not isinstance(right, Dataset):
            raise SchemaError("the right side of a join is a dataset, not the result of an operator")
        b = right._open()
        if not b.keyed:
            raise SchemaError(f"the right side of a join is keyed; {b.name} is not")
        if (on is None) == (left_on is None) or (left_on is None) != (right_on is None):
            raise SchemaError("give on, or left_on and right_on")
        left_on, right_on = (on, on) if on is not None else (left_on, right_on)
        if len(left_on) != len(right_on):
            raise SchemaError("left_on and right_on differ in length")
        if set(right_on) != set(b.keys):
            raise SchemaError(f"a join is on all keys {sorted(b.keys)} of {b.name}, not {sorted(right_on)}")
        for x, y in zip(left_on, right_on, strict=True):
            if a.type_of(x).optional:
                raise SchemaError(f"join column {x} can't be optional")
            if not t.same(a.type_of(x), b.type_of(y)):
                raise SchemaError(f"join columns {x}: {a.type_of(x)} and {y}: {b.type_of(y)}")
        if within[1] == t.FOREVER:
            raise SchemaError("the upper bound of within can't be forever")
        self.low = None if within[0] == t.FOREVER else t.duration_us(within[0])
        self.high = t.duration_us(within[1])
        chosen = list(b.values) if fields is None else fields
        for n in chosen:
            if n not in b.values and n != b.ts:
                raise SchemaError(f"{n} is no value of {b.name}")
        self.pairs, self.chosen = list(zip(left_on, right_on, strict=True)), chosen
        made = {n: t.optional(b.type_of(n)) if how == "left" else b.type_of(n) for n in chosen}
        for n in made:
            if n in a.fields:
                raise SchemaError(f"{n} is a field of both sides of the join")
        self.schema = Schema(a.keys, {**a.values, **made}, a.ts, a.erase_keys, name=a.name)

    def inputs(self):
        return [self.left, self.right]

    def frame(self, frames):
        left, right = self.left.frame(frames), self.right.frame(frames)
        fields = {n: n for n in self.chosen}
        if self.schema.keyed:
            # left rows of one join key follow each other only if their own keys are part of it
            overlapping = not set(self.schema.keys) <= {a for a, _ in self.pairs}
            return temporal.history_join(left, right, self.pairs, self.schema.ts, self.right.schema.ts, fields, self.how, overlapping)
        return temporal.asof_join(left, right, self.pairs, self.schema.ts, self.right.schema.ts, fields, self.low, self.high, self.how, [SEQ])


class GroupBy:
    def __init__(self, source: Node, keys: list[str], window: Any):
        self.source, self.keys, self.window = source, keys, window
        before = source._open()
        if not keys:
            raise SchemaError("groupby needs a key")
        for k in keys:
            if k == before.ts:
                raise SchemaError("the timestamp can't be a key of groupby")
            if before.type_of(k).optional:
                raise SchemaError(f"groupby key {k} can't be optional")
        if window is not None:
            if before.keyed:
                raise SchemaError("groupby with a window takes data without keys")
            if getattr(window, "us", 0) is None or isinstance(window, t.Continuous):
                raise SchemaError("the window of groupby is bounded and discrete")

    def aggregate(self, *specs: Any, along: str | None = None, emit: str = "eager", **named: agg.Spec) -> Node:
        flat = [s for x in specs for s in (x if isinstance(x, (list, tuple)) else [x])]
        from dataclasses import replace

        flat += [replace(s, into_field=n) for n, s in named.items()]
        return Aggregate(self, flat, along, emit)

    def first(self) -> Node:
        return First(self)

    def latest(self) -> Node:
        return Latest(self)


class Aggregate(Node):
    #: Windows that end later are left out; None for the latest time of the rows, less the lookback.
    until_us: int | None = None

    def __init__(self, group: GroupBy, specs: list[agg.Spec], along: str | None, emit: str):
        self.group, self.along, self.emit = group, along, emit
        before = group.source.schema
        window = group.window
        if emit not in ("eager", "final"):
            raise SchemaError("emit is eager or final")
        if along is not None:
            if window is not None:
                raise SchemaError("along has no place with a window in groupby")
            if t.required(before.type_of(along)) != t.Datetime or before.type_of(along).optional:
                raise SchemaError(f"along {along} is {before.type_of(along)}, not datetime")
        if not specs and window is None:
            raise SchemaError("aggregate needs an aggregate")
        names = [s.into_field for s in specs]
        if any(not n for n in names) or len(set(names)) != len(names) or set(names) & {*group.keys, before.ts}:
            raise SchemaError(f"aggregates need fields of their own, not {names}")
        if window is not None:
            from dataclasses import replace

            for s in specs:
                if s.window not in (window, t.Continuous()):
                    raise SchemaError("the window of an aggregate is that of its groupby")
            specs = [replace(s, window=window) for s in specs]
        discrete = [isinstance(s.window, t.Discrete) for s in specs]
        if any(discrete) and not all(discrete):
            raise SchemaError("windows of an aggregate are all discrete or all continuous")
        lookbacks = {getattr(s.window, "lookback_us", 0) for s in specs if not isinstance(s.window, t.Session)}
        if len(lookbacks) > 1:
            raise SchemaError("the windows of an aggregate have one lookback")
        for s in specs:
            if before.keyed and isinstance(s.window, (t.Tumbling, t.Hopping)) and along is None and s.window.us is not None:
                raise SchemaError("tumbling and hopping windows over keyed data need along")
            if emit == "final" and (isinstance(s, agg.ExpDecaySum) or isinstance(s.window, t.Continuous)):
                raise SchemaError("emit final needs windows that end")
        values = {}
        for s in specs:
            values[s.into_field] = s.result(before.type_of(s.of) if s.of else None) if s.of or isinstance(s, agg.Count) else _needs(s)
        self.specs = specs
        self.types = {n: before.type_of(n) for n in {s.of for s in specs if s.of}}
        keys = {k: before.type_of(k) for k in group.keys}
        if window is not None:
            keys = {**keys, "window": t.WINDOW}
        terminal = bool(specs) and ((not any(discrete) and emit == "eager" and window is None) or any(isinstance(s, agg.ExpDecaySum) for s in specs))
        self.schema = Schema(keys, values, before.ts, tuple(k for k in before.erase_keys if k in keys), terminal, before.name)

    def inputs(self):
        return [self.group.source]

    def frame(self, frames):
        df = self.group.source.frame(frames)
        ts, keys = self.schema.ts, self.group.keys
        if self.group.window is not None:
            made = agg.aggregate_windows(df, keys, ts, self.group.window, self.specs, self.types, [SEQ], until_us=self.until_us)
            return temporal.validity(made.withColumn(SEQ, F.lit(0).cast("bigint")), [*keys, "window"], ts)
        if self.along is not None:
            df = df.drop(VALID_TO)
        return agg.aggregate(df, keys, ts, self.specs, self.types, [SEQ], self.along, self.until_us).withColumn(SEQ, F.lit(0).cast("bigint"))


def _needs(s: agg.Spec):
    raise SchemaError(f"{type(s).__name__} needs of")


class _Top(Node):
    def __init__(self, group: GroupBy):
        self.group = group
        before = group.source.schema
        if before.keyed:
            raise SchemaError("first and latest take data without keys")
        if group.window is not None:
            raise SchemaError("first and latest take no window")
        self.schema = Schema(
            {k: before.type_of(k) for k in group.keys}, {n: k for n, k in before.values.items() if n not in group.keys}, before.ts, name=before.name
        )

    def inputs(self):
        return [self.group.source]


class First(_Top):
    """Each key's earliest row; it stays for good."""

    def frame(self, frames):
        df = temporal.first_rows(self.group.source.frame(frames), self.group.keys, self.schema.ts, [SEQ])
        return df.withColumn(VALID_TO, F.lit(None).cast("timestamp"))


class Latest(_Top):
    """Each key's rows as a history."""

    def frame(self, frames):
        return temporal.validity(self.group.source.frame(frames), self.group.keys, self.schema.ts, [SEQ])


# -- declarations ----------------------------------------------------------------------------------------------


@dataclass
class Field:
    key: bool = False
    timestamp: bool = False
    erase_key: bool = False
    meta: dict = dc_field(default_factory=dict)


def field(key: bool = False, timestamp: bool = False, erase_key: bool = False) -> Any:
    if erase_key and not key:
        raise SchemaError("an erase key is a key")
    if key and timestamp:
        raise SchemaError("a timestamp can't be a key")
    return Field(key, timestamp, erase_key)


@dataclass(frozen=True)
class FieldRef:
    """A field of a dataset, as Dataset.field."""

    dataset: Dataset
    name: str

    @property
    def dtype(self) -> t.DType:
        return self.dataset.schema.type_of(self.name)

    def __str__(self) -> str:
        return f"{self.dataset._name}.{self.name}"


#: Names that datasets use themselves.
RESERVED = {"aggregate_node", "cls", "expectations", "frame", "index", "meta", "on_demand", "pipeline_for", "pipelines", "schema", "sinks", "sources", "terminal", "version"}


class Dataset(Node):
    """A declared dataset; also the input node of pipelines."""

    def __init__(self, cls: type, version: int, history: str, index: bool, offline: bool, online: bool):
        self._name, self.version, self.history_us, self.cls = cls.__name__, version, t.duration_us(history), cls
        self.index = Index(online=online or index, offline=offline or index) if index or offline or online else None
        self.meta: dict[str, Any] = getattr(cls, "__meta__", {})
        self.sources: list[Any] = list(getattr(cls, "__sources__", []))
        self.sinks: list[Any] = list(getattr(cls, "__sinks__", []))
        hints = typing.get_type_hints(cls)
        keys, values, erase, marked, times = {}, {}, [], [], []
        for name, hint in hints.items():
            if "." in name or name.startswith("_") or name in RESERVED:
                raise SchemaError(f"{name!r} is no name of a field")
            kind, f = t.dtype(hint), vars(cls).get(name)
            f = f if isinstance(f, Field) else Field()
            if f.timestamp:
                if kind != t.Datetime:
                    raise SchemaError(f"the timestamp {name} of {self._name} is {kind}, not datetime")
                marked.append(name)
            elif f.key:
                keys[name] = kind
                erase += [name] if f.erase_key else []
            else:
                values[name] = kind
                times += [name] if kind == t.Datetime else []
        if len(marked) > 1:
            raise SchemaError(f"{self._name} has several timestamps")
        if not marked:
            if len(times) != 1:
                raise SchemaError(f"{self._name} needs a field marked as its timestamp")
            marked = times
            values.pop(times[0])
        self.schema = Schema(keys, values, marked[0], tuple(erase), name=self._name)
        if (offline or online or index) and not keys:
            raise SchemaError(f"{self._name} has no keys to index")
        self.pipelines: list[Pipeline] = []
        for member in vars(cls).values():
            if isinstance(member, PipelineDef):
                self.pipelines.append(self._traced(member))
        envs: set[str | None] = set()
        for p in self.pipelines:
            for e in p.env or [None]:
                if e in envs:
                    raise SchemaError(f"{self._name} has several pipelines for environment {e}")
                envs.add(e)
        self.terminal = any(p.terminal for p in self.pipelines)
        self.expectations = [m.__expectations__ for m in vars(cls).values() if hasattr(m, "__expectations__")]
        if len(self.expectations) > 1:
            raise SchemaError(f"{self._name} has several suites of expectations")
        self.on_demand = next((m.__on_demand__ for m in vars(cls).values() if hasattr(m, "__on_demand__")), None)
        if self.on_demand and not keys:
            raise SchemaError(f"{self._name} has no keys to compute rows for on demand")
        if self.expectations and self.terminal:
            raise SchemaError(f"{self._name} is terminal and takes no expectations")

    def _traced(self, made: PipelineDef) -> Pipeline:
        for d in made.inputs:
            if not isinstance(d, Dataset):
                raise SchemaError(f"input {d!r} of {self._name}.{made.fn.__name__} is no dataset")
            if d.terminal:
                raise SchemaError(f"{d._name} is terminal and can't be an input")
        node = made.fn(self.cls, *made.inputs)
        if not isinstance(node, Node):
            raise SchemaError(f"{self._name}.{made.fn.__name__} gives no dataset")
        if why := node.schema.matches(self.schema):
            raise SchemaError(f"{self._name}.{made.fn.__name__} does not give the schema of {self._name}: {why}")
        return Pipeline(made.fn.__name__, made.inputs, node, made.env, node.schema.terminal)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or "schema" not in self.__dict__:
            raise AttributeError(name)
        if name in self.schema.fields:
            return FieldRef(self, name)
        raise AttributeError(f"{self._name} has no field {name!r}")

    def frame(self, frames):
        return frames(self)

    def __hash__(self):
        return id(self)

    def pipeline_for(self, env: str | None) -> Pipeline | None:
        fitting = [p for p in self.pipelines if selected(p.env, env)]
        if len(fitting) > 1:
            raise SchemaError(f"several pipelines of {self._name} for environment {env}")
        return fitting[0] if fitting else None

    def aggregate_node(self, env: str | None = None) -> Aggregate | None:
        p = self.pipeline_for(env)
        return p.node if p and isinstance(p.node, Aggregate) else None

    def lookup(self, ts: pd.Series, fields: list[str] | None = None, **keys: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
        """Within a Python extractor: the values known at ts, from what was looked up beforehand."""
        from lodestream.features.extractors import prefetched

        return prefetched(self, ts, keys, fields)

    def __repr__(self) -> str:
        return f"<dataset {self._name}>"


@dataclass(frozen=True)
class Pipeline:
    name: str
    inputs: tuple[Dataset, ...]
    node: Node
    env: tuple[str, ...] | None
    terminal: bool


@dataclass
class Index:
    online: bool = True
    offline: bool = True


@dataclass
class PipelineDef:
    fn: Callable
    inputs: tuple[Dataset, ...]
    env: tuple[str, ...] | None


def selected(envs: tuple[str, ...] | None, env: str | None) -> bool:
    """Whether something for these environments ("~x" for all but x) takes part in env."""
    if envs is None or env is None:
        return envs is None or env is None
    excluded = [e[1:] for e in envs if e.startswith("~")]
    included = [e for e in envs if not e.startswith("~")]
    return env not in excluded and (not included or env in included)


def environments(env: Any) -> tuple[str, ...] | None:
    if env is None:
        return None
    return (env,) if isinstance(env, str) else tuple(env)


def dataset(cls: type | None = None, *, version: int = 1, history: str = "2y", index: bool = False, offline: bool = False, online: bool = False) -> Any:
    """Class decorator that declares a dataset."""
    make = lambda c: Dataset(c, version, history, index, offline, online)
    return make if cls is None else make(cls)


def pipeline(fn: Callable | None = None, *, env: Any = None) -> Any:
    """Method decorator that declares a pipeline; @inputs gives its datasets."""
    make = lambda f: PipelineDef(f, tuple(getattr(f, "__inputs__", ())), environments(env))
    return make if fn is None else make(fn)


def inputs(*what: Any) -> Callable:
    """The datasets a pipeline takes, or the features an extractor takes."""

    def add(fn: Callable) -> Callable:
        fn.__inputs__ = what
        return fn

    return add


def on_demand(expires_after: str) -> Callable:
    """Method decorator: computes missing rows of a keyed dataset from their keys, to be kept for a time. Declared and
    checked only, as with lookups that find nothing."""
    us = t.duration_us(expires_after)

    def add(fn: Callable) -> Callable:
        fn.__on_demand__ = (fn, us)
        return fn

    return add


def outputs(*what: Any) -> Callable:
    def add(fn: Callable) -> Callable:
        fn.__outputs__ = what
        return fn

    return add


def meta(owner: str | None = None, tags: list[str] | None = None, description: str = "", deprecated: bool = False, deleted: bool = False) -> Callable:
    """Who owns something and what it is."""
    if owner is not None and "@" not in owner:
        raise ValueError("an owner is an e-mail address")

    def add(x: Any) -> Any:
        made = {"owner": owner, "tags": list(tags or []), "description": description, "deprecated": deprecated, "deleted": deleted}
        if isinstance(x, type):
            x.__meta__ = made
        else:
            x.meta = made
        return x

    return add


def index(x: Dataset | None = None, *, type: str = "primary", online: bool = True, offline: str | None = "forever") -> Any:
    """Declares that a keyed dataset can be looked up."""
    if type != "primary":
        raise SchemaError("an index is primary")
    if offline not in (None, "forever"):
        raise SchemaError("offline is None or forever")

    def add(d: Dataset) -> Dataset:
        if not d.schema.keyed:
            raise SchemaError(f"{d._name} has no keys to index")
        if d.index is not None:
            raise SchemaError(f"{d._name} has an index already")
        d.index = Index(online, offline is not None)
        return d

    return add if x is None else add(x)
