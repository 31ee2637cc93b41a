"""Expressions over columns: built with operators and the namespaces num, str, dt, list, dict and struct, typed against
a schema, and turned into Spark columns. Nulls go through: an operation on a null is null unless it says otherwise.
All arithmetic is guarded, so nothing raises under ANSI rules where the language has a value (inf, NaN, 0, null).
"""

from __future__ import annotations

import contextvars
import datetime as dt
import decimal
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as spark_functions

from lodestream import types as t
from lodestream.expr.timefmt import has_offset, java_pattern

_typing = contextvars.ContextVar("typing", default=False)


class _Shape:
    """Stands for a column while only types are wanted, so that declaring needs no session."""

    def __getattr__(self, name: str) -> Callable[..., _Shape]:
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *_, **__: self

    def _same(self, *_: Any) -> _Shape:
        return self

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = __mod__ = __rmod__ = _same
    __eq__ = __ne__ = __lt__ = __le__ = __gt__ = __ge__ = __and__ = __rand__ = __or__ = __ror__ = __invert__ = __neg__ = __getitem__ = _same
    __hash__ = object.__hash__


SHAPE = _Shape()


class _Functions:
    """Spark's functions, or shapes while only types are wanted."""

    def __getattr__(self, name: str) -> Any:
        return (lambda *_, **__: SHAPE) if _typing.get() else getattr(spark_functions, name)


F: Any = _Functions()

UNITS_US = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}
UNITS_US["year"] = 365 * UNITS_US["day"]


@dataclass(frozen=True)
class Typed:
    dtype: t.DType
    column: Column


@dataclass(frozen=True)
class Scope:
    """What names mean: types of columns, their Spark columns, list variables, and the time that now() is."""

    types: dict[str, t.DType]
    column: Callable[[str], Column] = lambda name: F.col(f"`{name}`")
    variables: dict[str, Typed] | None = None
    now: Column | None = None


def wrap(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def cast(x: Typed, to: t.DType) -> Column:
    """x as a column of type to, which it must promote to."""
    if t.required(x.dtype).spark() == t.required(to).spark():
        return x.column
    return x.column.cast(to.spark())


def viral(result: t.DType, *inputs: t.DType) -> t.DType:
    return t.optional(result) if any(i.optional or i == t.Null for i in inputs) else result


class Expr:
    """A node; subclasses give their type and column by resolve(scope)."""

    def resolve(self, scope: Scope) -> Typed:
        raise NotImplementedError

    # -- analysis and evaluation ------------------------------------------------------------------------------

    def typeof(self, schema: dict[str, Any]) -> t.DType:
        token = _typing.set(True)
        try:
            return self.resolve(Scope({k: t.dtype(v) for k, v in schema.items()}, column=lambda _: SHAPE)).dtype
        finally:
            _typing.reset(token)

    def matches_type(self, want: Any, schema: dict[str, Any]) -> bool:
        return t.casts(self.typeof(schema), t.dtype(want))

    def column(self, types: dict[str, t.DType], now: Column | None = None) -> Column:
        return self.resolve(Scope(types, now=now)).column

    def eval(self, df: DataFrame, schema: dict[str, Any] | None = None, into: str = "value") -> DataFrame:
        """One column with the value for each row of df; nullable columns are taken as optional without a schema."""
        types = {k: t.dtype(v) for k, v in schema.items()} if schema else {f.name: t.from_spark(f.dataType, f.nullable) for f in df.schema.fields}
        return df.select(self.column(types).alias(into))

    def references(self) -> set[str]:
        found: set[str] = set()
        for value in vars(self).values():
            for v in value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else [value]:
                for e in v if isinstance(v, tuple) else [v]:
                    if isinstance(e, Expr):
                        found |= e.references()
        return found

    def astype(self, want: Any) -> Expr:
        return As(self, t.dtype(want))

    # -- operators --------------------------------------------------------------------------------------------

    def __add__(self, o):
        return Arithmetic("+", self, wrap(o))

    def __radd__(self, o):
        return Arithmetic("+", wrap(o), self)

    def __sub__(self, o):
        return Arithmetic("-", self, wrap(o))

    def __rsub__(self, o):
        return Arithmetic("-", wrap(o), self)

    def __mul__(self, o):
        return Arithmetic("*", self, wrap(o))

    def __rmul__(self, o):
        return Arithmetic("*", wrap(o), self)

    def __truediv__(self, o):
        return Arithmetic("/", self, wrap(o))

    def __rtruediv__(self, o):
        return Arithmetic("/", wrap(o), self)

    def __floordiv__(self, o):
        return Arithmetic("//", self, wrap(o))

    def __rfloordiv__(self, o):
        return Arithmetic("//", wrap(o), self)

    def __mod__(self, o):
        return Arithmetic("%", self, wrap(o))

    def __rmod__(self, o):
        return Arithmetic("%", wrap(o), self)

    def __eq__(self, o):  # type: ignore[override]
        return Compare("==", self, wrap(o))

    def __ne__(self, o):  # type: ignore[override]
        return Compare("!=", self, wrap(o))

    def __gt__(self, o):
        return Compare(">", self, wrap(o))

    def __ge__(self, o):
        return Compare(">=", self, wrap(o))

    def __lt__(self, o):
        return Compare("<", self, wrap(o))

    def __le__(self, o):
        return Compare("<=", self, wrap(o))

    def __and__(self, o):
        return Logic("&", self, wrap(o))

    def __rand__(self, o):
        return Logic("&", wrap(o), self)

    def __or__(self, o):
        return Logic("|", self, wrap(o))

    def __ror__(self, o):
        return Logic("|", wrap(o), self)

    def __xor__(self, o):
        raise t.TypeError_("^ is no operator of expressions")

    def __invert__(self):
        return Call("~", [self])

    def __neg__(self):
        return Call("-", [self])

    def __pos__(self):
        return self

    def __abs__(self):
        return Call("abs", [self])

    def __bool__(self):
        raise TypeError("an expression has no truth value; use &, | and ~")

    __hash__ = object.__hash__

    def isnull(self) -> Expr:
        return Call("isnull", [self])

    def fillnull(self, value: Any) -> Expr:
        return Call("fillnull", [self, wrap(value)])

    def abs(self) -> Expr:
        return Call("abs", [self])

    def ceil(self) -> Expr:
        return Call("ceil", [self])

    def floor(self) -> Expr:
        return Call("floor", [self])

    def round(self, precision: int = 0) -> Expr:
        if not isinstance(precision, int) or isinstance(precision, bool) or precision < 0:
            raise t.TypeError_("precision is an int from 0")
        return Call("round", [self], {"precision": precision})

    @property
    def num(self) -> Num:
        return Num(self)

    @property
    def str(self) -> StrNs:
        return StrNs(self)

    @property
    def dt(self) -> DtNs:
        return DtNs(self)

    @property
    def list(self) -> ListNs:
        return ListNs(self)

    @property
    def dict(self) -> DictNs:
        return DictNs(self)

    @property
    def struct(self) -> StructNs:
        return StructNs(self)

    def __repr__(self) -> str:
        return f"<{self}>"


@dataclass(eq=False, repr=False)
class Ref(Expr):
    name: str

    def resolve(self, scope: Scope) -> Typed:
        if self.name not in scope.types:
            raise t.TypeError_(f"no column {self.name!r}")
        return Typed(scope.types[self.name], scope.column(self.name))

    def references(self) -> set[str]:
        return {self.name}

    def __str__(self) -> str:
        return f"col({self.name!r})"


@dataclass(eq=False, repr=False)
class Var(Expr):
    name: str

    def resolve(self, scope: Scope) -> Typed:
        if not scope.variables or self.name not in scope.variables:
            raise t.TypeError_(f"no variable {self.name!r}; variables stand in map and filter of lists only")
        return scope.variables[self.name]

    def __str__(self) -> str:
        return f"var({self.name!r})"


@dataclass(eq=False, repr=False)
class Now(Expr):
    def resolve(self, scope: Scope) -> Typed:
        return Typed(t.Datetime, F.current_timestamp() if scope.now is None else scope.now)

    def __str__(self) -> str:
        return "now()"


def literal(value: Any, dtype: t.DType) -> Column:
    dtype = t.required(dtype)
    if value is None:
        return F.lit(None) if dtype == t.Null else F.lit(None).cast(dtype.spark())
    if isinstance(dtype, (t.List, t.Embedding)):
        inner = dtype.of if isinstance(dtype, t.List) else t.Float
        return F.array(*(literal(v, inner) for v in value)).cast(dtype.spark()) if value or inner != t.Null else F.array()
    if isinstance(dtype, t.Struct):
        values = value if isinstance(value, dict) else value.as_dict()
        return F.struct(*(literal(values.get(n), k).alias(n) for n, k in dtype.fields))
    if isinstance(dtype, t.Decimal):
        return F.lit(decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-dtype.scale), rounding=decimal.ROUND_DOWN)).cast(dtype.spark())
    if isinstance(value, dict):
        raise t.TypeError_("there are no dict literals")
    if dtype == t.Datetime:
        value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return F.timestamp_micros(F.lit((value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)))
    return F.lit(value).cast(dtype.spark())


@dataclass(eq=False, repr=False)
class Lit(Expr):
    value: Any
    declared: t.DType | None = None

    def resolve(self, scope: Scope) -> Typed:
        if isinstance(self.value, dict) and self.declared is None:
            raise t.TypeError_("there are no dict literals")
        dtype = t.literal_type(self.value) if self.declared is None else self.declared
        return Typed(dtype, literal(self.value, dtype))

    def references(self) -> set[str]:
        return set()

    def __str__(self) -> str:
        return f"{self.value!r}"


@dataclass(eq=False, repr=False)
class As(Expr):
    inner: Expr
    want: t.DType

    def resolve(self, scope: Scope) -> Typed:
        got = self.inner.resolve(scope)
        if not t.casts(got.dtype, self.want):
            raise t.TypeError_(f"{self.inner} is {got.dtype}, not {self.want}")
        return Typed(self.want, got.column.cast(self.want.spark()) if got.dtype != self.want else got.column)

    def __str__(self) -> str:
        return f"{self.inner}.astype({self.want})"


def _float(x: Typed) -> Column:
    return x.column.cast("double")


def divided(a: Column, b: Column) -> Column:
    """Division of doubles with infinities and NaN."""
    at_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((b == 0) & ~F.isnan(b), F.when(F.isnan(a), F.lit(math.nan)).otherwise(at_zero)).otherwise(F.try_divide(a, b))


@dataclass(eq=False, repr=False)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr

    def resolve(self, scope: Scope) -> Typed:
        a, b = self.left.resolve(scope), self.right.resolve(scope)
        for x in (a, b):
            if x.dtype != t.Null and not t.numeric(x.dtype):
                raise t.TypeError_(f"{self.op} takes numbers, not {x.dtype}")
        kinds = {t.required(x.dtype).base for x in (a, b)}
        out = t.Float if self.op == "/" or t.Float in kinds else t.Int
        result = viral(out, a.dtype, b.dtype)
        if t.Null in (a.dtype, b.dtype):
            return Typed(result, F.lit(None).cast(out.spark()))
        if out == t.Float:
            x, y = _float(a), _float(b)
            if self.op == "/":
                column = divided(x, y)
            elif self.op == "//":
                q = divided(x, y)
                column = F.when(F.abs(q) < 2.0**53, F.floor(F.when(F.abs(q) < 2.0**53, q)).cast("double")).otherwise(q)
            elif self.op == "%":
                column = F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, F.lit(math.nan)).otherwise(F.try_mod(x, y))
            else:
                column = {"+": x + y, "-": x - y, "*": x * y}[self.op]
            return Typed(result, column)
        x, y = a.column.cast("bigint"), b.column.cast("bigint")
        if self.op == "//":
            safe = F.when(y != 0, y)
            q = F.call_function("div", x, safe)
            down = (F.try_mod(x, safe) != 0) & ((x < 0) != (y < 0))
            column = F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, F.lit(0).cast("bigint")).otherwise(q - down.cast("bigint"))
        elif self.op == "%":
            # the sign of the dividend; 0 by zero, as with //
            column = F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, F.lit(0).cast("bigint")).otherwise(F.try_mod(x, y))
        else:
            column = {"+": x + y, "-": x - y, "*": x * y}[self.op]
        return Typed(result, column)

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(eq=False, repr=False)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def resolve(self, scope: Scope) -> Typed:
        a, b = self.left.resolve(scope), self.right.resolve(scope)
        if self.op not in ("==", "!="):
            for x in (a, b):
                if x.dtype != t.Null and not t.numeric(x.dtype):
                    raise t.TypeError_(f"{self.op} takes numbers, not {x.dtype}")
        common = t.join(a.dtype, b.dtype)
        if common is None:
            raise t.TypeError_(f"{a.dtype} and {b.dtype} can't be compared")
        result = viral(t.Bool, a.dtype, b.dtype)
        if t.Null in (a.dtype, b.dtype):
            return Typed(result, F.lit(None).cast("boolean"))
        x, y = cast(a, common), cast(b, common)
        ops = {"==": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}
        return Typed(result, ops[self.op])

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(eq=False, repr=False)
class Logic(Expr):
    op: str
    left: Expr
    right: Expr

    def resolve(self, scope: Scope) -> Typed:
        a, b = self.left.resolve(scope), self.right.resolve(scope)
        for x in (a, b):
            if x.dtype != t.Null and t.required(x.dtype) != t.Bool:
                raise t.TypeError_(f"{self.op} takes bool, not {x.dtype}")
        x, y = a.column.cast("boolean"), b.column.cast("boolean")
        return Typed(viral(t.Bool, a.dtype, b.dtype), x & y if self.op == "&" else x | y)

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


class When:
    def __init__(self, condition: Any, so_far: list[tuple[Expr, Expr]] | None = None):
        self.condition, self.so_far = wrap(condition), so_far or []

    def then(self, value: Any) -> Case:
        return Case([*self.so_far, (self.condition, wrap(value))], None)


@dataclass(eq=False, repr=False)
class Case(Expr):
    branches: list[tuple[Expr, Expr]]
    default: Expr | None

    def when(self, condition: Any) -> When:
        return When(condition, self.branches)

    def otherwise(self, value: Any) -> Case:
        return replace(self, default=wrap(value))

    def resolve(self, scope: Scope) -> Typed:
        conditions = [c.resolve(scope) for c, _ in self.branches]
        for c in conditions:
            if c.dtype != t.Null and t.required(c.dtype) != t.Bool:
                raise t.TypeError_(f"a condition is bool, not {c.dtype}")
        values = [v.resolve(scope) for _, v in self.branches] + [(Lit(None) if self.default is None else self.default).resolve(scope)]
        out = values[0].dtype
        for v in values[1:]:
            common = t.join(out, v.dtype)
            if common is None:
                raise t.TypeError_(f"branches of types {out} and {v.dtype}")
            out = common
        column = None
        for c, v in zip(conditions, values[:-1], strict=True):
            value = cast(v, out) if v.dtype != t.Null else F.lit(None).cast(out.spark())
            column = F.when(c.column.cast("boolean"), value) if column is None else column.when(c.column.cast("boolean"), value)
        last = values[-1]
        return Typed(out, column.otherwise(cast(last, out) if last.dtype != t.Null else F.lit(None).cast(out.spark())))

    def __str__(self) -> str:
        parts = "".join(f".when({c}).then({v})" for c, v in self.branches)
        return parts[1:] + (f".otherwise({self.default})" if self.default is not None else "")


@dataclass(eq=False, repr=False)
class MakeStruct(Expr):
    kind: t.Struct
    parts: dict[str, Expr]

    def resolve(self, scope: Scope) -> Typed:
        if set(self.parts) != {n for n, _ in self.kind.fields}:
            raise t.TypeError_(f"{self.kind.name} takes exactly {[n for n, _ in self.kind.fields]}")
        columns = []
        for name, want in self.kind.fields:
            got = self.parts[name].resolve(scope)
            if not t.promotes(got.dtype, want):
                raise t.TypeError_(f"{self.kind.name}.{name} is {want}, not {got.dtype}")
            columns.append(got.column.cast(want.spark()).alias(name))
        return Typed(self.kind, F.struct(*columns))

    def __str__(self) -> str:
        return f"{self.kind.name}({', '.join(f'{k}={v}' for k, v in self.parts.items())})"


@dataclass(eq=False, repr=False)
class Zip(Expr):
    kind: t.Struct
    parts: dict[str, Expr]

    def resolve(self, scope: Scope) -> Typed:
        if set(self.parts) != {n for n, _ in self.kind.fields}:
            raise t.TypeError_(f"{self.kind.name} takes exactly {[n for n, _ in self.kind.fields]}")
        got = {n: self.parts[n].resolve(scope) for n, _ in self.kind.fields}
        for name, want in self.kind.fields:
            inner = t.required(got[name].dtype)
            if not isinstance(inner, t.List) or not t.promotes(inner.of, want):
                raise t.TypeError_(f"{self.kind.name}.{name} needs a list of {want}, not {got[name].dtype}")
        sizes = [F.size(x.column) for x in got.values()]
        n = F.least(*sizes) if len(sizes) > 1 else sizes[0]
        # the shortest list decides
        zipped = F.arrays_zip(*(F.slice(x.column, 1, F.greatest(n, F.lit(0))).alias(name) for name, x in got.items()))
        any_null = None
        for x in got.values():
            any_null = x.column.isNull() if any_null is None else any_null | x.column.isNull()
        made = F.transform(zipped, lambda z: F.struct(*(z[name].cast(want.spark()).alias(name) for name, want in self.kind.fields)))
        return Typed(viral(t.List(self.kind), *(x.dtype for x in got.values())), F.when(~any_null, made))

    def __str__(self) -> str:
        return f"{self.kind.name}.zip({', '.join(f'{k}={v}' for k, v in self.parts.items())})"


@dataclass(eq=False, repr=False)
class Call(Expr):
    """A function of expressions and constant options, by name."""

    name: str
    args: list[Expr]
    options: dict[str, Any] | None = None

    def resolve(self, scope: Scope) -> Typed:
        return FUNCTIONS[self.name](scope, self.args, **(self.options or {}))

    def __str__(self) -> str:
        rest = [*map(str, self.args[1:]), *(f"{k}={v!r}" for k, v in (self.options or {}).items())]
        return f"{self.args[0]}.{self.name.replace('.', '.', 1)}({', '.join(rest)})" if self.args else f"{self.name}({', '.join(rest)})"


FUNCTIONS: dict[str, Callable[..., Typed]] = {}


def function(*names: str):
    def add(f):
        for name in names:
            FUNCTIONS[name] = f
        return f

    return add


def _one(scope: Scope, args: list[Expr], want: Callable[[t.DType], bool], what: str) -> Typed:
    x = args[0].resolve(scope)
    if x.dtype != t.Null and not want(t.required(x.dtype)):
        raise t.TypeError_(f"{args[0]} is {x.dtype}, not {what}")
    return x


# -- any -------------------------------------------------------------------------------------------------------


@function("isnull")
def _isnull(scope, args):
    return Typed(t.Bool, args[0].resolve(scope).column.isNull())


@function("fillnull")
def _fillnull(scope, args):
    x, fill = (a.resolve(scope) for a in args)
    inner = t.required(x.dtype)
    out = t.join(inner, fill.dtype)
    if out is None:
        raise t.TypeError_(f"{x.dtype} can't be filled with {fill.dtype}")
    if x.dtype == t.Null:
        return fill
    return Typed(out, F.coalesce(x.column.cast(out.spark()), fill.column.cast(out.spark())))


@function("~")
def _not(scope, args):
    x = _one(scope, args, lambda k: k == t.Bool, "bool")
    return Typed(x.dtype, ~x.column)


@function("-")
def _negate(scope, args):
    x = _one(scope, args, t.numeric, "a number")
    return Typed(viral(t.required(x.dtype).base, x.dtype), -x.column)


@function("repeat")
def _repeat(scope, args):
    x, n = (a.resolve(scope) for a in args)
    if n.dtype != t.Int:
        raise t.TypeError_(f"the number of repeats is int, not {n.dtype}")
    count = F.when(n.column < 0, F.raise_error(F.lit("a negative number of repeats")).cast("int")).otherwise(n.column.cast("int"))
    return Typed(t.List(x.dtype), F.array_repeat(x.column, count))


# -- numbers ---------------------------------------------------------------------------------------------------


@function("abs")
def _abs(scope, args):
    x = _one(scope, args, t.numeric, "a number")
    return Typed(viral(t.required(x.dtype).base, x.dtype), F.abs(x.column))


@function("ceil", "floor")
def _ceil(scope, args, up: bool = True):
    x = _one(scope, args, t.numeric, "a number")
    return Typed(viral(t.Int, x.dtype), (F.ceil if up else F.floor)(x.column).cast("bigint"))


FUNCTIONS["floor"] = lambda scope, args: _ceil(scope, args, up=False)


@function("round")
def _round(scope, args, precision=0):
    x = _one(scope, args, t.numeric, "a number")
    rounded = F.round(x.column, precision)
    return Typed(viral(t.Int, x.dtype), rounded.cast("bigint")) if precision == 0 else Typed(viral(t.Float, x.dtype), rounded.cast("double"))


@function("num.to_string")
def _to_string(scope, args):
    x = _one(scope, args, t.numeric, "a number")
    return Typed(viral(t.Str, x.dtype), x.column.cast("string"))


def _real(name: str, f: Callable[[Column], Column]):
    def call(scope, args):
        x = _one(scope, args, t.numeric, "a number")
        return Typed(viral(t.Float, x.dtype), f(_float(x)))

    FUNCTIONS[name] = call


for _name, _f in {"sqrt": "sqrt", "sin": "sin", "cos": "cos", "tan": "tan", "arcsin": "asin", "arccos": "acos", "arctan": "atan"}.items():
    _real(f"num.{_name}", lambda c, _f=_f: getattr(F, _f)(c))


@function("num.log")
def _log(scope, args, base=math.e):
    x = _one(scope, args, t.numeric, "a number")
    v = _float(x)
    safe = F.when(v > 0, v)
    column = F.when(v.isNull(), F.lit(None)).when(v == 0, F.lit(-math.inf)).when((v < 0) | F.isnan(v), F.lit(math.nan)).otherwise(F.log(safe) / F.lit(math.log(base)))
    return Typed(viral(t.Float, x.dtype), column)


@function("num.pow")
def _pow(scope, args):
    x, e = (a.resolve(scope) for a in args)
    for v in (x, e):
        if v.dtype != t.Null and not t.numeric(v.dtype):
            raise t.TypeError_(f"pow takes numbers, not {v.dtype}")
    kinds = {t.required(v.dtype).base for v in (x, e)}
    if kinds == {t.Int}:
        power = F.when(e.column < 0, F.raise_error(F.lit("an int to a negative int power")).cast("double")).otherwise(F.pow(_float(x), _float(e)))
        return Typed(viral(t.Int, x.dtype, e.dtype), power.cast("bigint"))
    return Typed(viral(t.Float, x.dtype, e.dtype), F.pow(_float(x), _float(e)))


@function("num.is_nan")
def _is_nan(scope, args):
    x = _one(scope, args, t.numeric, "a number")
    return Typed(viral(t.Bool, x.dtype), F.when(x.column.isNotNull(), F.isnan(_float(x))))


@function("num.is_infinite")
def _is_infinite(scope, args):
    x = _one(scope, args, t.numeric, "a number")
    return Typed(viral(t.Bool, x.dtype), F.abs(_float(x)) == F.lit(math.inf))


class Num:
    def __init__(self, e: Expr):
        self._e = e

    def abs(self):
        return self._e.abs()

    def ceil(self):
        return self._e.ceil()

    def floor(self):
        return self._e.floor()

    def round(self, precision: int = 0):
        return self._e.round(precision)

    def to_string(self):
        return Call("num.to_string", [self._e])

    def sqrt(self):
        return Call("num.sqrt", [self._e])

    def pow(self, exponent: Any):
        return Call("num.pow", [self._e, wrap(exponent)])

    def log(self, base: float = math.e):
        if base <= 0 or base == 1:
            raise t.TypeError_("the base of a logarithm is positive and not 1")
        return Call("num.log", [self._e], {"base": base})

    def sin(self):
        return Call("num.sin", [self._e])

    def cos(self):
        return Call("num.cos", [self._e])

    def tan(self):
        return Call("num.tan", [self._e])

    def arcsin(self):
        return Call("num.arcsin", [self._e])

    def arccos(self):
        return Call("num.arccos", [self._e])

    def arctan(self):
        return Call("num.arctan", [self._e])

    def is_nan(self):
        return Call("num.is_nan", [self._e])

    def is_infinite(self):
        return Call("num.is_infinite", [self._e])


# -- strings ---------------------------------------------------------------------------------------------------


def _strings(scope: Scope, args: list[Expr]) -> list[Typed]:
    found = [a.resolve(scope) for a in args]
    for a, x in zip(args, found, strict=True):
        if x.dtype != t.Null and t.required(x.dtype).base != t.Str:
            raise t.TypeError_(f"{a} is {x.dtype}, not str")
    return found


def _string(name: str, out: t.DType, f: Callable[..., Column]):
    def call(scope, args):
        xs = _strings(scope, args)
        return Typed(viral(out, *(x.dtype for x in xs)), f(*(x.column.cast("string") for x in xs)))

    FUNCTIONS[f"str.{name}"] = call


_string("lower", t.Str, lambda *c: F.lower(*c))
_string("upper", t.Str, lambda *c: F.upper(*c))
_string("len", t.Int, lambda x: F.char_length(x).cast("bigint"))
_string("contains", t.Bool, lambda *c: F.contains(*c))
_string("startswith", t.Bool, lambda *c: F.startswith(*c))
_string("endswith", t.Bool, lambda *c: F.endswith(*c))
_string("concat", t.Str, lambda *c: F.concat(*c))
_string("to_int", t.Int, lambda x: x.cast("bigint"))


@function("str.split")
def _split(scope, args, sep=""):
    (x,) = _strings(scope, args)
    return Typed(viral(t.List(t.Str), x.dtype), F.split(x.column, "" if not sep else f"\\Q{sep}\\E" if "\\E" not in sep else re.escape(sep), -1))


@function("str.strptime")
def _strptime(scope, args, format="", timezone="UTC"):
    (x,) = _strings(scope, args)
    parsed = F.to_timestamp(x.column, java_pattern(format))
    return Typed(viral(t.Datetime, x.dtype), parsed if has_offset(format) else F.to_utc_timestamp(parsed, timezone))


@function("str.parse")
def _parse(scope, args, dtype=t.Str):
    (x,) = _strings(scope, args)
    inner = t.required(dtype)
    wrapped = F.concat(F.lit('{"v":'), x.column, F.lit("}"))

    def read(sql: str) -> Column:
        return F.from_json(wrapped, f"v {sql}")["v"]

    if inner.base == t.Int:
        column = F.coalesce(read("bigint"), read("double").cast("bigint"))
    elif inner == t.Datetime:
        column = F.timestamp_micros(read("bigint"))
    elif isinstance(inner, t.Decimal):
        column = read("decimal(38, 18)").cast(inner.spark())
    else:
        column = read(inner.spark().simpleString())
    return Typed(viral(dtype, x.dtype), column)


_JSON_PATH = re.compile(r"\$(?:\.[^.\[\]'\"]+|\[\d+\]|\['[^']*'\]|\[\"[^\"]*\"\]|\[\*\])*")


@function("str.json_extract")
def _json_extract(scope, args, path="$"):
    (x,) = _strings(scope, args)
    return Typed(t.Optional(t.Str), F.get_json_object(x.column, path))


class StrNs:
    def __init__(self, e: Expr):
        self._e = e

    def lower(self):
        return Call("str.lower", [self._e])

    def upper(self):
        return Call("str.upper", [self._e])

    def len(self):
        return Call("str.len", [self._e])

    def contains(self, item: Any):
        return Call("str.contains", [self._e, wrap(item)])

    def startswith(self, item: Any):
        return Call("str.startswith", [self._e, wrap(item)])

    def endswith(self, item: Any):
        return Call("str.endswith", [self._e, wrap(item)])

    def concat(self, other: Any):
        return Call("str.concat", [self._e, wrap(other)])

    def split(self, sep: str):
        return Call("str.split", [self._e], {"sep": sep})

    def to_int(self):
        return Call("str.to_int", [self._e])

    def strptime(self, format: str, timezone: str = "UTC"):
        java_pattern(format)
        _zone(timezone)
        return Call("str.strptime", [self._e], {"format": format, "timezone": timezone})

    def parse(self, dtype: Any):
        return Call("str.parse", [self._e], {"dtype": t.dtype(dtype)})

    def json_extract(self, path: str):
        if not _JSON_PATH.fullmatch(path):
            raise t.TypeError_(f"{path!r} is no JSON path")
        return Call("str.json_extract", [self._e], {"path": path})


# -- times -----------------------------------------------------------------------------------------------------


def _zone(name: str) -> str:
    """Named time zones only."""
    import zoneinfo

    if re.match(r"^[+\-]?\d|^(UTC|GMT)[+\-]", name):
        raise t.TypeError_(f"{name!r} is an offset; zones go by name")
    try:
        zoneinfo.ZoneInfo(name)
    except Exception:
        raise t.TypeError_(f"no time zone {name!r}") from None
    return name


def _time(scope: Scope, args: list[Expr]) -> Typed:
    return _one(scope, args, lambda k: k == t.Datetime, "datetime")


_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": lambda c: F.year(c),
    "month": lambda c: F.month(c),
    "week": lambda c: F.weekofyear(c),
    "day": lambda c: F.dayofmonth(c),
    "hour": lambda c: F.hour(c),
    "minute": lambda c: F.minute(c),
    "second": lambda c: F.second(c),
    "millisecond": lambda c: F.floor(F.pmod(F.unix_micros(c), F.lit(1_000_000)) / 1000),
    "microsecond": lambda c: F.pmod(F.unix_micros(c), F.lit(1_000_000)),
}


@function("dt.part")
def _part(scope, args, part="year", timezone="UTC"):
    x = _time(scope, args)
    at = x.column if timezone == "UTC" else F.from_utc_timestamp(x.column, timezone)
    return Typed(viral(t.Int, x.dtype), _PARTS[part](at).cast("bigint"))


@function("dt.since")
def _since(scope, args, unit="second"):
    a, b = _time(scope, args[:1]), _time(scope, args[1:])
    return Typed(viral(t.Int, a.dtype, b.dtype), F.call_function("div", F.unix_micros(a.column) - F.unix_micros(b.column), F.lit(UNITS_US[unit])))


@function("dt.since_epoch")
def _since_epoch(scope, args, unit="second"):
    x = _time(scope, args)
    return Typed(viral(t.Int, x.dtype), F.call_function("div", F.unix_micros(x.column), F.lit(UNITS_US[unit])))


@function("dt.strftime")
def _strftime(scope, args, format="", timezone="UTC"):
    x = _time(scope, args)
    at = x.column if timezone == "UTC" else F.from_utc_timestamp(x.column, timezone)
    return Typed(viral(t.Str, x.dtype), F.date_format(at, java_pattern(format)))


@function("from_epoch")
def _from_epoch(scope, args, unit="second"):
    x = _one(scope, args, lambda k: k.base == t.Int, "int")
    return Typed(viral(t.Datetime, x.dtype), F.timestamp_micros(x.column * F.lit(UNITS_US[unit])))


def _unit(unit: str) -> str:
    if unit not in UNITS_US:
        raise t.TypeError_(f"{unit!r} is no unit of {sorted(UNITS_US)}")
    return unit


class DtNs:
    def __init__(self, e: Expr, timezone: str = "UTC"):
        self._e, self._zone = e, timezone

    def with_tz(self, timezone: str) -> DtNs:
        return DtNs(self._e, _zone(timezone))

    def since(self, other: Any, unit: str = "second"):
        return Call("dt.since", [self._e, wrap(other)], {"unit": _unit(unit)})

    def since_epoch(self, unit: str = "second"):
        return Call("dt.since_epoch", [self._e], {"unit": _unit(unit)})

    def strftime(self, format: str, timezone: str | None = None):
        java_pattern(format)
        return Call("dt.strftime", [self._e], {"format": format, "timezone": _zone(timezone) if timezone else self._zone})

    def _part(self, part: str):
        return Call("dt.part", [self._e], {"part": part, "timezone": self._zone})


for _p in _PARTS:
    setattr(DtNs, _p, property(lambda self, _p=_p: _PartOf(self, _p)))


class _PartOf(Call):
    """A part of a time; may be called with a zone: dt.year or dt.year("Asia/Tokyo")."""

    def __init__(self, ns: DtNs, part: str, timezone: str | None = None):
        super().__init__("dt.part", [ns._e], {"part": part, "timezone": _zone(timezone) if timezone else ns._zone})
        self._ns, self._part_name = ns, part

    def __call__(self, timezone: str | None = None):
        return _PartOf(self._ns, self._part_name, timezone)

    def references(self) -> set[str]:
        return self.args[0].references()


# -- lists -----------------------------------------------------------------------------------------------------


def _list(scope: Scope, args: list[Expr]) -> tuple[Typed, t.DType]:
    x = args[0].resolve(scope)
    inner = t.required(x.dtype)
    if isinstance(inner, t.Embedding):
        inner = t.List(t.Float)
    if not isinstance(inner, t.List):
        raise t.TypeError_(f"{args[0]} is {x.dtype}, not a list")
    return x, inner.of


def _whole(x: Typed, of: t.DType, f: Callable[[Column], Column], empty: Column) -> Column:
    """f of a list without nulls; null for a list with one, empty for an empty list."""
    c = x.column
    result = F.when(F.size(c) == 0, empty).otherwise(f(c))
    if of.optional:
        return F.when(c.isNotNull() & ~F.exists(c, lambda v: v.isNull()), result)
    return F.when(c.isNotNull(), result)


@function("list.len")
def _list_len(scope, args):
    x, _ = _list(scope, args)
    return Typed(viral(t.Int, x.dtype), F.when(x.column.isNotNull(), F.size(x.column)).cast("bigint"))


@function("list.contains")
def _list_contains(scope, args):
    x, of = _list(scope, args)
    item = args[1].resolve(scope)
    common = t.join(of, item.dtype)
    if common is None:
        raise t.TypeError_(f"a list of {of} can't contain {item.dtype}")
    kind = t.required(common).spark()
    c = F.transform(x.column, lambda v: v.cast(kind))
    v = item.column.cast(kind)
    has_null = F.exists(c, lambda e: e.isNull()) if of.optional else F.lit(False)
    found = F.exists(c, lambda e: F.coalesce(e == v, F.lit(False)))
    column = F.when(x.column.isNull(), F.lit(None)).when(F.size(x.column) == 0, F.lit(False)).when(v.isNull(), F.lit(None)).when(found, F.lit(True)).when(has_null, F.lit(None)).otherwise(F.lit(False))
    return Typed(viral(t.Bool, x.dtype, of, item.dtype), column.cast("boolean"))


@function("list.at")
def _list_at(scope, args):
    x, of = _list(scope, args)
    i = args[1].resolve(scope)
    if t.required(i.dtype).base != t.Int:
        raise t.TypeError_(f"a position is int, not {i.dtype}")
    at = F.when(i.column < 0, F.size(x.column) + i.column).otherwise(i.column).cast("int")
    return Typed(t.optional(of), F.get(x.column, at))


@function("list.hasnull")
def _hasnull(scope, args):
    x, of = _list(scope, args)
    column = F.exists(x.column, lambda v: v.isNull()) if of.optional else F.when(x.column.isNotNull(), F.lit(False))
    return Typed(viral(t.Bool, x.dtype), column)


@function("list.sum")
def _list_sum(scope, args):
    x, of = _list(scope, args)
    if not t.numeric(of):
        raise t.TypeError_(f"sum takes a list of numbers, not of {of}")
    zero = F.lit(0).cast(t.required(of).spark())
    column = _whole(x, of, lambda c: F.aggregate(c, zero, lambda a, v: a + v), zero)
    return Typed(viral(t.required(of).base, x.dtype, of), column)


@function("list.mean")
def _list_mean(scope, args):
    x, of = _list(scope, args)
    if not t.numeric(of):
        raise t.TypeError_(f"mean takes a list of numbers, not of {of}")
    column = _whole(x, of, lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")), F.size(c).cast("double")), F.lit(None).cast("double"))
    return Typed(t.Optional(t.Float), column)


@function("list.min", "list.max")
def _list_min(scope, args, greatest=False):
    x, of = _list(scope, args)
    if not t.numeric(of):
        raise t.TypeError_(f"min and max take a list of numbers, not of {of}")
    return Typed(t.optional(t.required(of).base), _whole(x, of, F.array_max if greatest else F.array_min, F.lit(None)))


FUNCTIONS["list.max"] = lambda scope, args: _list_min(scope, args, greatest=True)


@function("list.all")
def _list_all(scope, args):
    x, of = _list(scope, args)
    if t.required(of) != t.Bool:
        raise t.TypeError_(f"all takes a list of bool, not of {of}")
    return Typed(viral(t.Bool, x.dtype, of), _whole(x, of, lambda c: F.forall(c, lambda v: v), F.lit(True)))


@function("list.any")
def _list_any(scope, args):
    x, of = _list(scope, args)
    if t.required(of) != t.Bool:
        raise t.TypeError_(f"any takes a list of bool, not of {of}")
    return Typed(viral(t.Bool, x.dtype, of), F.exists(x.column, lambda v: v))


def _with_variable(scope: Scope, name: str, of: t.DType, v: Column) -> Scope:
    if scope.variables:
        raise t.TypeError_("map and filter can't be nested")
    return replace(scope, variables={name: Typed(of, v)})


@function("list.filter")
def _list_filter(scope, args, var="x"):
    x, of = _list(scope, args)
    kind = args[1].resolve(_with_variable(scope, var, of, F.lit(None).cast(of.spark()))).dtype
    if t.required(kind) != t.Bool:
        raise t.TypeError_(f"a filter is bool, not {kind}")
    return Typed(x.dtype, F.filter(x.column, lambda v: args[1].resolve(_with_variable(scope, var, of, v)).column))


@function("list.map")
def _list_map(scope, args, var="x"):
    x, of = _list(scope, args)
    kind = args[1].resolve(_with_variable(scope, var, of, F.lit(None).cast(of.spark()))).dtype
    return Typed(viral(t.List(kind), x.dtype), F.transform(x.column, lambda v: args[1].resolve(_with_variable(scope, var, of, v)).column))


class ListNs:
    def __init__(self, e: Expr):
        self._e = e

    def len(self):
        return Call("list.len", [self._e])

    def contains(self, item: Any):
        return Call("list.contains", [self._e, wrap(item)])

    def at(self, index: Any):
        return Call("list.at", [self._e, wrap(index)])

    def hasnull(self):
        return Call("list.hasnull", [self._e])

    def sum(self):
        return Call("list.sum", [self._e])

    def mean(self):
        return Call("list.mean", [self._e])

    def min(self):
        return Call("list.min", [self._e])

    def max(self):
        return Call("list.max", [self._e])

    def all(self):
        return Call("list.all", [self._e])

    def any(self):
        return Call("list.any", [self._e])

    def filter(self, var: str, predicate: Any):
        return Call("list.filter", [self._e, wrap(predicate)], {"var": var})

    def map(self, var: str, value: Any):
        return Call("list.map", [self._e, wrap(value)], {"var": var})


# -- dicts and structs -----------------------------------------------------------------------------------------


def _dict(scope: Scope, args: list[Expr]) -> tuple[Typed, t.DType]:
    x = args[0].resolve(scope)
    if not isinstance(t.required(x.dtype), t.Dict):
        raise t.TypeError_(f"{args[0]} is {x.dtype}, not a dict")
    return x, t.required(x.dtype).of


@function("dict.get")
def _dict_get(scope, args):
    x, of = _dict(scope, args)
    key = args[1].resolve(scope)
    if t.required(key.dtype).base != t.Str:
        raise t.TypeError_(f"a key is str, not {key.dtype}")
    value = F.try_element_at(x.column, key.column)
    if len(args) == 2:
        return Typed(t.optional(of), value)
    default = args[2].resolve(scope)
    out = t.join(of, default.dtype)
    if out is None:
        raise t.TypeError_(f"default {default.dtype} does not fit {of}")
    column = F.when(x.column.isNotNull(), F.when(F.map_contains_key(x.column, key.column), value.cast(out.spark())).otherwise(default.column.cast(out.spark())))
    return Typed(viral(out, x.dtype), column)


@function("dict.len")
def _dict_len(scope, args):
    x, _ = _dict(scope, args)
    return Typed(viral(t.Int, x.dtype), F.when(x.column.isNotNull(), F.size(x.column)).cast("bigint"))


@function("dict.contains")
def _dict_contains(scope, args):
    x, _ = _dict(scope, args)
    key = args[1].resolve(scope)
    if t.required(key.dtype).base != t.Str:
        raise t.TypeError_(f"a key is str, not {key.dtype}")
    return Typed(viral(t.Bool, x.dtype, key.dtype), F.map_contains_key(x.column, key.column))


@function("struct.get")
def _struct_get(scope, args, field=""):
    x = args[0].resolve(scope)
    inner = t.required(x.dtype)
    if not isinstance(inner, t.Struct) or inner.get(field) is None:
        raise t.TypeError_(f"{args[0]} of type {x.dtype} has no field {field!r}")
    return Typed(viral(inner.get(field), x.dtype), x.column[field])


class DictNs:
    def __init__(self, e: Expr):
        self._e = e

    def get(self, key: Any, default: Any = None):
        return Call("dict.get", [self._e, wrap(key), *([wrap(default)] if default is not None else [])])

    def len(self):
        return Call("dict.len", [self._e])

    def contains(self, key: Any):
        return Call("dict.contains", [self._e, wrap(key)])


class StructNs:
    def __init__(self, e: Expr):
        self._e = e

    def get(self, field: str):
        return Call("struct.get", [self._e], {"field": field})

    def __getattr__(self, field: str):
        if field.startswith("_"):
            raise AttributeError(field)
        return self.get(field)


# -- constructors ----------------------------------------------------------------------------------------------


def col(name: str) -> Expr:
    return Ref(name)


def lit(value: Any, dtype: Any = None) -> Expr:
    return Lit(value, None if dtype is None else t.dtype(dtype))


def var(name: str) -> Expr:
    return Var(name)


def now() -> Expr:
    return Now()


def when(condition: Any) -> When:
    return When(condition)


def make_struct(kind: type, **parts: Any) -> Expr:
    return MakeStruct(t.dtype(kind), {k: wrap(v) for k, v in parts.items()})


def repeat(value: Any, n: Any) -> Expr:
    return Call("repeat", [wrap(value), wrap(n)])


def from_epoch(value: Any, unit: str = "second") -> Expr:
    return Call("from_epoch", [wrap(value)], {"unit": _unit(unit)})


def datetime(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0, microsecond: int = 0, timezone: str = "UTC") -> Expr:
    """A literal time; ValueError out of range."""
    import zoneinfo

    return Lit(dt.datetime(year, month, day, hour, minute, second, microsecond, tzinfo=zoneinfo.ZoneInfo(_zone(timezone))).astimezone(dt.timezone.utc), t.Datetime)
