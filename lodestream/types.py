"""The type system: what columns may hold, how types promote, and how they look in Spark."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import types as pytypes
import typing
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TypeError_(TypeError):
    """A type rule is broken."""


@dataclass(frozen=True)
class DType:
    """A type of a column."""

    def spark(self) -> T.DataType:
        raise NotImplementedError

    @property
    def base(self) -> DType:
        """The type that holds the values: constrained types stand on a plain one."""
        return self

    @property
    def optional(self) -> bool:
        return False

    def constraint(self, c: Column) -> Column | None:
        """What must hold for values that are not null; None if nothing."""
        return None


@dataclass(frozen=True)
class _Simple(DType):
    name: str
    sql: T.DataType = field(compare=False, hash=False)

    def spark(self) -> T.DataType:
        return self.sql

    def __str__(self) -> str:
        return self.name


Int = _Simple("int", T.LongType())
Float = _Simple("float", T.DoubleType())
Str = _Simple("str", T.StringType())
Bytes = _Simple("bytes", T.BinaryType())
Bool = _Simple("bool", T.BooleanType())
Datetime = _Simple("datetime", T.TimestampType())
Date = _Simple("date", T.DateType())
Null = _Simple("null", T.NullType())


@dataclass(frozen=True)
class Decimal(DType):
    scale: int

    def __post_init__(self):
        if not 1 <= self.scale <= 28:
            raise TypeError_("the scale of a decimal is from 1 to 28")

    def __class_getitem__(cls, scale: int) -> Decimal:
        return cls(scale)

    def spark(self) -> T.DataType:
        return T.DecimalType(28, self.scale)

    def __str__(self) -> str:
        return f"decimal({self.scale})"


@dataclass(frozen=True)
class Optional(DType):
    of: DType

    def __class_getitem__(cls, of: Any) -> DType:
        return optional(dtype(of))

    def spark(self) -> T.DataType:
        return self.of.spark()

    @property
    def optional(self) -> bool:
        return True

    def constraint(self, c: Column) -> Column | None:
        return self.of.constraint(c)

    def __str__(self) -> str:
        return f"optional[{self.of}]"


def optional(t: DType) -> DType:
    return t if isinstance(t, Optional) or t == Null else Optional(t)


def required(t: DType) -> DType:
    return t.of if isinstance(t, Optional) else t


@dataclass(frozen=True)
class List(DType):
    of: DType

    def __class_getitem__(cls, of: Any) -> List:
        return cls(dtype(of))

    def spark(self) -> T.DataType:
        return T.ArrayType(self.of.spark(), True)  # what may be null is known to the types, not to Spark

    def constraint(self, c: Column) -> Column | None:
        if self.of.constraint(F.lit(None)) is None:
            return None
        return F.forall(c, lambda x: x.isNull() | self.of.constraint(x))

    def __str__(self) -> str:
        return f"list[{self.of}]"


@dataclass(frozen=True)
class Dict(DType):
    """A map from strings."""

    of: DType

    def __class_getitem__(cls, of: Any) -> Dict:
        if isinstance(of, tuple):
            key, of = of
            if dtype(key) != Str:
                raise TypeError_("the keys of a dict are strings")
        return cls(dtype(of))

    def spark(self) -> T.DataType:
        return T.MapType(T.StringType(), self.of.spark(), True)

    def __str__(self) -> str:
        return f"dict[str, {self.of}]"


@dataclass(frozen=True)
class Embedding(DType):
    dim: int

    def __class_getitem__(cls, dim: int) -> Embedding:
        return cls(dim)

    def spark(self) -> T.DataType:
        return T.ArrayType(T.DoubleType(), True)

    def constraint(self, c: Column) -> Column | None:
        return (F.size(c) == self.dim) & F.forall(c, lambda x: x.isNotNull())

    def __str__(self) -> str:
        return f"embedding[{self.dim}]"


@dataclass(frozen=True)
class Struct(DType):
    name: str = field(compare=False)
    fields: tuple[tuple[str, DType], ...]

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(n, t.spark(), True) for n, t in self.fields])

    def get(self, name: str) -> DType | None:
        return dict(self.fields).get(name)

    def constraint(self, c: Column) -> Column | None:
        parts = [(t.constraint(c[n]), c[n]) for n, t in self.fields if t.constraint(F.lit(None)) is not None]
        out = None
        for check, value in parts:
            one = value.isNull() | check
            out = one if out is None else out & one
        return out

    def __str__(self) -> str:
        return f"struct {self.name}<{', '.join(f'{n}: {t}' for n, t in self.fields)}>"


@dataclass(frozen=True)
class Constrained(DType):
    """A base type whose values are limited; equal to its base where types are compared."""

    of: DType

    @property
    def base(self) -> DType:
        return self.of

    def spark(self) -> T.DataType:
        return self.of.spark()


@dataclass(frozen=True)
class Between(Constrained):
    low: Any = None
    high: Any = None
    strict_low: bool = False
    strict_high: bool = False

    def constraint(self, c: Column) -> Column | None:
        low = None if self.low is None else (c > self.low if self.strict_low else c >= self.low)
        high = None if self.high is None else (c < self.high if self.strict_high else c <= self.high)
        both = [x for x in (low, high) if x is not None]
        return both[0] & both[1] if len(both) == 2 else both[0] if both else None

    def __str__(self) -> str:
        return f"between[{self.of}, {self.low}, {self.high}]"


@dataclass(frozen=True)
class OneOf(Constrained):
    options: tuple = ()

    def constraint(self, c: Column) -> Column | None:
        return c.isin(*self.options)

    def __str__(self) -> str:
        return f"oneof[{self.of}, {list(self.options)}]"


@dataclass(frozen=True)
class Regex(Constrained):
    pattern: str = ""

    def constraint(self, c: Column) -> Column | None:
        return c.rlike(self.pattern)

    def __str__(self) -> str:
        return f"regex[{self.pattern}]"


def between(of: Any, min: Any = None, max: Any = None, strict_min: bool = False, strict_max: bool = False) -> Between:
    base = dtype(of)
    if base not in (Int, Float):
        raise TypeError_("between takes int or float")
    if min is None and max is None:
        raise TypeError_("between needs a limit")
    for limit in (min, max):
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, (int, float)) or (base == Int and not isinstance(limit, int))):
            raise TypeError_(f"limit {limit!r} does not fit {base}")
    return Between(base, min, max, strict_min, strict_max)


def oneof(of: Any, options: list) -> OneOf:
    base = dtype(of)
    if base not in (Int, Str):
        raise TypeError_("oneof takes int or str")
    if not options or any(type(o) is not (int if base == Int else str) for o in options):
        raise TypeError_(f"the options of oneof must be values of {base}")
    return OneOf(base, tuple(options))


_UNSUPPORTED_REGEX = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


def regex(pattern: str) -> Regex:
    if _UNSUPPORTED_REGEX.search(pattern):
        raise TypeError_("patterns take neither look-around nor back-references")
    re.compile(pattern)
    return Regex(Str, pattern)


WINDOW = Struct("Window", (("begin", Datetime), ("end", Datetime)))


def struct(cls: type) -> type:
    """Class decorator: a struct type of the class's annotated fields, with values made by calling the class."""
    hints = typing.get_type_hints(cls)
    for name in hints:
        if name in vars(cls):
            raise TypeError_(f"struct field {cls.__name__}.{name} can't have a default")
    extra = [n for n, v in vars(cls).items() if callable(v) and not n.startswith("__")]
    if extra:
        raise TypeError_(f"struct {cls.__name__} can't have methods: {extra}")
    if not hints:
        raise TypeError_(f"struct {cls.__name__} has no fields")
    cls.__struct__ = Struct(cls.__name__, tuple((n, dtype(h)) for n, h in hints.items()))

    def init(self, **values):
        if set(values) - set(hints):
            raise TypeError_(f"{cls.__name__} has no fields {sorted(set(values) - set(hints))}")
        for name, t in cls.__struct__.fields:
            if name not in values and not t.optional:
                raise TypeError_(f"{cls.__name__} needs {name}")
            setattr(self, name, values.get(name))

    cls.__init__ = init
    cls.__eq__ = lambda self, other: isinstance(other, cls) and vars(self) == vars(other)
    cls.__hash__ = None
    cls.as_dict = lambda self: dict(vars(self))

    def expr(**parts):
        from lodestream.expr.ast import MakeStruct, wrap

        return MakeStruct(cls.__struct__, {k: wrap(v) for k, v in parts.items()})

    def zip_(**parts):
        from lodestream.expr.ast import Zip, wrap

        return Zip(cls.__struct__, {k: wrap(v) for k, v in parts.items()})

    cls.expr, cls.zip = staticmethod(expr), staticmethod(zip_)
    return cls


_PYTHON = {int: Int, float: Float, str: Str, bytes: Bytes, bool: Bool, dt.datetime: Datetime, dt.date: Date, type(None): Null}


def dtype(hint: Any) -> DType:
    """The type of a Python hint or of a type given already."""
    if isinstance(hint, DType):
        return hint
    try:
        if hint in _PYTHON:
            return _PYTHON[hint]
    except TypeError:
        pass
    if hasattr(hint, "__struct__"):
        return hint.__struct__
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, pytypes.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1 and len(args) == 2:
            return optional(dtype(rest[0]))
        raise TypeError_(f"{hint} is a union other than with None")
    if origin is list and len(args) == 1:
        return List(dtype(args[0]))
    if origin is dict and len(args) == 2:
        if dtype(args[0]) != Str:
            raise TypeError_("the keys of a dict are strings")
        return Dict(dtype(args[1]))
    raise TypeError_(f"{hint!r} is no column type")


def same(a: DType, b: DType) -> bool:
    """Equality, with constrained types as their bases."""
    if isinstance(a, Constrained) and not isinstance(b, Constrained):
        return same(a.base, b)
    if isinstance(b, Constrained) and not isinstance(a, Constrained):
        return same(a, b.base)
    if type(a) is not type(b):
        return False
    if isinstance(a, (Optional, List, Dict)):
        return same(a.of, b.of)
    if isinstance(a, Struct):
        return len(a.fields) == len(b.fields) and all(b.get(n) is not None and same(t, b.get(n)) for n, t in a.fields)
    return a == b


def promotes(a: DType, b: DType) -> bool:
    """Whether each value of a is one of b: T to Optional[T], int to float, null to any optional, structs by field."""
    if same(a, b):
        return True
    if a == Null:
        return b.optional
    if isinstance(b, Optional):
        return promotes(required(a), b.of)
    if a.optional:
        return False
    a, b = a.base, b.base
    if a == Int and b == Float:
        return True
    if isinstance(a, Struct) and isinstance(b, Struct):
        return len(a.fields) == len(b.fields) and all(b.get(n) is not None and promotes(t, b.get(n)) for n, t in a.fields)
    return same(a, b)


def casts(a: DType, b: DType) -> bool:
    """What a declared result may be: promotions, also within lists."""
    if promotes(a, b):
        return True
    if isinstance(b, Optional):
        return a == Null or casts(required(a), b.of)
    return isinstance(a, List) and isinstance(b, List) and casts(a.of, b.of)


def join(a: DType, b: DType) -> DType | None:
    """The least type that both promote to; None if there is none."""
    if promotes(a, b):
        return b
    if promotes(b, a):
        return a
    if a == Null or b == Null:
        return optional(b if a == Null else a)
    if a.optional or b.optional:
        inner = join(required(a), required(b))
        return None if inner is None else optional(inner)
    a, b = a.base, b.base
    if {a, b} == {Int, Float}:
        return Float
    if isinstance(a, List) and isinstance(b, List):
        inner = join(a.of, b.of)
        return None if inner is None else List(inner)
    return a if same(a, b) else None


def numeric(t: DType) -> bool:
    return required(t).base in (Int, Float)


def hashable(t: DType) -> bool:
    """Types allowed for counting and listing distinct values."""
    t = required(t)
    if isinstance(t, (List, Dict)):
        return hashable(t.of)
    return isinstance(t, (Decimal, Constrained)) or t in (Int, Str, Bool)


def literal_type(value: Any) -> DType:
    if value is None:
        return Null
    if isinstance(value, bool):
        return Bool
    for kind, t in ((int, Int), (float, Float), (str, Str), (bytes, Bytes), (dt.datetime, Datetime), (dt.date, Date)):
        if isinstance(value, kind):
            return t
    if isinstance(value, decimal.Decimal):
        return Decimal(max(1, -value.as_tuple().exponent))
    if hasattr(type(value), "__struct__"):
        return type(value).__struct__
    if isinstance(value, (list, tuple)):
        inner: DType = Null
        for v in value:
            one = join(inner, literal_type(v)) if inner != Null or literal_type(v) == Null else literal_type(v)
            if one is None:
                raise TypeError_("a list's elements need a common type")
            inner = one
        return List(inner)
    raise TypeError_(f"{value!r} has no column type")


def from_spark(t: T.DataType, nullable: bool = False) -> DType:
    """The type of a Spark column."""
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        out: DType = Int
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        out = Float
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = Datetime
    elif isinstance(t, T.DecimalType):
        out = Decimal(max(1, t.scale))
    elif isinstance(t, T.ArrayType):
        out = List(from_spark(t.elementType, t.containsNull))
    elif isinstance(t, T.MapType):
        out = Dict(from_spark(t.valueType, t.valueContainsNull))
    elif isinstance(t, T.StructType):
        out = Struct("struct", tuple((f.name, from_spark(f.dataType, f.nullable)) for f in t.fields))
    else:
        known = {T.StringType: Str, T.BinaryType: Bytes, T.BooleanType: Bool, T.DateType: Date, T.NullType: Null}
        if type(t) not in known:
            raise TypeError_(f"{t} has no column type")
        out = known[type(t)]
    return optional(out) if nullable else out


# -- windows and durations -------------------------------------------------------------------------------------

_UNITS = {"y": 365 * 86_400, "w": 7 * 86_400, "d": 86_400, "h": 3_600, "m": 60, "s": 1}
FOREVER = "forever"


def duration_us(text: str) -> int:
    """Microseconds of a duration like "1d 6h"; m is a minute and y 365 days."""
    parts = text.split()
    if not parts:
        raise ValueError("a duration is empty")
    total = 0
    for part in parts:
        for piece in re.findall(r"[^a-z]*[a-z]?", part):
            if not piece:
                continue
            m = re.fullmatch(r"(\d+)([ywdhms])", piece)
            if not m:
                raise ValueError(f"{text!r} is no duration: {piece!r}")
            total += int(m[1]) * _UNITS[m[2]] * 1_000_000
    return total


@dataclass(frozen=True)
class Continuous:
    duration: str = FOREVER

    @property
    def us(self) -> int | None:
        return None if self.duration == FOREVER else duration_us(self.duration)


@dataclass(frozen=True)
class Hopping:
    duration: str
    stride: str
    lookback: str = "0s"

    def __post_init__(self):
        if duration_us(self.stride) <= 0:
            raise ValueError("a stride must be positive")
        if self.us is not None and duration_us(self.stride) > self.us:
            raise ValueError("a stride can't be longer than its window")

    @property
    def us(self) -> int | None:
        return None if self.duration == FOREVER else duration_us(self.duration)

    @property
    def stride_us(self) -> int:
        return duration_us(self.stride)

    @property
    def lookback_us(self) -> int:
        return duration_us(self.lookback)


@dataclass(frozen=True)
class Tumbling:
    duration: str
    lookback: str = "0s"

    def __post_init__(self):
        if self.duration == FOREVER:
            raise ValueError("a tumbling window can't be forever")
        if duration_us(self.duration) <= 0:
            raise ValueError("a window must be positive")

    @property
    def us(self) -> int:
        return duration_us(self.duration)

    @property
    def stride_us(self) -> int:
        return self.us

    @property
    def lookback_us(self) -> int:
        return duration_us(self.lookback)


@dataclass(frozen=True)
class Session:
    gap: str

    @property
    def gap_us(self) -> int:
        return duration_us(self.gap)


Discrete = (Hopping, Tumbling, Session)
