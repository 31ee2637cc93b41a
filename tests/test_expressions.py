"""Tables of expressions, their types, and their values; nulls, zeros and infinities included."""

import math
from datetime import datetime, timezone
from typing import Optional

import pytest

from lodestream import types as t
from lodestream.expr import col, from_epoch, lit, make_struct, now, repeat, var, when
from lodestream.expr import datetime as dt_lit
from lodestream.expr.timefmt import java_pattern

INF, NAN = math.inf, math.nan


@t.struct
class P:
    x: int
    y: Optional[str]


TYPES = {
    "a": int, "b": Optional[int], "z": int, "f": float, "g": Optional[float], "s": str, "n": Optional[str], "ok": bool, "maybe": Optional[bool],
    "ts": datetime, "l": list[int], "lo": list[Optional[int]], "nl": Optional[list[int]], "m": dict[str, int], "bl": list[bool], "p": P, "j": str,
}
DDL = "a bigint, b bigint, z bigint, f double, g double, s string, n string, ok boolean, maybe boolean, ts timestamp, l array<bigint>, lo array<bigint>, nl array<bigint>, m map<string,bigint>, bl array<boolean>, p struct<x: bigint, y: string>, j string"
T0 = datetime(2024, 2, 29, 13, 4, 5, 678901, tzinfo=timezone.utc)
ROWS = [
    (7, None, 0, 2.5, None, "Ab.c", None, True, None, T0, [3, 1, 2], [1, None, 3], None, {"k": 1}, [True, False], (1, "u"), '{"a": {"b": [1, 2]}, "t": 1.9}'),
    (-7, 2, 0, -1.5, NAN, "", "x", False, True, datetime(1969, 12, 31, 23, 0, tzinfo=timezone.utc), [], [], [5], {}, [], (2, None), "{}"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, DDL)


a, b, z, f, g, s, n, ok, maybe, ts = (col(c) for c in ("a", "b", "z", "f", "g", "s", "n", "ok", "maybe", "ts"))
li, lo, nl, m, bl, p, j = (col(c) for c in ("l", "lo", "nl", "m", "bl", "p", "j"))
x = var("x")
O = t.optional  # noqa: E741

CASES = [
    (a + 1, t.Int, [8, -6]), (a + f, t.Float, [9.5, -8.5]), (a - b, O(t.Int), [None, -9]), (2 * f, t.Float, [5.0, -3.0]), (-a, t.Int, [-7, 7]), (1 - a, t.Int, [-6, 8]),
    (a / 2, t.Float, [3.5, -3.5]), (a / z, t.Float, [INF, -INF]), (z / z, t.Float, [NAN, NAN]), (f / 0.0, t.Float, [INF, -INF]), (a / b, O(t.Float), [None, -3.5]), (1 / a, t.Float, [1 / 7, -1 / 7]),
    (a // 2, t.Int, [3, -4]), (a // -2, t.Int, [-4, 3]), (a // z, t.Int, [0, 0]), (f // 1, t.Float, [2.0, -2.0]), (a // b, O(t.Int), [None, -4]), (f // 0, t.Float, [INF, -INF]),
    (a % 4, t.Int, [3, -3]), (a % z, t.Int, [0, 0]), (f % 2.0, t.Float, [0.5, -1.5]), (f % 0.0, t.Float, [NAN, NAN]),
    (a == 7, t.Bool, [True, False]), (a != 7.0, t.Bool, [False, True]), (n == "x", O(t.Bool), [None, True]), (ts == ts, t.Bool, [True, True]), (a > f, t.Bool, [True, False]), (a >= 7, t.Bool, [True, False]), (b < 3, O(t.Bool), [None, True]), (a <= -7, t.Bool, [False, True]),
    (ok & maybe, O(t.Bool), [None, False]), (ok | maybe, O(t.Bool), [True, True]), (~ok, t.Bool, [False, True]), (ok | lit(None), O(t.Bool), [True, None]), (a + lit(None), O(t.Int), [None, None]),
    (when(ok).then(a).otherwise(f), t.Float, [7.0, -1.5]), (when(ok).then("t"), O(t.Str), ["t", None]), (when(maybe).then(1).when(ok).then(2).otherwise(3), t.Int, [2, 1]), (when(ok).then(None).otherwise(1), O(t.Int), [None, 1]),
    (b.isnull(), t.Bool, [True, False]), (g.isnull(), t.Bool, [True, False]), (a.isnull(), t.Bool, [False, False]), (b.fillnull(9), t.Int, [9, 2]), (b.fillnull(0.5), t.Float, [0.5, 2.0]), (n.fillnull("-").str.len(), t.Int, [1, 1]),
    (a.abs(), t.Int, [7, 7]), (f.abs(), t.Float, [2.5, 1.5]), (f.ceil(), t.Int, [3, -1]), (f.floor(), t.Int, [2, -2]), (f.round(), t.Int, [3, -2]), ((f / 3).round(2), t.Float, [0.83, -0.5]),
    (a.num.to_string(), t.Str, ["7", "-7"]), (f.num.sqrt(), t.Float, [2.5**0.5, NAN]), (a.num.pow(2), t.Int, [49, 49]), (a.num.pow(-1.0), t.Float, [1 / 7, -1 / 7]), (f.num.log(), t.Float, [math.log(2.5), NAN]), (z.num.log(10), t.Float, [-INF, -INF]),
    (f.num.sin(), t.Float, [math.sin(2.5), math.sin(-1.5)]), (f.num.is_nan(), t.Bool, [False, False]), (g.num.is_nan(), O(t.Bool), [None, True]), ((f / 0.0).num.is_infinite(), t.Bool, [True, True]), (f.num.arctan(), t.Float, [math.atan(2.5), math.atan(-1.5)]),
    (s.str.lower(), t.Str, ["ab.c", ""]), (s.str.upper(), t.Str, ["AB.C", ""]), (s.str.len(), t.Int, [4, 0]), (lit("día").str.len(), t.Int, [3, 3]), (s.str.contains("."), t.Bool, [True, False]), (s.str.startswith("A"), t.Bool, [True, False]), (s.str.endswith(s), t.Bool, [True, True]),
    (s.str.concat(n), O(t.Str), [None, "x"]), (s.str.split("."), t.List(t.Str), [["Ab", "c"], [""]]), (lit("a|b\\Ec").str.split("\\E"), t.List(t.Str), [["a|b", "c"]] * 2), (lit("12").str.to_int(), t.Int, [12, 12]),
    (lit("2024-03-01 05:06").str.strptime("%Y-%m-%d %H:%M"), t.Datetime, [datetime(2024, 3, 1, 5, 6)] * 2), (lit("01/03/2024").str.strptime("%d/%m/%Y", timezone="Asia/Tokyo"), t.Datetime, [datetime(2024, 2, 29, 15)] * 2), (lit("2024-03-01T00:00:00+02:00").str.strptime("%Y-%m-%dT%H:%M:%S%:z", timezone="Asia/Tokyo"), t.Datetime, [datetime(2024, 2, 29, 22)] * 2),
    (lit("1.9").str.parse(int), t.Int, [1, 1]), (lit("[1, 2]").str.parse(list[int]), t.List(t.Int), [[1, 2]] * 2), (lit('"q"').str.parse(str), t.Str, ["q", "q"]), (lit("true").str.parse(bool), t.Bool, [True, True]), (lit("1000000").str.parse(datetime), t.Datetime, [datetime(1970, 1, 1, 0, 0, 1)] * 2), (lit('{"x": 1, "y": null}').str.parse(P).struct.x, t.Int, [1, 1]),
    (j.str.json_extract("$.a.b[1]"), O(t.Str), ["2", None]), (j.str.json_extract("$.a"), O(t.Str), ['{"b":[1,2]}', None]),
    (ts.dt.year, t.Int, [2024, 1969]), (ts.dt.month, t.Int, [2, 12]), (ts.dt.day, t.Int, [29, 31]), (ts.dt.week, t.Int, [9, 1]), (ts.dt.hour, t.Int, [13, 23]), (ts.dt.with_tz("Asia/Tokyo").hour, t.Int, [22, 8]), (ts.dt.minute, t.Int, [4, 0]), (ts.dt.second, t.Int, [5, 0]), (ts.dt.millisecond, t.Int, [678, 0]), (ts.dt.microsecond, t.Int, [678901, 0]), (ts.dt.year("Asia/Tokyo"), t.Int, [2024, 1970]),
    (ts.dt.since_epoch(), t.Int, [1709211845, -3600]), (ts.dt.since_epoch("day"), t.Int, [19782, 0]), (ts.dt.since(dt_lit(2023, 2, 28), "year"), t.Int, [1, -53]), (ts.dt.since(ts, "week"), t.Int, [0, 0]), (ts.dt.strftime("%d.%m.%y at %H:%M"), t.Str, ["29.02.24 at 13:04", "31.12.69 at 23:00"]), (from_epoch(a, "day"), t.Datetime, [datetime(1970, 1, 8), datetime(1969, 12, 25)]), (dt_lit(2024, 1, 1, timezone="Europe/Paris"), t.Datetime, [datetime(2023, 12, 31, 23)] * 2),
    (li.list.len(), t.Int, [3, 0]), (nl.list.len(), O(t.Int), [None, 1]), (li.list.contains(1), t.Bool, [True, False]), (lo.list.contains(1), O(t.Bool), [True, False]), (lo.list.contains(9), O(t.Bool), [None, False]), (li.list.contains(b), O(t.Bool), [None, False]), (nl.list.contains(5), O(t.Bool), [None, True]),
    (li.list.at(0), O(t.Int), [3, None]), (li.list.at(-1), O(t.Int), [2, None]), (li.list.at(a), O(t.Int), [None, None]), (li.list.hasnull(), t.Bool, [False, False]), (lo.list.hasnull(), t.Bool, [True, False]), (nl.list.hasnull(), O(t.Bool), [None, False]),
    (li.list.sum(), t.Int, [6, 0]), (lo.list.sum(), O(t.Int), [None, 0]), (li.list.mean(), O(t.Float), [2.0, None]), (li.list.min(), O(t.Int), [1, None]), (li.list.max(), O(t.Int), [3, None]), (lo.list.max(), O(t.Int), [None, None]), (bl.list.all(), t.Bool, [False, True]), (bl.list.any(), t.Bool, [True, False]),
    (li.list.filter("x", x > 1), t.List(t.Int), [[3, 2], []]), (li.list.map("x", x * a), t.List(t.Int), [[21, 7, 14], []]), (lo.list.map("x", x.fillnull(0)).list.sum(), t.Int, [4, 0]), (lo.list.filter("x", ~x.isnull()).list.len(), t.Int, [2, 0]),
    (m.dict.get("k"), O(t.Int), [1, None]), (m.dict.get("k", 5), t.Int, [1, 5]), (m.dict.len(), t.Int, [1, 0]), (m.dict.contains("k"), t.Bool, [True, False]), (p.struct.x, t.Int, [1, 2]), (p.struct.get("y"), O(t.Str), ["u", None]), (P.expr(x=a, y=n).struct.x, t.Int, [7, -7]), (make_struct(P, x=1, y="q").struct.y, O(t.Str), ["q", "q"]),
    (repeat(a, 2), t.List(t.Int), [[7, 7], [-7, -7]]), (P.zip(x=li, y=repeat("v", 2)).list.len(), t.Int, [2, 0]), (lit([1, None, 2]).list.len(), t.Int, [3, 3]), (lit([]).list.len(), t.Int, [0, 0]), (lit(1.5), t.Float, [1.5, 1.5]), (lit(None), t.Null, [None, None]),
]


def same(got, want):
    if isinstance(want, float) and got is not None:
        return math.isnan(got) if math.isnan(want) else got == pytest.approx(want)
    return got == want


@pytest.mark.parametrize("start", range(0, len(CASES), 25))
def test_types_and_values(df, start):
    types = {k: t.dtype(v) for k, v in TYPES.items()}
    some = CASES[start : start + 25]
    for e, kind, _ in some:
        assert t.same(e.typeof(TYPES), kind), f"{e}: {e.typeof(TYPES)}"
    rows = df.select(*(e.column(types).alias(f"c{i}") for i, (e, _, _) in enumerate(some))).collect()
    for i, (e, _, want) in enumerate(some):
        for row, w in zip(rows, want, strict=True):
            assert same(row[f"c{i}"], w), f"{e}: {row[f'c{i}']!r}, not {w!r}"


BAD = [
    a + s, a & ok, ~a, -s, a > s, s > s, ts > ts, a == s, when(a).then(1), when(ok).then(1).otherwise("x"), b.fillnull("x"), s.abs(), s.num.sqrt(), a.str.len(), a.dt.year, s.list.len(), a.dict.len(), a.struct.x, p.struct.nothing, li.list.contains("x"), li.list.at("x"),
    lo.list.filter("x", x), li.list.map("y", x), li.list.map("x", li.list.map("y", x)), li.list.all(), lit({"a": 1}), col("nobody"), var("x"), P.expr(x=1), P.expr(x="s", y="t"), P.zip(x=a, y=s), repeat(a, b), m.dict.get(1), m.dict.get("k", "s"), lit([1, "x"]),
    f.astype(int), b.astype(int), lit(1).astype(str),
]


@pytest.mark.parametrize("i", range(len(BAD)))
def test_what_has_no_type(i):
    with pytest.raises(t.TypeError_):
        BAD[i].typeof(TYPES)


def test_what_cannot_be_built():
    for make in (lambda: s.str.json_extract("a.b"), lambda: s.str.json_extract("$[-1]"), lambda: ts.dt.since(ts, "month"), lambda: ts.dt.strftime("%Q"), lambda: ts.dt.with_tz("+02:00"), lambda: ts.dt.with_tz("Nowhere"), lambda: f.round(-1), lambda: a ^ b, lambda: dt_lit(2024, 13, 1)):
        with pytest.raises((t.TypeError_, ValueError)):
            make()
    with pytest.raises(TypeError):
        bool(a == 1)


def test_errors_at_run_time(df):
    types = {k: t.dtype(v) for k, v in TYPES.items()}
    for e in (a.num.pow(-1), repeat(1, a), lit("x").str.to_int()):
        with pytest.raises(Exception):
            df.select(e.column(types)).collect()


def test_now_references_text_and_casts(df):
    assert (a + f * when(ok).then(a).otherwise(li.list.at(0).fillnull(b.fillnull(0)))).references() == {"a", "f", "ok", "l", "b"}
    assert str((a + 1) == s) == "((col('a') + 1) == col('s'))"
    assert now().typeof({}) == t.Datetime and a.astype(float).typeof(TYPES) == t.Float and a.matches_type(Optional[float], TYPES) and not f.matches_type(int, TYPES)
    assert [r[0] for r in (a + 1).eval(df, TYPES).collect()] == [8, -6]


def test_formats():
    assert java_pattern("%Y-%m-%dT%H:%M:%S.%f") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" and java_pattern("it's %%") == "'it''s %'"


def test_types():
    assert t.join(t.Int, t.Optional(t.Float)) == t.optional(t.Float) and t.join(t.Null, t.Int) == t.optional(t.Int) and t.join(t.Int, t.Str) is None
    assert t.same(t.between(int, 0, 5), t.Int) and t.promotes(t.oneof(str, ["a"]), t.Optional(t.Str)) and not t.promotes(t.List(t.Int), t.List(t.Float)) and t.casts(t.List(t.Int), t.List(t.Float))
    assert t.optional(t.optional(t.Int)) == t.optional(t.Int) and t.hashable(t.List(t.Int)) and not t.hashable(t.Float) and not t.hashable(t.Embedding(3))
    assert t.duration_us("1d 6h") == 30 * 3_600_000_000 and t.duration_us("1y") == 365 * 86_400_000_000
    for make in (lambda: t.duration_us("1x"), lambda: t.duration_us(""), lambda: t.Decimal(0), lambda: t.between(str, 0, 1), lambda: t.between(int, 0.5, 1), lambda: t.oneof(int, []), lambda: t.oneof(int, ["a"]), lambda: t.regex("(?=a)"), lambda: t.Hopping("1h", "2h"), lambda: t.Tumbling("forever"), lambda: t.dtype(dict[int, int]), lambda: t.dtype(int | str)):
        with pytest.raises((t.TypeError_, ValueError)):
            make()
