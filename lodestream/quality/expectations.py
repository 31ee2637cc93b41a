"""Expectations: predicates and the least fraction of rows that must satisfy them, checked in one pass.

Nulls don't count, except where an expectation is about them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.expr.timefmt import java_pattern


@dataclass(frozen=True)
class Expectation:
    name: str
    columns: tuple[str, ...]
    holds: Callable[[DataFrame], Column]
    mostly: float = 1.0
    with_nulls: bool = False

    def __post_init__(self):
        if not 0 <= self.mostly <= 1:
            raise ValueError("mostly is between 0 and 1")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _made(name: str, columns: list[str], holds, mostly: float, with_nulls: bool = False) -> Expectation:
    return Expectation(name, tuple(columns), holds if callable(holds) and not isinstance(holds, Column) else (lambda df: holds), mostly, with_nulls)


def expect_column_values_to_not_be_null(column: str, mostly: float = 1.0) -> Expectation:
    return _made("not_null", [column], lambda df: _c(column).isNotNull(), mostly, True)


def expect_column_values_to_be_null(column: str, mostly: float = 1.0) -> Expectation:
    return _made("null", [column], lambda df: _c(column).isNull(), mostly, True)


def expect_column_values_to_be_of_type(column: str, type_: Any, mostly: float = 1.0) -> Expectation:
    return expect_column_values_to_be_in_type_list(column, [type_], mostly)


def expect_column_values_to_be_in_type_list(column: str, type_list: list[Any], mostly: float = 1.0) -> Expectation:
    return _made("type", [column], lambda df: F.lit(any(t.same(t.from_spark(df.schema[column].dataType), t.dtype(x)) for x in type_list)), mostly, True)


def expect_column_values_to_be_in_set(column: str, value_set: list, mostly: float = 1.0) -> Expectation:
    return _made("in_set", [column], lambda df: _c(column).isin(*value_set), mostly)


def expect_column_values_to_not_be_in_set(column: str, value_set: list, mostly: float = 1.0) -> Expectation:
    return _made("not_in_set", [column], lambda df: ~_c(column).isin(*value_set), mostly)


def expect_column_values_to_be_between(column: str, min_value=None, max_value=None, strict_min: bool = False, strict_max: bool = False, mostly: float = 1.0) -> Expectation:
    def holds(df: DataFrame) -> Column:
        c, out = _c(column), F.lit(True)
        if min_value is not None:
            out = out & (c > min_value if strict_min else c >= min_value)
        if max_value is not None:
            out = out & (c < max_value if strict_max else c <= max_value)
        return out

    if min_value is None and max_value is None:
        raise ValueError("between needs a limit")
    return _made("between", [column], holds, mostly)


def expect_column_value_lengths_to_be_between(column: str, min_value: int | None = None, max_value: int | None = None, mostly: float = 1.0) -> Expectation:
    low, high = min_value or 0, max_value if max_value is not None else 2**31 - 1
    return _made("length_between", [column], lambda df: F.char_length(_c(column)).between(low, high), mostly)


def expect_column_value_lengths_to_equal(column: str, value: int, mostly: float = 1.0) -> Expectation:
    return _made("length_equal", [column], lambda df: F.char_length(_c(column)) == value, mostly)


def expect_column_values_to_match_regex(column: str, regex: str, mostly: float = 1.0) -> Expectation:
    return _made("match_regex", [column], lambda df: _c(column).rlike(regex), mostly)


def expect_column_values_to_not_match_regex(column: str, regex: str, mostly: float = 1.0) -> Expectation:
    return _made("not_match_regex", [column], lambda df: ~_c(column).rlike(regex), mostly)


def expect_column_values_to_match_regex_list(column: str, regex_list: list[str], match_on: str = "any", mostly: float = 1.0) -> Expectation:
    def holds(df: DataFrame) -> Column:
        out = F.lit(match_on == "all")
        for r in regex_list:
            out = out & _c(column).rlike(r) if match_on == "all" else out | _c(column).rlike(r)
        return out

    return _made("match_regex_list", [column], holds, mostly)


def expect_column_values_to_not_match_regex_list(column: str, regex_list: list[str], mostly: float = 1.0) -> Expectation:
    any_of = expect_column_values_to_match_regex_list(column, regex_list)
    return _made("not_match_regex_list", [column], lambda df: ~any_of.holds(df), mostly)


def expect_column_values_to_match_strftime_format(column: str, strftime_format: str, mostly: float = 1.0) -> Expectation:
    pattern = java_pattern(strftime_format)
    return _made("strftime_format", [column], lambda df: F.try_to_timestamp(_c(column), F.lit(pattern)).isNotNull(), mostly)


def expect_column_values_to_be_dateutil_parseable(column: str, mostly: float = 1.0) -> Expectation:
    @F.pandas_udf("boolean")
    def parses(values: pd.Series) -> pd.Series:
        from dateutil import parser

        def ok(v) -> bool:
            try:
                parser.parse(v)
                return True
            except (ValueError, OverflowError, TypeError):
                return False

        return values.map(lambda v: None if v is None else ok(v))

    return _made("dateutil_parseable", [column], lambda df: parses(_c(column)), mostly)


def expect_column_values_to_be_json_parseable(column: str, mostly: float = 1.0) -> Expectation:
    return _made("json_parseable", [column], lambda df: F.try_parse_json(_c(column)).isNotNull(), mostly)


_JSON_KEYWORDS = {"type", "enum", "required", "properties", "items", "minimum", "maximum", "minLength", "maxLength"}
_JSON_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}


def check_json_schema(schema: Any) -> None:
    """Raises for what fits_json_schema does not know."""
    if not isinstance(schema, dict):
        raise ValueError(f"no schema {schema!r}; schemas are objects")
    unknown = set(schema) - _JSON_KEYWORDS - _JSON_NOTES
    if unknown:
        raise ValueError(f"no keywords {sorted(unknown)} in JSON schemas; there are {sorted(_JSON_KEYWORDS)}")
    for inner in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_json_schema(inner)


def fits_json_schema(value: Any, schema: dict) -> bool:
    """A JSON value against the common part of JSON Schema: type, enum, required, properties, items and limits."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    if want is not None:
        def is_kind(k: str) -> bool:
            if k == "integer":
                return isinstance(value, int) and not isinstance(value, bool)
            if k == "number":
                return isinstance(value, (int, float)) and not isinstance(value, bool)
            return isinstance(value, kinds[k])

        if not any(is_kind(k) for k in ([want] if isinstance(want, str) else want)):
            return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        if any(r not in value for r in schema.get("required", [])):
            return False
        return all(fits_json_schema(value[k], s) for k, s in schema.get("properties", {}).items() if k in value)
    if isinstance(value, list) and "items" in schema:
        return all(fits_json_schema(v, schema["items"]) for v in value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    return True


def expect_column_values_to_match_json_schema(column: str, json_schema: dict, mostly: float = 1.0) -> Expectation:
    check_json_schema(json_schema)

    @F.pandas_udf("boolean")
    def fits(values: pd.Series) -> pd.Series:
        def ok(v) -> bool:
            try:
                return fits_json_schema(json.loads(v), json_schema)
            except ValueError:
                return False

        return values.map(lambda v: None if v is None else ok(v))

    return _made("json_schema", [column], lambda df: fits(_c(column)), mostly)


def expect_column_pair_values_to_be_equal(column_A: str, column_B: str, mostly: float = 1.0) -> Expectation:
    return _made("pair_equal", [column_A, column_B], lambda df: _c(column_A) == _c(column_B), mostly)


def expect_column_pair_values_A_to_be_greater_than_B(column_A: str, column_B: str, or_equal: bool = False, mostly: float = 1.0) -> Expectation:
    return _made("pair_greater", [column_A, column_B], lambda df: (_c(column_A) >= _c(column_B)) if or_equal else (_c(column_A) > _c(column_B)), mostly)


def expect_column_pair_values_to_be_in_set(column_A: str, column_B: str, value_pairs_set: list[tuple], mostly: float = 1.0) -> Expectation:
    def holds(df: DataFrame) -> Column:
        out = F.lit(False)
        for a, b in value_pairs_set:
            out = out | ((_c(column_A) == a) & (_c(column_B) == b))
        return out

    return _made("pair_in_set", [column_A, column_B], holds, mostly)


def expect_multicolumn_sum_to_equal(column_list: list[str], sum_total: float, mostly: float = 1.0) -> Expectation:
    def holds(df: DataFrame) -> Column:
        out = _c(column_list[0])
        for c in column_list[1:]:
            out = out + _c(c)
        return out == sum_total

    return _made("multicolumn_sum", list(column_list), holds, mostly)


def expectations(fn: Callable) -> Callable:
    """Method decorator: the method gives the list of a dataset's or featureset's expectations."""
    fn.__expectations__ = fn
    return fn


def report(df: DataFrame, suite: list[Expectation]) -> DataFrame:
    """One row per expectation: name, columns, n_rows (that count), n_ok, fraction, mostly, success; one pass over df.

    An expectation about no rows succeeds, with a null fraction.
    """
    sums = []
    for i, e in enumerate(suite):
        counts = F.lit(True)
        if not e.with_nulls:
            for c in e.columns:
                counts = counts & _c(c).isNotNull()
        ok = F.coalesce(e.holds(df), F.lit(False))
        sums += [F.count(F.when(counts, 1)).alias(f"n{i}"), F.count(F.when(counts & ok, 1)).alias(f"k{i}")]
    totals = df.agg(*sums)
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("no"),
                F.lit(e.name).alias("name"),
                F.lit(",".join(e.columns)).alias("columns"),
                F.col(f"n{i}").alias("n_rows"),
                F.col(f"k{i}").alias("n_ok"),
                F.lit(float(e.mostly)).alias("mostly"),
            )
            for i, e in enumerate(suite)
        )
    )
    one = totals.select(F.explode(rows).alias("r")).select("r.*")
    fraction = F.when(F.col("n_rows") > 0, F.col("n_ok") / F.col("n_rows"))
    return one.select("no", "name", "columns", "n_rows", "n_ok", fraction.alias("fraction"), "mostly", F.coalesce(fraction >= F.col("mostly"), F.lit(True)).alias("success"))
