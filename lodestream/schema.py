"""Schemas of datasets: keys, one timestamp, values, and their algebra. Analysis only; no data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from lodestream import types as t


class SchemaError(TypeError):
    """A schema rule is broken."""


@dataclass(frozen=True)
class Schema:
    keys: dict[str, t.DType]
    values: dict[str, t.DType]
    ts: str
    erase_keys: tuple[str, ...] = ()
    terminal: bool = False
    name: str = field(default="", compare=False)

    def __post_init__(self):
        for k, kind in self.keys.items():
            if kind.optional:
                raise SchemaError(f"key {k} of {self.name} can't be optional")
        for k in self.erase_keys:
            if k not in self.keys:
                raise SchemaError(f"erase key {k} of {self.name} is no key")
        if self.ts in self.keys or self.ts in self.values:
            raise SchemaError(f"timestamp {self.ts} of {self.name} is a key or value too")

    @property
    def keyed(self) -> bool:
        return bool(self.keys)

    @property
    def fields(self) -> dict[str, t.DType]:
        return {**self.keys, **self.values, self.ts: t.Datetime}

    def type_of(self, name: str) -> t.DType:
        if name not in self.fields:
            raise SchemaError(f"{self.name} has no field {name!r}")
        return self.fields[name]

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, k.spark(), True) for n, k in self.fields.items()])

    def matches(self, other: Schema) -> str | None:
        """Why the schemas differ; None if they don't."""
        if list(self.keys) != list(other.keys) and set(self.keys) != set(other.keys):
            return f"keys {sorted(self.keys)} and {sorted(other.keys)}"
        if set(self.values) != set(other.values):
            return f"values {sorted(self.values)} and {sorted(other.values)}"
        if self.ts != other.ts:
            return f"timestamps {self.ts} and {other.ts}"
        for n, k in self.fields.items():
            if not t.same(k, other.fields[n]):
                return f"{n} is {k} and {other.fields[n]}"
        return None

    # -- algebra ----------------------------------------------------------------------------------------------

    def rename(self, names: dict[str, str]) -> Schema:
        for old in names:
            self.type_of(old)
        left = [n for n in self.fields if n not in names]
        for new in names.values():
            if new in left or list(names.values()).count(new) > 1:
                raise SchemaError(f"{self.name} has a field {new!r} already")
        get = lambda n: names.get(n, n)
        return replace(
            self,
            keys={get(n): k for n, k in self.keys.items()},
            values={get(n): k for n, k in self.values.items()},
            ts=get(self.ts),
            erase_keys=tuple(get(k) for k in self.erase_keys),
        )

    def drop(self, names: list[str]) -> Schema:
        for n in names:
            self.type_of(n)
            if n not in self.values:
                raise SchemaError(f"{n} is a key or the timestamp of {self.name} and can't be dropped")
        return replace(self, values={n: k for n, k in self.values.items() if n not in names})

    def select(self, names: list[str]) -> Schema:
        for n in names:
            self.type_of(n)
        missing = [k for k in self.keys if k not in names]
        if missing:
            raise SchemaError(f"select must keep the keys {missing} of {self.name}")
        return replace(self, values={n: k for n, k in self.values.items() if n in names})

    def dropnull(self, names: list[str]) -> Schema:
        for n in names:
            if n not in self.values or not self.type_of(n).optional:
                raise SchemaError(f"{n} of {self.name} is not optional")
        return replace(self, values={n: t.required(k) if n in names else k for n, k in self.values.items()})

    def assign(self, columns: dict[str, t.DType]) -> Schema:
        for n in columns:
            if n in self.keys or n == self.ts:
                raise SchemaError(f"{n} is a key or the timestamp of {self.name} and can't be assigned")
        return replace(self, values={**self.values, **columns})
