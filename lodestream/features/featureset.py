"""Featuresets are classes of typed features. A feature is given in the request, or made by an extractor: a copy of another
feature, a field looked up in a dataset as of the request's time, an expression over the featureset, or a Python function."""

from __future__ import annotations

import typing
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from lodestream import types as t
from lodestream.expr.ast import Expr
from lodestream.plans.dataset import Dataset, FieldRef, environments

NO_DEFAULT = object()


class FeatureError(TypeError):
    """A rule of featuresets is broken."""


@dataclass
class FeatureDef:
    source: Any = None
    default: Any = NO_DEFAULT
    version: int = 1
    env: tuple[str, ...] | None = None


def feature(source: Any = None, default: Any = NO_DEFAULT, version: int = 1, env: Any = None) -> Any:
    """How a feature is made: Dataset.field, another feature or an expression, and what stands for a missing value."""
    return FeatureDef(source, default, version, environments(env))


@dataclass(frozen=True)
class Feature:
    featureset: str
    name: str
    dtype: t.DType

    @property
    def fqn(self) -> str:
        return f"{self.featureset}.{self.name}"

    def __str__(self) -> str:
        return self.fqn


@dataclass(frozen=True)
class Extractor:
    """Makes outputs from inputs (both fqn); kind is alias, lookup, list_lookup, expr or python."""

    name: str
    kind: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    featureset: str
    env: tuple[str, ...] | None = None
    version: int = 1
    source: Any = None
    default: Any = NO_DEFAULT
    dtype: t.DType | None = None
    fn: Callable | None = None
    deps: tuple[Dataset, ...] = ()


def extractor(fn: Callable | None = None, *, deps: list[Dataset] | None = None, version: int = 1, env: Any = None) -> Any:
    """Declares a Python extractor; @inputs and @outputs name its features."""

    def make(f: Callable) -> Callable:
        f.__extractor__ = (tuple(deps or ()), version, environments(env))
        return f

    return make if fn is None else make(fn)


class Featureset:
    def __init__(self, cls: type):
        self._name, self.cls, self.meta = cls.__name__, cls, getattr(cls, "__meta__", {})
        self.version = 1
        hints = typing.get_type_hints(cls)
        self.features: dict[str, Feature] = {}
        for n, h in hints.items():
            if n in ("cls", "expectations", "extractors", "features", "meta", "version") or n.startswith("_"):
                raise FeatureError(f"{n!r} is no name of a feature")
            self.features[n] = Feature(self._name, n, t.dtype(h))
        self.extractors: list[Extractor] = []
        for n, f in self.features.items():
            made = vars(cls).get(n)
            if made is None:
                continue
            if not isinstance(made, FeatureDef):
                made = FeatureDef(made)
            if made.source is None:
                if made.default is not NO_DEFAULT:
                    raise FeatureError(f"{f} has a default but no source")
                continue
            self.extractors.append(self._extractor(f, made))
        for n, fn in vars(cls).items():
            if hasattr(fn, "__extractor__"):
                deps, version, env = fn.__extractor__
                ins = tuple(self._feature(x).fqn for x in getattr(fn, "__inputs__", ()))
                outs = tuple(self._own(x) for x in getattr(fn, "__outputs__", ()))
                if not outs:
                    raise FeatureError(f"extractor {self._name}.{n} has no outputs")
                self.extractors.append(Extractor(n, "python", ins, outs, self._name, env, version, fn=fn, deps=deps))
        self.expectations = [m.__expectations__ for m in vars(cls).values() if hasattr(m, "__expectations__")]
        if len(self.expectations) > 1:
            raise FeatureError(f"{self._name} has several suites of expectations")
        made_by: dict[tuple[str, Any], str] = {}
        for e in self.extractors:
            for o in e.outputs:
                for env in e.env or (None,):
                    if (o, env) in made_by:
                        raise FeatureError(f"{o} is made by several extractors")
                    made_by[o, env] = e.name

    def _own(self, x: Any) -> str:
        name = x.name if isinstance(x, Feature) else x
        if name not in self.features:
            raise FeatureError(f"{self._name} has no feature {name!r}")
        return self.features[name].fqn

    def _feature(self, x: Any) -> Feature:
        if isinstance(x, Feature):
            return x
        return self.features[self._own(x).split(".")[1]]

    def _extractor(self, f: Feature, made: FeatureDef) -> Extractor:
        base = Extractor(f"{f.name}", "", (), (f.fqn,), self._name, made.env, made.version, made.source, made.default, f.dtype)
        source = made.source
        if made.default is not NO_DEFAULT and f.dtype.optional and made.default is not None and not isinstance(source, Expr):
            raise FeatureError(f"{f} has a default and can't be optional")
        if isinstance(source, Feature):
            if source.fqn == f.fqn:
                raise FeatureError(f"{f} can't be a copy of itself")
            have = source.dtype if made.default is NO_DEFAULT else t.required(source.dtype)
            if not t.promotes(have, f.dtype):
                raise FeatureError(f"{f} is {f.dtype}, not {source.dtype} as {source}")
            return replace(base, kind="alias", inputs=(source.fqn,))
        if isinstance(source, Expr):
            for n in source.references():
                self._own(n)
            kind = source.typeof({n: x.dtype for n, x in self.features.items()})
            if made.default is not NO_DEFAULT:
                kind = t.required(kind)
            if not t.casts(kind, f.dtype):
                raise FeatureError(f"{f} is {f.dtype}, not {kind}")
            return replace(base, kind="expr", inputs=tuple(f"{self._name}.{n}" for n in sorted(source.references())))
        if isinstance(source, FieldRef):
            d = source.dataset
            if d.index is None or not d.schema.keyed:
                raise FeatureError(f"{d._name} has no index to look {f} up in")
            if source.name in d.schema.keys:
                raise FeatureError(f"{source} is a key")
            for k in d.schema.keys:
                if k not in self.features:
                    raise FeatureError(f"{f} is looked up by {k}, which is no feature of {self._name}")
            keys = {k: self.features[k].dtype for k in d.schema.keys}
            have = source.dtype if made.default is not NO_DEFAULT else t.optional(source.dtype)
            have = t.required(have) if made.default is not NO_DEFAULT else have
            listed = [k for k, kind in keys.items() if isinstance(kind, t.List) and t.same(kind.of, d.schema.keys[k])]
            if listed:
                if len(listed) != len(keys):
                    raise FeatureError(f"{f}: all keys of {d._name} are lists, or none is")
                if not t.promotes(t.List(have), f.dtype):
                    raise FeatureError(f"{f} is {f.dtype}, not {t.List(have)}")
                kind = "list_lookup"
            else:
                for k, want in d.schema.keys.items():
                    if not t.same(t.required(keys[k]), want):
                        raise FeatureError(f"{self._name}.{k} is {keys[k]}, not {want} as the key of {d._name}")
                if not t.promotes(have, f.dtype):
                    raise FeatureError(f"{f} is {f.dtype}, not {have} as {source}")
                kind = "lookup"
            return replace(base, kind=kind, inputs=tuple(f"{self._name}.{k}" for k in d.schema.keys), deps=(d,))
        if isinstance(source, Featureset):
            return self._extractor(f, replace(made, source=source.features.get(f.name) or _missing(source, f)))
        raise FeatureError(f"{f} can't be made from {source!r}")

    def __getattr__(self, name: str) -> Feature:
        if name.startswith("_") or "features" not in self.__dict__:
            raise AttributeError(name)
        if name in self.features:
            return self.features[name]
        raise AttributeError(f"{self._name} has no feature {name!r}")

    def __repr__(self) -> str:
        return f"<featureset {self._name}>"


def _missing(source: Featureset, f: Feature):
    raise FeatureError(f"{source._name} has no feature {f.name!r}")


def featureset(cls: type) -> Featureset:
    """Class decorator that declares a featureset."""
    return Featureset(cls)
