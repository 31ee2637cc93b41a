"""Running extractors over a request: one Spark plan of projections and as-of joins.

Which extractors run is found backwards from the outputs, stopping at what the request gives. A Python extractor runs
in batches beside its data; what it may look up is joined to its rows beforehand.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream import types as t
from lodestream.expr.ast import Scope
from lodestream.features.featureset import NO_DEFAULT, Extractor, FeatureError, Featureset
from lodestream.operators import aggregates as agg
from lodestream.operators.temporal import asof_join
from lodestream.plans.dataset import Dataset, selected
from lodestream.runtime import staged

AT = "_at"
ROW = "_row"


def extractor_order(featuresets: dict[str, Featureset], outputs: list[str], given: set[str], env: str | None = None) -> list[Extractor]:
    """The extractors that outputs need beyond what is given, each after those it depends on."""
    by_output = {o: e for fs in featuresets.values() for e in fs.extractors if selected(e.env, env) for o in e.outputs}
    order: list[Extractor] = []
    state: dict[str, int] = {}

    def visit(e: Extractor) -> None:
        key = f"{e.featureset}.{e.name}"
        if state.get(key) == 2:
            return
        if state.get(key) == 1:
            raise FeatureError(f"extractors depend on each other in a circle at {key}")
        state[key] = 1
        for i in e.inputs:
            need(i)
        state[key] = 2
        order.append(e)

    def need(feature: str) -> None:
        if feature in given:
            return
        if feature not in by_output:
            raise FeatureError(f"nothing makes the feature {feature}, and the request does not give it")
        visit(by_output[feature])

    for o in outputs:
        need(o)
    return order


def check_cycles(featuresets: dict[str, Featureset]) -> None:
    """FeatureError if extractors depend on each other in a circle."""
    by_output = {o: e for fs in featuresets.values() for e in fs.extractors for o in e.outputs}
    state: dict[str, int] = {}

    def visit(f: str) -> None:
        if state.get(f) == 2 or f not in by_output:
            return
        if state.get(f) == 1:
            raise FeatureError(f"extractors depend on each other in a circle at {f}")
        state[f] = 1
        for i in by_output[f].inputs:
            visit(i)
        state[f] = 2

    for f in by_output:
        visit(f)


def defaults_of(d: Dataset, env: str | None) -> dict[str, Column]:
    """What aggregates give for keys without rows."""
    node = d.aggregate_node(env)
    if node is None:
        return {}
    return {s.into_field: s.empty(node.types.get(s.of)) for s in node.specs}


def lookup_join(df: DataFrame, history: DataFrame, d: Dataset, keys: list[str], at: str, fields: dict[str, str], env: str | None = None, found: str | None = None) -> DataFrame:
    """df with fields of a dataset as they were known at the time in column at; nulls, or the defaults of its aggregates,
    where there was nothing. Decaying sums are brought to that time."""
    ts = d.schema.ts
    node = d.aggregate_node(env)
    decaying = {s.into_field: s for s in node.specs if isinstance(s, agg.ExpDecaySum)} if node else {}
    wanted = {n: out for n, out in fields.items() if n not in d.schema.keys}
    extra = {ts: "_changed"} if decaying and ts not in wanted else {}
    flag = found or "_found"
    on = list(zip(keys, d.schema.keys, strict=True))
    out = asof_join(df, history, on, at, ts, {**wanted, **extra}, order=["_seq"] if "_seq" in history.columns else [], found=flag)
    changed = F.col(f"`{wanted.get(ts, '_changed')}`")
    for n, s in decaying.items():
        if n in wanted:
            c = F.col(f"`{wanted[n]}`")
            out = out.withColumn(wanted[n], s.decay(c, F.unix_micros(F.col(at)) - F.unix_micros(changed)))
    for n, empty in defaults_of(d, env).items():
        if n in wanted:
            out = out.withColumn(wanted[n], F.when(F.col(flag), F.col(f"`{wanted[n]}`")).otherwise(empty))
    for n, name in fields.items():
        if n in d.schema.keys:
            out = out.withColumn(name, F.when(F.col(flag), F.col(f"`{keys[list(d.schema.keys).index(n)]}`")))
    return out.drop("_changed", *([] if found else ["_found"]))


def _with_default(c: Column, e: Extractor) -> Column:
    if e.default is NO_DEFAULT:
        return c
    from lodestream.expr.ast import literal

    return F.coalesce(c, literal(e.default, e.dtype))


def run(df: DataFrame, order: list[Extractor], featuresets: dict[str, Featureset], history: Callable[[Dataset], DataFrame], env: str | None = None) -> DataFrame:
    """df (with features by fqn and the time in AT) with what the extractors make.

    Lookups in one dataset by the same keys are one join.
    """
    done: set[int] = set()
    for i, e in enumerate(order):
        if i in done:
            continue
        if e.kind == "alias":
            df = df.withColumn(e.outputs[0], _with_default(F.col(f"`{e.inputs[0]}`").cast(e.dtype.spark()), e))
        elif e.kind == "expr":
            fs = featuresets[e.featureset]
            scope = Scope({n: f.dtype for n, f in fs.features.items()}, lambda n, fs=fs: F.col(f"`{fs._name}.{n}`"), now=F.col(AT))
            df = df.withColumn(e.outputs[0], _with_default(e.source.resolve(scope).column.cast(e.dtype.spark()), e))
        elif e.kind == "lookup":
            same = [j for j in range(i, len(order)) if order[j].kind == "lookup" and order[j].deps == e.deps and order[j].inputs == e.inputs and j not in done]
            done.update(same)
            fields: dict[str, str] = {}
            for j in same:
                fields.setdefault(order[j].source.name, f"_x_{order[j].source.name}")
            df = lookup_join(df, history(e.deps[0]), e.deps[0], list(e.inputs), AT, fields, env)
            for j in same:
                o = order[j]
                df = df.withColumn(o.outputs[0], _with_default(F.col(f"`{fields[o.source.name]}`").cast(o.dtype.spark()), o))
            df = df.drop(*fields.values())
        elif e.kind == "list_lookup":
            df = _list_lookup(df, e, history, env)
        else:
            df = _python(df, e, featuresets, history, env)
    return df


def _list_lookup(df: DataFrame, e: Extractor, history: Callable[[Dataset], DataFrame], env: str | None) -> DataFrame:
    """Look up each element of the key lists, and put the results back in order."""
    d = e.deps[0]
    keys = list(d.schema.keys)
    sizes = [F.size(F.col(f"`{i}`")) for i in e.inputs]
    uneven = F.lit(False)
    for s in sizes[1:]:
        uneven = uneven | (s != sizes[0])
    zipped = F.arrays_zip(*(F.col(f"`{i}`").alias(f"k{n}") for n, i in enumerate(e.inputs)))
    # numbered once and written: the numbers must be the same in both branches below, also after a task is run again
    numbered = staged(df.withColumn(ROW, F.monotonically_increasing_id()), "requests") if ROW not in df.columns else df
    checked = F.when(uneven, F.raise_error(F.lit(f"{e.outputs[0]}: key lists of unequal length")).cast("int")).otherwise(F.lit(0))
    one = numbered.select(ROW, AT, checked.alias("_c"), F.posexplode(zipped).alias("_pos", "_k")).where("_c = 0").select(ROW, AT, "_pos", *(F.col(f"_k.k{n}").alias(f"_k{n}") for n in range(len(keys))))
    met = lookup_join(one, history(d), d, [f"_k{n}" for n in range(len(keys))], AT, {e.source.name: "_v"}, env)
    value = _with_default(F.col("_v"), e) if e.default is NO_DEFAULT or not isinstance(e.default, list) else F.col("_v")
    packed = met.select(ROW, F.struct("_pos", value.alias("v")).alias("_p")).groupBy(ROW).agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    out = numbered.join(packed, ROW, "left").withColumn(
        e.outputs[0],
        F.when(F.col(f"`{e.inputs[0]}`").isNull(), F.lit(None)).otherwise(F.coalesce(F.transform("_ps", lambda p: p["v"]), F.array())).cast(e.dtype.spark()),
    )
    return out.drop("_ps", *([] if ROW in df.columns else [ROW]))


_local = threading.local()


def hold_lookups(lookups: dict) -> None:
    _local.lookups = lookups


def prefetched(d: Dataset, ts: pd.Series, keys: dict[str, pd.Series], fields: list[str] | None) -> tuple[pd.DataFrame, pd.Series]:
    held = getattr(_local, "lookups", {}).get(d._name)
    if held is None:
        raise FeatureError(f"{d._name} can be looked up only in an extractor that names it in deps")
    by, values, found = held
    if set(keys) != set(d.schema.keys):
        raise FeatureError(f"{d._name} is looked up by {sorted(d.schema.keys)}, not {sorted(keys)}")
    for k, s in keys.items():
        if not pd.Series(s).reset_index(drop=True).astype(object).equals(by[k].reset_index(drop=True).astype(object)):
            raise FeatureError(f"{d._name} is looked up by a {k} that is not an input of the extractor")
    names = fields or [c for c in values.columns]
    return values[names].reset_index(drop=True), found.reset_index(drop=True)


def _python(df: DataFrame, e: Extractor, featuresets: dict[str, Featureset], history: Callable[[Dataset], DataFrame], env: str | None) -> DataFrame:
    kinds = {f.fqn: f.dtype for fs in featuresets.values() for f in fs.features.values()}
    joined, held = df, []
    for d in e.deps:
        by = _key_inputs(d, e, kinds)
        fields = {n: f"_{d._name}_{n}" for n in [*d.schema.values, d.schema.ts]}
        joined = lookup_join(joined, history(d), d, [by[k] for k in d.schema.keys], AT, fields, env, found=f"_{d._name}_found")
        held.append((d._name, by, fields))
    fn, ins, outs = e.fn, list(e.inputs), list(e.outputs)
    # names without dots on the way to Python and back
    plain = {c: f"c{i}" for i, c in enumerate(joined.columns)}
    kept = [plain[c] for c in df.columns if c not in outs]
    made = T.StructType([T.StructField(plain[f.name], f.dataType, True) for f in df.schema.fields if f.name not in outs])
    for i, o in enumerate(outs):
        made = made.add(f"o{i}", kinds[o].spark(), True)
    short = [o.split(".")[-1] for o in outs]
    at, arguments = plain[AT], [plain[i] for i in ins]
    lookups = [(name, {k: plain[c] for k, c in by.items()}, {n: plain[c] for n, c in fields.items()}, plain[f"_{name}_found"]) for name, by, fields in held]
    times = [t.required(kinds[o]) == t.Datetime for o in outs]

    def over(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            hold_lookups({name: ({k: pdf[c] for k, c in by.items()}, pdf[list(fields.values())].set_axis(list(fields), axis=1), pdf[found]) for name, by, fields, found in lookups})
            try:
                got = fn(None, pdf[at].dt.tz_localize("UTC"), *(pdf[i] for i in arguments))
            finally:
                hold_lookups({})
            columns = [got] if isinstance(got, pd.Series) else [got[s] if s in got.columns else got[o] for s, o in zip(short, outs, strict=True)]
            result = pdf[kept].copy()
            for i, (o, c) in enumerate(zip(outs, columns, strict=True)):
                if len(c) != len(pdf):
                    raise ValueError(f"{o}: {len(c)} values for {len(pdf)} rows")
                result[f"o{i}"] = list(c)
                if times[i]:
                    result[f"o{i}"] = pd.to_datetime(result[f"o{i}"], utc=True).dt.tz_localize(None)
            yield result

    ran = joined.select(*(F.col(f"`{c}`").alias(p) for c, p in plain.items())).mapInPandas(over, made)
    names = {p: c for c, p in plain.items()}
    out = ran.select(*(F.col(c).alias(names[c]) for c in kept), *(F.col(f"o{i}").alias(o) for i, o in enumerate(outs)))
    for o in outs:
        rule = t.required(kinds[o]).constraint(F.col(f"`{o}`"))
        bad = F.lit(False) if kinds[o].optional else F.col(f"`{o}`").isNull()
        if rule is not None:
            bad = bad | (F.col(f"`{o}`").isNotNull() & ~rule)
        out = out.withColumn(o, F.when(bad, F.raise_error(F.lit(f"a value breaks the type {kinds[o]} of {o}")).cast(kinds[o].spark())).otherwise(F.col(f"`{o}`")))
    return out


def _key_inputs(d: Dataset, e: Extractor, kinds: dict[str, t.DType]) -> dict[str, str]:
    """Which input is which key: by name, else by type in order."""
    by: dict[str, str] = {}
    left = list(e.inputs)
    for k in d.schema.keys:
        named = [i for i in left if i.split(".")[-1] == k]
        if named:
            by[k] = named[0]
            left.remove(named[0])
    for k, kind in d.schema.keys.items():
        if k not in by:
            fitting = [i for i in left if t.same(t.required(kinds[i]), kind)]
            if not fitting:
                raise FeatureError(f"{e.name} has no input for the key {k} of {d._name}")
            by[k] = fitting[0]
            left.remove(fitting[0])
    return by

