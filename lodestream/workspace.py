"""A workspace: named branches of committed datasets and featuresets, and the data logged to them.

It plans; Spark holds and moves the data. What is logged to a branch is a list of frames; a derived dataset is a plan
over them, built when something asks for it, and written to the shared folder if materialize() says so.
"""

from __future__ import annotations

import copy
import datetime as dt
import time
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.features.extractors import AT, check_cycles, extractor_order, lookup_join, run
from lodestream.features.featureset import Feature, FeatureError, Featureset
from lodestream.operators.temporal import VALID_TO, validity
from lodestream.plans.dataset import SEQ, Dataset, Pipeline, selected
from lodestream.runtime import staged
from lodestream.schema import SchemaError
from lodestream.sources.connectors import Source, check_source, ingest, read

MAIN = "main"


class WorkspaceError(Exception):
    """Something asked of a workspace is against its rules."""


@dataclass
class Branch:
    name: str
    env: str | None = None
    datasets: dict[str, Dataset] = field(default_factory=dict)
    featuresets: dict[str, Featureset] = field(default_factory=dict)
    logged: dict[str, list[DataFrame]] = field(default_factory=dict)
    materialized: dict[str, DataFrame] = field(default_factory=dict)
    erased: dict[str, list[DataFrame]] = field(default_factory=dict)
    created: dict[str, float] = field(default_factory=dict)
    last_log: dict[str, float] = field(default_factory=dict)
    commits: list[str] = field(default_factory=list)


class Workspace:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.branches: dict[str, Branch] = {MAIN: Branch(MAIN)}
        self.current = MAIN
        self.secrets: dict[str, str] = {}
        self.tracked: dict[str, dict] = {}
        self._seq = 0

    # -- branches ---------------------------------------------------------------------------------------------

    @property
    def branch(self) -> Branch:
        return self.branches[self.current]

    def init_branch(self, name: str) -> None:
        if name in self.branches:
            raise WorkspaceError(f"there is a branch {name}")
        self.branches[name] = Branch(name)
        self.current = name

    def clone_branch(self, name: str, from_branch: str) -> None:
        if name in self.branches:
            raise WorkspaceError(f"there is a branch {name}")
        made = copy.copy(self._branch(from_branch))
        made.name = name
        for part in ("datasets", "featuresets", "materialized", "created", "last_log"):
            setattr(made, part, dict(getattr(made, part)))
        for part in ("logged", "erased"):
            setattr(made, part, {k: list(v) for k, v in getattr(made, part).items()})
        made.commits = list(made.commits)
        self.branches[name] = made
        self.current = name

    def delete_branch(self, name: str) -> None:
        self._branch(name)
        if name == MAIN:
            raise WorkspaceError("the main branch stays")
        del self.branches[name]
        if self.current == name:
            self.current = MAIN

    def list_branches(self) -> list[str]:
        return list(self.branches)

    def checkout(self, name: str, init: bool = False) -> None:
        if init and name not in self.branches:
            self.init_branch(name)
        self._branch(name)
        self.current = name

    def _branch(self, name: str) -> Branch:
        if name not in self.branches:
            raise WorkspaceError(f"no branch {name}")
        return self.branches[name]

    # -- commits ----------------------------------------------------------------------------------------------

    def commit(self, message: str, datasets: list[Dataset] | None = None, featuresets: list[Featureset] | None = None, preview: bool = False, incremental: bool = False, env: str | None = None, backfill: bool = True) -> dict[str, list[str]]:
        """Make these the branch's definitions (or add them, if incremental); gives what was added, changed and removed.

        A definition that differs from the committed one needs a higher version. preview checks and changes nothing.
        backfill False leaves data logged so far out of datasets that are new.
        """
        if not message:
            raise WorkspaceError("a commit needs a message")
        b = self.branch
        new_d = {d._name: d for d in datasets or []}
        new_f = {f._name: f for f in featuresets or []}
        all_d = {**b.datasets, **new_d} if incremental else new_d
        all_f = {**b.featuresets, **new_f} if incremental else new_f
        changes: dict[str, list[str]] = {"added": [], "changed": [], "removed": []}
        for old, new in ((b.datasets, all_d), (b.featuresets, all_f)):
            for n, x in new.items():
                if n not in old:
                    changes["added"].append(n)
                elif old[n] is not x and _signature(old[n]) != _signature(x):
                    if getattr(x, "version", 1) <= getattr(old[n], "version", 1) and isinstance(x, Dataset):
                        raise WorkspaceError(f"{n} has changed and needs a higher version")
                    changes["changed"].append(n)
                elif isinstance(x, Dataset) and x.version < old[n].version:
                    raise WorkspaceError(f"the version of {n} can't go back")
            changes["removed"] += [n for n in old if n not in new]
        for d in all_d.values():
            for s in d.sources:
                check_source(d, s)
            for p in d.pipelines:
                for i in p.inputs:
                    if i._name not in all_d:
                        raise WorkspaceError(f"{d._name} needs {i._name}, which is not committed")
            d.pipeline_for(env)
        for f in all_f.values():
            for e in f.extractors:
                for d in e.deps:
                    if d._name not in all_d:
                        raise WorkspaceError(f"{f._name}.{e.name} needs {d._name}, which is not committed")
                for i in [*e.inputs]:
                    if i.split(".")[0] not in all_f:
                        raise WorkspaceError(f"{f._name}.{e.name} needs {i}, which is not committed")
        check_cycles(all_f)
        if preview:
            return changes
        b.datasets, b.featuresets, b.env = all_d, all_f, env
        for n in [*changes["changed"], *changes["removed"]]:
            b.logged.pop(n, None)
        for n in changes["added"]:
            b.created[n] = time.time()
            if not backfill:
                b.logged.pop(n, None)
        b.materialized.clear()
        b.commits.append(message)
        return changes

    # -- data in ----------------------------------------------------------------------------------------------

    def log(self, webhook: str, endpoint: str, df: DataFrame | pd.DataFrame) -> None:
        """Rows for every dataset with a source on the endpoint."""
        hit = False
        for d in self.branch.datasets.values():
            for s in d.sources:
                o = s.conn.options
                if s.conn.system == "webhook" and (o["name"], o["endpoint"]) == (webhook, endpoint) and selected(s.env, self.branch.env):
                    self.log_frame(d, df, s)
                    hit = True
        if not hit:
            raise WorkspaceError(f"no dataset has a source on {webhook}/{endpoint}")

    def log_frame(self, d: Dataset, df: DataFrame | pd.DataFrame, source: Source | None = None) -> None:
        """Rows for a dataset, past a source's preproc, where and sample if one is given."""
        if d._name not in self.branch.datasets:
            raise WorkspaceError(f"{d._name} is not committed")
        if d.pipelines:
            raise WorkspaceError(f"{d._name} comes from a pipeline")
        b, now = self.branch, time.time()
        if source is not None and source.bounded:
            last = b.last_log.get(d._name, b.created.get(d._name, now))
            if now - last >= t.duration_us(source.idleness) / 1e6:
                return  # the source has ended
        b.last_log[d._name] = now
        if isinstance(df, pd.DataFrame):
            df = self._from_pandas(df, d, source)
        rows = ingest(df, d, source)
        # the order of arrival: of the batch, then of the row within it; the next batch starts behind this one's last number
        seen = Observation()
        rows = rows.withColumn(SEQ, F.lit(self._seq).cast("bigint") + F.monotonically_increasing_id()).observe(seen, F.max(SEQ).alias("last"))
        b.logged.setdefault(d._name, []).append(staged(rows, f"log-{d._name}"))
        last = seen.get.get("last")
        if last is not None:
            self._seq = ((last >> 33) + 1) << 33  # ids count on from a multiple of 2**33 in each partition
        b.materialized.clear()

    def ingest_sources(self) -> None:
        """Read the sources that can be read, and log their rows."""
        for d in list(self.branch.datasets.values()):
            for s in d.sources:
                if s.conn.system != "webhook" and selected(s.env, self.branch.env):
                    self.log_frame(d, read(self.spark, d, s, secrets=self.secrets), s)

    def _from_pandas(self, df: pd.DataFrame, d: Dataset, source: Source | None) -> DataFrame:
        from pyspark.sql import types as T

        fields = []
        made = set(source.preproc) if source else set()
        for c in df.columns:
            if c in d.schema.fields and c not in made:
                fields.append(T.StructField(c, d.schema.fields[c].spark(), True))
            else:
                fields = None
                break
        out = df.copy()
        for c in out.columns:
            if isinstance(out[c].dtype, pd.DatetimeTZDtype):
                out[c] = out[c].dt.tz_convert("UTC").dt.tz_localize(None)
        if fields is None:
            return self.spark.createDataFrame(out)
        values = [[None if not isinstance(v, (list, dict, tuple)) and pd.isna(v) else _plain(v) for v in row] for row in out.itertuples(index=False)]
        try:
            return self.spark.createDataFrame(values, T.StructType(fields))
        except Exception as e:
            raise SchemaError(f"rows don't have the types of {d._name}: {e}") from e

    # -- frames -----------------------------------------------------------------------------------------------

    def frame(self, d: Dataset) -> DataFrame:
        """The dataset's rows, with the hidden columns of frames."""
        b = self.branch
        if d._name not in b.datasets:
            raise WorkspaceError(f"{d._name} is not committed")
        if d._name in b.materialized:
            return b.materialized[d._name]
        p: Pipeline | None = d.pipeline_for(b.env)
        if p is not None:
            rows = p.node.frame(self.frame)
            for column in (SEQ,):
                if column not in rows.columns:
                    rows = rows.withColumn(column, F.lit(0).cast("bigint"))
            order = [*d.schema.fields, *([VALID_TO] if VALID_TO in rows.columns else []), SEQ]
            rows = rows.select(*(F.col(f"`{c}`") for c in order))
        else:
            parts = b.logged.get(d._name, [])
            if parts:
                rows = parts[0]
                for more in parts[1:]:
                    rows = rows.unionByName(more, allowMissingColumns=True)
            else:
                schema = d.schema.spark().add(SEQ, "bigint")
                rows = self.spark.createDataFrame([], schema)
            if d.schema.keyed:
                rows = validity(rows, list(d.schema.keys), d.schema.ts, [SEQ])
                if "_deleted" in rows.columns:
                    rows = rows.where("NOT coalesce(_deleted, false)").drop("_deleted")
        for keys in b.erased.get(d._name, []):
            names = list(d.schema.erase_keys)
            rows = rows.join(keys, names, "left_anti")
        return rows

    def materialize(self, d: Dataset) -> DataFrame:
        """Write the dataset once, so that plans that use it start from there."""
        self.branch.materialized[d._name] = staged(self.frame(d), f"dataset-{d._name}")
        return self.branch.materialized[d._name]

    def inspect(self, d: Dataset, n: int = 10) -> DataFrame:
        """The latest n rows."""
        return self.frame(d).select(*(F.col(f"`{c}`") for c in d.schema.fields)).orderBy(F.col(f"`{d.schema.ts}`").desc()).limit(n)

    def check(self, d: Dataset) -> DataFrame:
        """The report of the dataset's expectations."""
        from lodestream.quality.expectations import report

        if not d.expectations:
            raise WorkspaceError(f"{d._name} has no expectations")
        return report(self.frame(d), d.expectations[0](d.cls))

    def erase(self, d: Dataset, erase_keys: pd.DataFrame | DataFrame | list[dict]) -> None:
        """Remove the rows of these values of the erase keys, now and later."""
        if not d.schema.erase_keys:
            raise WorkspaceError(f"{d._name} has no erase keys")
        keys = erase_keys if isinstance(erase_keys, DataFrame) else self.spark.createDataFrame(pd.DataFrame(erase_keys))
        if set(keys.columns) != set(d.schema.erase_keys):
            raise WorkspaceError(f"erasing from {d._name} takes {list(d.schema.erase_keys)}")
        self.branch.erased.setdefault(d._name, []).append(keys.distinct())
        self.branch.materialized.clear()

    # -- data out ---------------------------------------------------------------------------------------------

    def lookup(self, d: Dataset | str, keys: DataFrame | pd.DataFrame | list[dict[str, Any]], fields: list[str] | None = None, timestamps: Any = None) -> tuple[DataFrame, str]:
        """keys with the fields as of timestamps (a column's name, or one time per key, or None for now), and the name of
        the column that tells whether there was a row."""
        if isinstance(d, str):
            if d not in self.branch.datasets:
                raise WorkspaceError(f"{d} is not committed")
            d = self.branch.datasets[d]
        if d.index is None:
            raise WorkspaceError(f"{d._name} has no index")
        if timestamps is None and not d.index.online:
            raise WorkspaceError(f"{d._name} has no online index")
        if timestamps is not None and not d.index.offline:
            raise WorkspaceError(f"{d._name} has no offline index")
        if not isinstance(keys, DataFrame):
            from pyspark.sql import types as T

            given = keys.to_dict("records") if isinstance(keys, pd.DataFrame) else keys
            times = [None] * len(given) if timestamps is None else [_utc(x) for x in timestamps]
            schema = T.StructType([T.StructField(k, kind.spark()) for k, kind in d.schema.keys.items()])
            if timestamps is not None:
                schema = schema.add(AT, "timestamp")
            rows = [(*(_plain(k[n]) for n in d.schema.keys), *([at] if timestamps is not None else [])) for k, at in zip(given, times, strict=True)]
            asked = self.spark.createDataFrame(rows, schema)
        else:
            missing = [k for k in d.schema.keys if k not in keys.columns]
            if missing:
                raise WorkspaceError(f"{d._name} is looked up by {missing} too")
            asked = keys.withColumn(AT, F.col(timestamps)) if timestamps is not None else keys
        if AT not in asked.columns:
            asked = asked.withColumn(AT, F.current_timestamp())
        names = fields or [*d.schema.values, d.schema.ts]
        for n in names:
            d.schema.type_of(n)
        made = lookup_join(asked, self.frame(d), d, list(d.schema.keys), AT, {n: n if n not in asked.columns else f"{n}_found" for n in names}, self.branch.env, found="found")
        return made.drop(AT), "found"

    def _outputs(self, outputs: list[Any]) -> list[Feature]:
        found: list[Feature] = []
        for o in outputs:
            if isinstance(o, Featureset):
                found += o.features.values()
            elif isinstance(o, Feature):
                found.append(o)
            else:
                parts = str(o).split(".")
                fs = self.branch.featuresets.get(parts[0])
                if fs is None:
                    raise FeatureError(f"no featureset {parts[0]}")
                found += [fs.features[parts[1]]] if len(parts) == 2 and parts[1] in fs.features else list(fs.features.values()) if len(parts) == 1 else _no_feature(o)
        return found

    def _extract(self, outputs: list[Any], df: DataFrame, inputs: list[Any] | None, at: F.Column | None, keep: list[str]) -> DataFrame:
        wanted = self._outputs(outputs)
        given = [f.fqn for f in self._outputs(inputs)] if inputs is not None else [c for c in df.columns if c.count(".") == 1]
        missing = [c for c in given if c not in df.columns]
        if missing:
            raise FeatureError(f"the request has no {missing}")
        kinds = {f.fqn: f.dtype for fs in self.branch.featuresets.values() for f in fs.features.values()}
        start = df.select(*(F.col(f"`{c}`").cast(kinds[c].spark()).alias(c) for c in given), *(F.col(f"`{c}`") for c in keep), (F.current_timestamp() if at is None else at).alias(AT))
        order = extractor_order(self.branch.featuresets, [f.fqn for f in wanted], set(given), self.branch.env)
        made = run(start, order, self.branch.featuresets, self.frame, self.branch.env)
        return made.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"`{f.fqn}`") for f in wanted))

    def query(self, outputs: list[Any], input_df: DataFrame, inputs: list[Any] | None = None) -> DataFrame:
        """The outputs for each row of the request, as of now."""
        return self._extract(outputs, input_df, inputs, None, [])

    def query_offline(self, outputs: list[Any], input_df: DataFrame, timestamp_column: str, inputs: list[Any] | None = None) -> DataFrame:
        """The outputs for each row of the request, as of its time."""
        if timestamp_column not in input_df.columns:
            raise FeatureError(f"the request has no {timestamp_column}")
        return self._extract(outputs, input_df, inputs, F.col(f"`{timestamp_column}`").cast("timestamp"), [timestamp_column])

    def track_offline_query(self, name: str, outputs: list[Any], input_df: DataFrame, timestamp_column: str, path: str) -> str:
        """Run an offline query into files; its state can be asked for by name."""
        self.tracked[name] = {"status": "running", "path": path, "started": time.time()}
        try:
            self.query_offline(outputs, input_df, timestamp_column).write.mode("overwrite").parquet(path)
            self.tracked[name]["status"] = "completed"
        except Exception as e:
            self.tracked[name] |= {"status": "failed", "error": str(e)}
            raise
        return name

    def offline_query_status(self, name: str) -> dict:
        if name not in self.tracked:
            raise WorkspaceError(f"no offline query {name}")
        return self.tracked[name]

    # -- about the workspace ----------------------------------------------------------------------------------

    def add_secret(self, name: str, value: Any) -> None:
        if name in self.secrets:
            raise WorkspaceError(f"there is a secret {name}")
        self.secrets[name] = value

    def update_secret(self, name: str, value: Any) -> None:
        self.get_secret(name)
        self.secrets[name] = value

    def get_secret(self, name: str) -> Any:
        if name not in self.secrets:
            raise WorkspaceError(f"no secret {name}")
        return self.secrets[name]

    def delete_secret(self, name: str) -> None:
        self.get_secret(name)
        del self.secrets[name]

    def lineage(self) -> dict[str, list[str]]:
        """What each dataset, featureset and feature is made from."""
        b = self.branch
        out = {d._name: sorted({i._name for p in d.pipelines for i in p.inputs}) for d in b.datasets.values()}
        for fs in b.featuresets.values():
            for e in fs.extractors:
                for o in e.outputs:
                    out[o] = sorted({*e.inputs, *(d._name for d in e.deps)})
        return out

    def xray(self, datasets: list[Dataset | str] | None = None, properties: list[str] | None = None) -> list[dict[str, Any]]:
        """Properties of datasets: name, keyed, fields, version, sources, pipelines, terminal, index, meta."""
        names = None if datasets is None else {d if isinstance(d, str) else d._name for d in datasets}
        rows = []
        for d in self.branch.datasets.values():
            if names is not None and d._name not in names:
                continue
            row = {
                "name": d._name,
                "keyed": d.schema.keyed,
                "fields": {n: str(k) for n, k in d.schema.fields.items()},
                "version": d.version,
                "sources": [s.conn.system for s in d.sources],
                "pipelines": [p.name for p in d.pipelines],
                "terminal": d.terminal,
                "index": d.index is not None,
                "meta": d.meta,
            }
            rows.append({k: v for k, v in row.items() if properties is None or k in properties})
        return rows


def _no_feature(o: Any):
    raise FeatureError(f"no feature {o}")


def _plain(v: Any) -> Any:
    if isinstance(v, pd.Timestamp):
        return _utc(v.to_pydatetime())
    if isinstance(v, dt.datetime):
        return _utc(v)
    if hasattr(v, "as_dict"):
        return {k: _plain(x) for k, x in v.as_dict().items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v.item() if hasattr(v, "item") else v


def _utc(ts: Any) -> dt.datetime:
    if isinstance(ts, pd.Timestamp):
        ts = ts.to_pydatetime()
    return ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)


def _signature(x: Any) -> Any:
    if isinstance(x, Dataset):
        return (str(x.schema.keys), str(x.schema.values), x.schema.ts, tuple((p.name, _node_signature(p.node)) for p in x.pipelines))
    return tuple(sorted((e.name, e.version, str(e.inputs), str(e.outputs), str(e.source)) for e in x.extractors)), tuple((n, str(f.dtype)) for n, f in x.features.items())


def _node_signature(node: Any) -> str:
    if isinstance(node, Dataset):
        return node._name
    own = {k: v for k, v in vars(node).items() if isinstance(v, (str, int, list, tuple, type(None))) and k != "schema"}
    code = [v.__code__.co_code.hex() for v in vars(node).values() if hasattr(v, "__code__")]
    exprs = [str(v) for v in vars(node).values() if hasattr(v, "references")] + [f"{k}={v}" for x in vars(node).values() if isinstance(x, dict) for k, v in x.items()]
    return f"{type(node).__name__}({own}{code}{exprs}{[_node_signature(i) for i in node.inputs()]})"
