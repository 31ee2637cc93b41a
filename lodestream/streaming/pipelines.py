"""Pipelines kept up to date as their inputs stream in: the definitions that run in batch, over micro-batches.

Stateless operators are applied to what a micro-batch brings. Each stateful operator (aggregate, join, dedup, first, latest, and
the history of a keyed input) holds its input rows in a table in buckets of its keys. A batch changes some keys; for these,
and only these, the operator's batch plan is run again over the rows held, and what differs from the results held before
goes on to the next operator as changes: rows with _op -1 that no longer hold and rows with _op 1 that now do. So results
after any batch are those of the batch plan over all rows that have come, whatever their order, and every
correction is passed through all later operators.

Windows that end (tumbling, hopping) are shown once event time has passed them: with emit "eager" the latest time seen, and
rows that come later correct them; with "final" the watermark, which is the latest time less the source's disorder, and rows
behind it are dropped as late.

A batch costs the rows of its keys; a key with very many rows is run again as a whole, in the time buckets of the batch plan. Files of batch n
are written again by a replay of batch n, so results are exact once.
"""

from __future__ import annotations

import copy
import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.operators.temporal import VALID_TO, validity
from lodestream.plans import dataset as ds
from lodestream.plans.dataset import SEQ, Dataset, Node
from lodestream.runtime import micros, shared_path
from lodestream.streaming.files import exists, read_text, write_text
from lodestream.streaming.runner import stateful_session
from lodestream.streaming.tables import KeyedTable

OP = "_op"


def _q(name: str):
    return F.col(f"`{name}`")


class _Given(Node):
    """A node whose frame is at hand."""

    def __init__(self, schema: Any, df: DataFrame):
        self.schema, self.df = schema, df

    def frame(self, frames):
        return self.df


def _over(node: Node, **inputs: DataFrame) -> DataFrame:
    """One operator's batch plan over frames of its inputs."""
    clone = copy.copy(node)
    if isinstance(node, ds.Aggregate | ds._Top):
        clone.group = copy.copy(node.group)
        clone.group.source = _Given(node.group.source.schema, inputs["source"])
    else:
        for name, df in inputs.items():
            given = _Given(getattr(node, name).schema, df)
            setattr(clone, name, given)
    return clone.frame(None)


def _common(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """df's rows whose keys are (left_semi) or are not (left_anti) among keys; nulls are equal."""
    names = {c: f"_k{i}" for i, c in enumerate(keys.columns)}
    same = reduce(lambda a, b: a & b, [_q(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(keys.withColumnsRenamed(names), same, how)


def _less(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*map(_q, a.columns)))


class Stage:
    """A stateful operator: tables of its input rows by side, and of its results."""

    def __init__(self, run: "Maintained", name: str, node: Node, sides: dict[str, list[str]], out_keys: list[str]):
        self.run, self.node, self.sides, self.out_keys = run, node, sides, out_keys
        self.held = {side: KeyedTable(run.spark, f"{run.work_dir}/{name}-{side}", keys, run.buckets) for side, keys in sides.items()}
        self.made = KeyedTable(run.spark, f"{run.work_dir}/{name}-out", out_keys, run.buckets)
        window = next((s.window for s in getattr(node, "specs", []) if isinstance(s.window, t.Tumbling | t.Hopping)), None)
        self.lookback = None if window is None else window.lookback_us
        if window is None and isinstance(node, ds.Aggregate) and isinstance(node.group.window, t.Tumbling | t.Hopping):
            self.lookback = node.group.window.lookback_us

    def frontier(self, latest: int | None) -> int:
        behind = self.run.disorder_us if getattr(self.node, "emit", "eager") == "final" else 0
        return -(2**62) if latest is None else latest - behind - self.lookback

    def plan(self, rows: dict[str, DataFrame]) -> DataFrame:
        if isinstance(self.node, Dataset):  # a keyed input: the history of its upserts
            made = validity(rows["source"], list(self.node.schema.keys), self.node.schema.ts, [SEQ])
            return made.where("NOT coalesce(_deleted, false)").drop("_deleted") if "_deleted" in made.columns else made
        if self.lookback is not None:
            self.node = copy.copy(self.node)
            self.node.until_us = 2**62  # all windows; shown() leaves those that are over
        out = _over(self.node, **rows)
        return out if SEQ in out.columns else out.withColumn(SEQ, F.lit(0).cast("bigint"))

    def shown(self, df: DataFrame, latest: int | None) -> DataFrame:
        if self.lookback is None:
            return df
        limit = F.lit(self.frontier(latest))
        ended = F.when(micros(df, VALID_TO) <= limit, _q(VALID_TO)) if VALID_TO in df.columns else None
        df = df.where(micros(df, self.node.schema.ts) <= limit)
        return df.withColumn(VALID_TO, ended) if ended is not None else df

    def advance(self, came: dict[str, DataFrame | None], version: int) -> DataFrame | None:
        """Changes of the results that changes of the inputs make."""
        run, keys = self.run, []
        for side, changes in came.items():
            if changes is None:
                continue
            if getattr(self.node, "emit", "eager") == "final" and run.before is not None:
                changes = changes.where(micros(changes, self.node.group.source.schema.ts) >= F.lit(run.before - run.disorder_us))
            keys.append(changes.select(*(_q(k).alias(o) for k, o in zip(self.sides[side], self.out_keys, strict=True))).distinct())
            rows = [c for c in changes.columns if c != OP]
            plus, minus = changes.where(f"{OP} = 1").select(*map(_q, rows)), changes.where(f"{OP} = -1").select(*map(_q, rows))

            def folded(old: DataFrame | None, _: DataFrame, plus=plus, minus=minus, rows=rows) -> DataFrame:
                whole = plus if old is None else old.select(*map(_q, rows)).unionByName(plus)
                return _less(whole, minus)

            self.held[side].merge(changes.drop(OP), version, folded)
        if not keys:
            touched = None
        else:
            touched = run.kept(reduce(lambda a, b: a.unionByName(b), keys).distinct())
        session = run.session
        tables = {side: self._current(self.held[side], version if came.get(side) is not None else None, session) for side in self.sides}
        before = self._current(self.made, None, session)
        if touched is not None and all(x is not None for x in tables.values()):
            names = {side: dict(zip(self.out_keys, ks, strict=True)) for side, ks in self.sides.items()}
            inputs = {side: _common(df, touched.select(*(_q(o).alias(names[side][o]) for o in self.out_keys)), "left_semi") for side, df in tables.items()}
            fresh = run.kept(self.plan(inputs))
            old = None if before is None else before.select(*map(_q, fresh.columns))
            self.made.merge(touched, version, lambda was, _: fresh if was is None else _common(was.select(*map(_q, fresh.columns)), touched, "left_anti").unionByName(fresh))
        elif before is not None:
            fresh, old, touched = before.limit(0), before, touched if touched is not None else before.select(*map(_q, self.out_keys)).limit(0)
        else:
            return None
        if self.lookback is not None and old is not None:  # windows of other keys that are over by now
            now = self._current(self.made, None, session).select(*map(_q, fresh.columns))
            at = micros(now, self.node.schema.ts)
            due = now.where((at > F.lit(self.frontier(run.before))) & (at <= F.lit(self.frontier(run.latest)))).select(*map(_q, self.out_keys))
            touched = touched.unionByName(due).distinct()
            fresh = _common(now, touched, "left_semi")
        seen = self.shown(fresh, run.latest)
        if old is None:
            return seen.withColumn(OP, F.lit(1))
        gone = self.shown(_common(old, touched, "left_semi"), run.before)
        return run.kept(_less(seen, gone).withColumn(OP, F.lit(1)).unionByName(_less(gone, seen).withColumn(OP, F.lit(-1))))

    @staticmethod
    def _current(table: KeyedTable, version: int | None, session: SparkSession) -> DataFrame | None:
        version = table.last() if version is None else version
        return None if version is None else table.rows(version, session=session)


class Maintained:
    """A dataset kept up to date from streams of the datasets it comes from."""

    def __init__(self, spark: SparkSession, d: Dataset, work_dir: str | None = None, env: str | None = None, disorder: str = "14d", buckets: int = 32):
        self.spark, self.dataset, self.env, self.disorder_us, self.buckets = spark, d, env, t.duration_us(disorder), buckets
        self.work_dir = work_dir or shared_path(spark, "maintained")
        self.stages: dict[int, Stage] = {}
        self.inputs: list[Dataset] = []
        self.before: int | None = None
        self.latest: int | None = None
        self._kept: list[DataFrame] = []
        self._find(d)

    def _find(self, node: Node) -> None:
        """Stages of the graph, numbered from the inputs on."""
        if id(node) in self.stages or (isinstance(node, Dataset) and node in self.inputs):
            return
        if isinstance(node, Dataset):
            p = node.pipeline_for(self.env)
            if p is not None:
                return self._find(p.node)
            self.inputs.append(node)
            if node.schema.keyed:
                self._stage(node, {"source": list(node.schema.keys)}, list(node.schema.keys))
            return
        for below in node.inputs():
            self._find(below)
        if isinstance(node, ds.Aggregate):
            self._stage(node, {"source": node.group.keys}, node.group.keys)
        elif isinstance(node, ds._Top):
            self._stage(node, {"source": node.group.keys}, node.group.keys)
        elif isinstance(node, ds.Dedup):
            self._stage(node, {"source": node.by}, node.by)
        elif isinstance(node, ds.Join):
            self._stage(node, {"left": [a for a, _ in node.pairs], "right": [b for _, b in node.pairs]}, [a for a, _ in node.pairs])

    def _stage(self, node: Node, sides: dict[str, list[str]], out_keys: list[str]) -> None:
        self.stages[id(node)] = Stage(self, f"stage{len(self.stages)}", node, sides, out_keys)

    def kept(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return self._kept[-1]

    def _changes(self, node: Node, came: dict[Dataset, DataFrame], version: int, done: dict[int, DataFrame | None]) -> DataFrame | None:
        if id(node) in done:
            return done[id(node)]
        stage, below = self.stages.get(id(node)), None
        if isinstance(node, Dataset):
            p = node.pipeline_for(self.env)
            below = self._changes(p.node, came, version, done) if p is not None else came.get(node)
            out = stage.advance({"source": below}, version) if stage else below
        elif isinstance(node, ds.Join):
            out = stage.advance({side: self._changes(getattr(node, side), came, version, done) for side in ("left", "right")}, version)
        elif isinstance(node, ds.Union):
            both = [x for x in (self._changes(node.left, came, version, done), self._changes(node.right, came, version, done)) if x is not None]
            out = reduce(lambda a, b: a.unionByName(b), both) if both else None
        else:
            source = node.inputs()[0]
            below = self._changes(source, came, version, done)
            if stage:
                out = stage.advance({"source": below}, version)
            else:
                parts = [] if below is None else [_over(node, source=below.where(f"{OP} = {sign}").drop(OP)).withColumn(OP, F.lit(sign)) for sign in (1, -1)]
                out = parts[0].unionByName(parts[1]) if parts else None
        done[id(node)] = out
        return out

    # -- state between batches: the latest time and the next number of arrival ---------------------------------------

    def _state(self, version: int) -> dict:
        name = f"{self.work_dir}/state-{version}.json"
        return json.loads(read_text(self.spark, name)) if version >= 0 and exists(self.spark, name) else {"latest": None, "seq": 0}

    def batch(self, tagged: DataFrame, version: int) -> None:
        self.session = tagged.sparkSession
        state = self._state(version - 1)
        tagged = self.kept(tagged.withColumn(SEQ, F.lit(state["seq"]).cast("bigint") + F.monotonically_increasing_id()))
        times = [micros(tagged.select(f"_i{k}.*"), d.schema.ts) for k, d in enumerate(self.inputs)]
        at = [tagged.select(f"_i{k}.*").agg(F.max(c).alias("at")) for k, c in enumerate(times)]
        found = [r.at for r in reduce(lambda a, b: a.unionByName(b), at).collect() if r.at is not None]
        last = tagged.agg(F.max(SEQ)).first()[0]
        self.before = state["latest"]
        self.latest = max([*found, *([self.before] if self.before is not None else [])], default=None)
        came = {}
        for k, d in enumerate(self.inputs):
            names = tagged.schema[f"_i{k}"].dataType.names
            order = [] if SEQ in names else [SEQ]
            came[d] = tagged.where(f"_which = {k}").select(*order, f"_i{k}.*").withColumn(OP, F.lit(1))
        out = self._changes(self.dataset, came, version, {})
        if out is not None:
            out.write.mode("overwrite").parquet(f"{self.work_dir}/changes/version={version}")
        seq = state["seq"] if last is None else ((last >> 33) + 1) << 33
        write_text(self.spark, f"{self.work_dir}/state-{version}.json", json.dumps({"latest": self.latest, "seq": seq}))
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def run(self, streams: dict[Dataset, DataFrame]) -> "Maintained":
        """Bring the results up to date with all that has come; streams are of the datasets without pipelines."""
        parts = []
        for k, d in enumerate(self.inputs):
            df = streams[d]
            parts.append(df.select(F.lit(k).alias("_which"), F.struct(*map(_q, df.columns)).alias(f"_i{k}")))
        tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        tagged.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.work_dir}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self

    # -- results ---------------------------------------------------------------------------------------------------

    def changes(self) -> DataFrame | None:
        """All changes so far with _op and version, as change records for who follows the dataset."""
        path = f"{self.work_dir}/changes"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def table(self) -> DataFrame | None:
        """The rows as they stand: what was put in and not taken back."""
        found = self.changes()
        if found is None:
            return None
        rows = [c for c in found.columns if c not in (OP, "version")]
        return _less(found.where(f"{OP} = 1").select(*map(_q, rows)), found.where(f"{OP} = -1").select(*map(_q, rows)))


def maintain(spark: SparkSession, d: Dataset, streams: dict[Dataset, DataFrame], work_dir: str | None = None, env: str | None = None, disorder: str | None = None, buckets: int = 32) -> Maintained:
    """d as of all that has come over streams of its inputs. disorder: that of the inputs' sources (the longest) unless given."""
    if disorder is None:
        known = [s.disorder for x in streams for s in x.sources]
        disorder = max(known, key=t.duration_us) if known else "14d"
    return Maintained(spark, d, work_dir, env, disorder, buckets).run(streams)


def stream_session(spark: SparkSession) -> SparkSession:
    return stateful_session(spark)
