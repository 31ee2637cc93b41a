"""The operators over streams.

Stateless operators are the batch plans, run on a streaming frame. Tumbling, hopping and session aggregates are
Spark's windows over a watermark, which is the source's disorder: emitted as they change (eager) or once they are over
(final). What depends on the order of events within a key (continuous windows, stream-table joins) goes through
one stateful operator that holds rows back until the watermark has passed them and then hands them on in order.
Results that change are upserted into a table by key, a version per batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream import types as t
from lodestream.operators.aggregates import SECOND_US, Spec
from lodestream.runtime import micros, shared_path
from lodestream.streaming.entity_features import STATE_CONF
from lodestream.streaming.tables import KeyedTable

#: The end of time, for replays. Event time is taken a century later than it is, since Spark's watermark starts at
#: 1970 and rows before it would be late; times count as no earlier than 1870 and no later than END for the watermark only.
END = "2200-01-01 00:00:00"
END_US = 7_258_118_400_000_000
CENTURY_US = 3_155_760_000_000_000
CLOSING = "_closing"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful queries: state in RocksDB, times in UTC."""
    session = spark.newSession()
    for key, value in STATE_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


class UpsertTable(KeyedTable):
    """A table by key of the rows that came last."""

    def upsert(self, batch: DataFrame, version: int) -> None:
        self.merge(batch, version, lambda old, new: new if old is None else old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new))


def run_to_table(stream: DataFrame, spark: SparkSession, keys: list[str], mode: str = "update", work_dir: str | None = None) -> DataFrame | None:
    """Run a stream over what has arrived, upserting its output by keys; the table, or None if nothing came."""
    work_dir = work_dir or shared_path(spark, "stream")
    out = UpsertTable(spark, f"{work_dir}/table", keys)
    stream.writeStream.outputMode(mode).foreachBatch(out.upsert).option("checkpointLocation", f"{work_dir}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.read()


def run_to_files(stream: DataFrame, spark: SparkSession, schema: Any, work_dir: str | None = None) -> DataFrame:
    """Run a stream over what has arrived, appending its output to files, each row exactly once."""
    work_dir = work_dir or shared_path(spark, "stream")
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{work_dir}/out")
        .option("checkpointLocation", f"{work_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(schema).parquet(f"{work_dir}/out")


def replay(session: SparkSession, rows: DataFrame, ts: str, work_dir: str) -> DataFrame:
    """A stream of a table at rest, ended by a row at the end of time that lets all that waits go.

    The rows come in one micro-batch, so none is late, however they lie. The column _closing tells the last one from them.
    """
    rows = rows.withColumn(CLOSING, F.lit(False))
    end = session.range(1).select(*(F.lit(END).cast("timestamp").alias(f.name) if f.name == ts else F.lit(True if f.name == CLOSING else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    rows.write.parquet(f"{work_dir}/inbox")
    end.coalesce(1).write.mode("append").parquet(f"{work_dir}/inbox")
    return session.readStream.schema(rows.schema).parquet(f"{work_dir}/inbox")


# -- windows ---------------------------------------------------------------------------------------------------


def windowed(stream: DataFrame, keys: list[str], ts: str, window: Any, specs: list[Spec], types: dict[str, t.DType], disorder: str) -> DataFrame:
    """Aggregates per key and tumbling, hopping or session window: keys, begin, end, fields.

    In update mode rows come as they change (eager), in append mode once the watermark has passed them (final).
    """
    us = t.duration_us(disorder)
    if isinstance(window, t.Session):
        w: Column = F.session_window(F.col(ts), f"{window.gap_us} microseconds")
    elif window.us == window.stride_us:
        w = F.window(F.col(ts), f"{window.us} microseconds")
    else:
        w = F.window(F.col(ts), f"{window.us} microseconds", f"{window.stride_us} microseconds")
    at = micros(stream, ts)
    rank = F.struct(at.alias("t"), F.lit(0).alias("o"))
    parts = [[p.alias(f"_p{i}_{j}") for j, p in enumerate(s.parts(F.lit(True), rank))] for i, s in enumerate(specs)]
    grouped = stream.withWatermark(ts, f"{us} microseconds").groupBy(*keys, w.alias("_w")).agg(*(p for ps in parts for p in ps), F.max(at).alias("_last"), F.min(at).alias("_first"))
    session = isinstance(window, t.Session)
    begin = F.col("_first") if session else F.unix_micros("_w.start")
    end = F.col("_last") + 1 if session else F.unix_micros("_w.end")
    out = [
        s.finish([F.col(f"_p{i}_{j}") for j in range(len(parts[i]))], end).cast(t.required(s.result(types.get(s.of))).spark()).alias(s.into_field) for i, s in enumerate(specs)
    ]
    return grouped.select(*keys, F.timestamp_micros(begin).alias("begin"), F.timestamp_micros(end).alias("end"), *out)


def dedup_stream(stream: DataFrame, by: list[str], ts: str, disorder: str) -> DataFrame:
    """The first of rows equal in by and time that come within the disorder."""
    return stream.withWatermark(ts, f"{t.duration_us(disorder)} microseconds").dropDuplicatesWithinWatermark([*by, ts])


# -- in order of event time ------------------------------------------------------------------------------------


def in_event_order(stream: DataFrame, keys: list[str], ts: str, disorder: str, step: Callable[[tuple, pd.DataFrame, Any, int], tuple[pd.DataFrame, Any, int | None]], schema: str) -> DataFrame:
    """Rows of each key handed to step in order of event time, once the watermark has passed them.

    step(key, rows, memory, mark) gives the output, the memory to keep (None for nothing), and the time (µs) at which
    it wants to be called again without rows. Rows are those before mark; memory is None at first.
    """

    def over(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memory = pickle.loads(state.get[0]) if state.exists else (None, None)
        came = [x[~x[CLOSING].astype(bool)] if CLOSING in x else x for x in batches]
        came = [x.assign(**{ts: x[ts].astype("datetime64[us]")}) for x in came]
        parts = [x for x in [held, *came] if x is not None and len(x)]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        now = state.getCurrentWatermarkMs()
        mark = 2**62 if now * 1000 >= END_US else now * 1000 - CENTURY_US
        if len(rows):
            at = rows[ts].astype("datetime64[us]").astype("int64")
            ready = rows[at < mark].sort_values(ts, kind="stable", ignore_index=True)
            held = rows[at >= mark]
        else:
            ready, held = rows, rows
        out, memory, wake = step(key, ready, memory, mark)
        if len(out):
            yield out
        next_at = [int(x) for x in (wake, held[ts].astype("datetime64[us]").astype("int64").min() if len(held) else None) if x is not None]
        if not len(held) and memory is None:
            if state.exists:
                state.remove()
            return
        state.update((pickle.dumps((held if len(held) else None, memory)),))
        if next_at and mark < 2**62:
            state.setTimeoutTimestamp(min(max((min(next_at) + CENTURY_US) // 1000 + 2, now + 1), END_US // 1000 - 10))

    us = F.unix_micros(F.col(ts))
    event_time = F.when(us >= END_US, F.lit(END_US)).otherwise(F.greatest(F.lit(1), F.least(us + CENTURY_US, F.lit(END_US - 1))))
    watermarked = stream.withColumn("_mark", F.timestamp_micros(event_time)).withWatermark("_mark", f"{t.duration_us(disorder)} microseconds")
    watermarked = watermarked.withColumn(ts, F.coalesce(us, F.lit(-(2**63))))  # pandas' nanoseconds, which Spark would give, end in 2262
    return watermarked.groupBy(*keys).applyInPandasWithState(over, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def continuous_stream(stream: DataFrame, key: str, ts: str, of: str, window: t.Continuous, disorder: str) -> DataFrame:
    """Count and sum of a continuous window at each change, as rows come and as they leave: key, at_us, n, total."""
    life = None if window.us is None else window.us + SECOND_US

    def step(who: tuple, rows: pd.DataFrame, memory: Any, mark: int):
        live: list[tuple[int, float]] = memory or []
        moments: dict[int, list[float]] = {}
        if len(rows):
            for at, v in zip(rows[ts].astype("datetime64[us]").astype("int64"), rows[of], strict=True):
                if pd.notna(at):
                    moments.setdefault(at, []).append(v)
        if life is not None:
            for at in {a + life for a, _ in live} | {a + life for a in moments}:
                if at < mark:
                    moments.setdefault(at, [])
        out = []
        for at in sorted(moments):
            live = [x for x in live if life is None or x[0] + life > at] + [(at, v) for v in moments[at]]
            values = [v for _, v in live if v is not None and pd.notna(v)]
            out.append((who[0], at, len(live), float(sum(values))))
        wake = min((a + life for a, _ in live), default=None) if life is not None else None
        return pd.DataFrame(out, columns=["key", "at_us", "n", "total"]), live or None, wake

    kind = stream.schema[key].dataType.simpleString()
    return in_event_order(stream.select(key, ts, of, *(c for c in stream.columns if c == CLOSING)), [key], ts, disorder, step, f"key {kind}, at_us bigint, n bigint, total double")


def asof_stream(left: DataFrame, right: DataFrame, key: str, ts: str, left_id: str, value: str, disorder: str) -> DataFrame:
    """Each left row with the last right value of its key at its time: left_id, value (null if there was none).

    left has key, ts and left_id; right has key, ts and value. At equal times the right row comes first.
    """
    both = left.select(key, ts, F.col(left_id).alias("_id"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(key, ts, F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    return asof_of(both, key, ts, disorder)


def asof_of(both: DataFrame, key: str, ts: str, disorder: str) -> DataFrame:
    """asof_stream over the one stream of both sides (_side 0 right, 1 left)."""

    def step(who: tuple, rows: pd.DataFrame, memory: Any, mark: int):
        last, out = memory, []
        if len(rows):
            for side, i, v in rows.sort_values([ts, "_side"], kind="stable")[["_side", "_id", "_v"]].itertuples(index=False):
                if side == 0:
                    last = (None if pd.isna(v) else v,)
                elif pd.notna(i):
                    out.append((i, last[0] if last else None))
        return pd.DataFrame(out, columns=["left_id", "value"]).astype({"left_id": "int64"} if out else {}), last, None

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return in_event_order(both, [key], ts, disorder, step, f"left_id {kinds['_id']}, value {kinds['_v']}")
