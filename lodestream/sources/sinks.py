"""Sinks and the encoding of changes they carry."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream import types as t
from lodestream.operators.temporal import VALID_TO
from lodestream.plans.dataset import Dataset, environments
from lodestream.sources.connectors import Connector, ConnectorError


@dataclass(frozen=True)
class SnapshotData:
    """Each write is a new version beside the last num_retain ones, ended by a marker file."""

    marker: str
    num_retain: int

    def __post_init__(self):
        if self.num_retain < 1:
            raise ConnectorError("num_retain is at least 1")


@dataclass
class Sink:
    conn: Connector
    cdc: str | None = None
    every: str | None = None
    how: Any = None
    renames: dict[str, str] = field(default_factory=dict)
    since: dt.datetime | None = None
    until: dt.datetime | None = None
    env: tuple[str, ...] | None = None


def sink(conn: Connector, cdc: str | None = None, every: str | None = None, how: Any = None, renames: dict[str, str] | None = None, since=None, until=None, env=None) -> Callable:
    """Decorator that attaches a sink to a dataset that comes from a pipeline."""
    if not isinstance(conn, Connector) or conn.system not in ("kafka", "s3", "snowflake", "http", "files"):
        raise ConnectorError("sinks are Kafka, S3, Snowflake, HTTP and files")
    if conn.system == "kafka":
        if cdc != "debezium" or conn.options["encoding"] != "json" or renames or how is not None:
            raise ConnectorError("a Kafka sink has cdc debezium and format json, and neither how nor renames")
    elif conn.system == "http":
        if cdc != "debezium" or how is not None:
            raise ConnectorError("an HTTP sink has cdc debezium and no how")
    elif conn.system == "s3":
        if cdc is not None or conn.options["format"] not in ("delta", "parquet") or how is None:
            raise ConnectorError("an S3 sink has how, a table format and no cdc")
        if how != "incremental" and conn.options["format"] == "delta":
            raise ConnectorError("a delta sink is incremental")
    elif conn.system == "snowflake" and (cdc is not None or how != "incremental"):
        raise ConnectorError("a Snowflake sink is incremental and has no cdc")
    if every is not None:
        t.duration_us(every)
    made = Sink(conn, cdc, every, how, dict(renames or {}), since, until, environments(env))

    def attach(x: Any) -> Any:
        if isinstance(x, Dataset):
            if x.sources or not x.pipelines:
                raise ConnectorError(f"{x._name} is a source dataset and takes no sink")
            x.sinks.append(made)
        else:
            x.__sinks__ = [*getattr(x, "__sinks__", []), made]
        return x

    return attach


def encoded(c: Column, kind: t.DType) -> Column:
    """A value as change records hold it: times in milliseconds, dates in days, decimals as bytes, the rest of the
    nested kinds as JSON text."""
    inner = t.required(kind)
    if inner == t.Datetime:
        return F.unix_millis(c)
    if inner == t.Date:
        return F.unix_date(c)
    if isinstance(inner, t.Decimal):
        # the unscaled value as big-endian two's complement, in base64
        unscaled = (c * F.lit(10**inner.scale).cast("decimal(38,0)")).cast("bigint")
        return F.base64(F.unhex(F.lpad(F.hex(unscaled), 16, "0")))
    if inner == t.Bytes:
        return F.base64(c)
    if isinstance(inner, (t.List, t.Dict, t.Struct, t.Embedding)):
        return F.to_json(c)
    return c


def debezium(df: DataFrame, d: Dataset) -> DataFrame:
    """The dataset's changes as records: key and value, JSON text of (before, after, op, ts_ms).

    Rows appear with op "c"; keyed rows that end disappear with op "d" at the end of their validity.
    """
    fields = d.schema.fields
    row = F.struct(*(encoded(F.col(f"`{n}`"), k).alias(n) for n, k in fields.items()))
    shape = df.select(row.alias("r")).schema["r"].dataType
    none = F.lit(None).cast(shape)
    key = F.to_json(F.struct(*(encoded(F.col(f"`{n}`"), k).alias(n) for n, k in d.schema.keys.items()))) if d.schema.keyed else F.lit(None).cast("string")
    made = F.struct(none.alias("before"), row.alias("after"), F.lit("c").alias("op"), F.unix_millis(F.col(f"`{d.schema.ts}`")).alias("ts_ms"))
    events = [made]
    if VALID_TO in df.columns:
        gone = F.struct(row.alias("before"), none.alias("after"), F.lit("d").alias("op"), F.unix_millis(VALID_TO).alias("ts_ms"))
        events.append(F.when(F.col(VALID_TO).isNotNull(), gone))
    return (
        df.select(key.alias("key"), F.explode(F.array(*events)).alias("_e"))
        .where("_e IS NOT NULL")
        .select("key", F.to_json("_e", {"ignoreNullFields": "false"}).alias("value"))
    )


def write(df: DataFrame, d: Dataset, s: Sink) -> None:
    """Write a batch of the dataset's rows to a sink."""
    o = s.conn.options
    if s.since is not None:
        df = df.where(F.col(d.schema.ts) >= F.lit(s.since))
    if s.until is not None:
        df = df.where(F.col(d.schema.ts) < F.lit(s.until))
    if s.conn.system == "kafka":
        debezium(df, d).write.format("kafka").options(topic=o["topic"], **o["reader"]).save()
        return
    if s.conn.system == "http":
        post(debezium(df, d), f"{o['host']}/{o['endpoint'].lstrip('/')}", o["headers"], o["limit"])
        return
    visible = df.select(*(F.col(f"`{n}`").alias(s.renames.get(n, n)) for n in d.schema.fields))
    if s.conn.system == "snowflake":
        visible.write.format("snowflake").options(dbtable=o["table"], **{k: v for k, v in o["reader"].items() if v is not None}).mode("append").save()
        return
    path = o["path"] if s.conn.system == "files" else f"{o['base']}/{o['prefix'] or o['path']}"
    if isinstance(s.how, SnapshotData):
        snapshot(visible, path, o["format"], s.how)
    else:
        visible.write.format(o["format"]).mode("overwrite" if s.how == "recreate" else "append").save(path)


def snapshot(df: DataFrame, path: str, format: str, how: SnapshotData) -> str:
    """A new version below path, whose marker is written last; older versions than the retained ones go."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    version = max(versions, default=-1) + 1
    df.write.format(format).save(f"{path}/version={version}")
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/{how.marker}")).close()
    for old in sorted([*versions, version])[: -how.num_retain]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
    return f"{path}/version={version}"


def post(records: DataFrame, url: str, headers: dict[str, str], limit: int | None, tries: int = 4, wait: float = 0.5) -> None:
    """Post records in batches of at most limit, from the tasks that hold them.

    A batch that fails (no answer, or one of 429 and 5xx) is sent again, up to so many tries with growing waits; other
    answers fail at once. Each batch has an Idempotency-Key, a digest of its records, so a receiver knows one that comes again, also from a
    task that was run again.
    """
    size = limit or 100

    def send(rows) -> None:
        import hashlib
        import time
        import urllib.error
        import urllib.request

        batch: list[str] = []

        def flush() -> None:
            if not batch:
                return
            body = f"[{', '.join(batch)}]".encode()
            marks = {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest(), **headers}
            for k in range(tries):
                try:
                    urllib.request.urlopen(urllib.request.Request(url, body, marks), timeout=60).close()
                    break
                except urllib.error.HTTPError as e:
                    if k == tries - 1 or (e.code != 429 and e.code < 500):
                        raise
                except urllib.error.URLError:
                    if k == tries - 1:
                        raise
                time.sleep(wait * 2**k)
            batch.clear()

        for row in rows:
            batch.append(row["value"])
            if len(batch) >= size:
                flush()
        flush()

    records.foreachPartition(send)


def json_values(schema: T.StructType) -> T.StructType:
    """The schema of a change record over rows of the given schema."""
    return T.StructType([T.StructField("before", schema), T.StructField("after", schema), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType())])
