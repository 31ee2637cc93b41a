"""Connectors: where rows come from and go to, as configurations of Spark readers and writers.

A connector names a system, and its tables, topics or folders are what a source or sink is attached to. Files, JDBC
and Kafka read through Spark's own formats; the rest needs an external connector on the class path, which `read`
names in its error when it is missing. Webhooks are filled by the workspace's log().
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream import types as t
from lodestream.expr.ast import Expr
from lodestream.plans.dataset import Dataset, environments
from lodestream.runtime import time_literal


class ConnectorError(ValueError):
    """A source or sink is configured against the rules."""


@dataclass(frozen=True)
class Secret:
    """A value kept in a secret store, by address; resolved when a reader is configured."""

    arn: str
    role_arn: str | None = None
    path: tuple[str, ...] = ()

    def __getitem__(self, key: str) -> Secret:
        return replace(self, path=(*self.path, key))


def resolve_secret(value: Any, secrets: dict[str, Any]) -> Any:
    if not isinstance(value, Secret):
        return value
    if value.arn not in secrets:
        raise ConnectorError(f"no secret {value.arn}")
    found = secrets[value.arn]
    for key in value.path:
        found = found[key]
    return found


@dataclass(frozen=True)
class Connector:
    """What a source or sink is attached to."""

    system: str
    options: dict[str, Any] = field(default_factory=dict, hash=False)

    #: Spark format to read and write with; None if there is none.
    @property
    def format(self) -> str | None:
        return {"kafka": "kafka", "postgres": "jdbc", "mysql": "jdbc", "redshift": "jdbc", "snowflake": "snowflake", "bigquery": "bigquery", "mongo": "mongodb", "kinesis": "kinesis", "pubsub": "pubsub"}.get(self.system, self.options.get("format"))


# -- systems ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Webhook:
    name: str
    retention: str = "14d"

    def __post_init__(self):
        t.duration_us(self.retention)

    def endpoint(self, name: str) -> Connector:
        return Connector("webhook", {"name": self.name, "endpoint": name})


_FILE_FORMATS = {"csv", "json", "parquet", "hudi", "delta", "orc"}


@dataclass(frozen=True)
class S3:
    """Files in buckets, or below any path that Spark reads."""

    name: str
    access_key: Any = None
    secret_key: Any = None
    role_arn: str | None = None

    def bucket(self, bucket_name: str, prefix: str | None = None, path: str | None = None, format: str = "csv", presorted: bool = False, spread: str | None = None, scheme: str = "s3a://", headers: list[str] | None = None) -> Connector:
        if (prefix is None) == (path is None):
            raise ConnectorError("give one of prefix and path")
        delimiter = ","
        if format.startswith("csv"):
            m = re.fullmatch(r"csv(?:\((?:delimiter=)?(.+)\))?", format)
            if not m:
                raise ConnectorError(f"no format {format!r}")
            format, delimiter = "csv", m[1] or ","
        if headers is not None and format != "csv":
            raise ConnectorError("headers are named for csv files without a line of them")
        if format.lower() not in _FILE_FORMATS:
            raise ConnectorError(f"no format {format!r}; there are {sorted(_FILE_FORMATS)}")
        if path is not None:
            check_path(path)
        if spread is not None:
            t.duration_us(spread)
        if presorted and path is None:
            raise ConnectorError("presorted files need a path")
        return Connector("s3", {"base": f"{scheme}{bucket_name}", "prefix": prefix, "path": path, "format": format.lower(), "delimiter": delimiter, "presorted": presorted, "spread": spread, "headers": headers})


_STRFTIME = set("YymdHMSjf")


def check_path(path: str) -> None:
    """A path is static parts, then * and ** parts or parts with % directives, maybe ending in *.ext."""
    if not path or path.startswith("/"):
        raise ConnectorError("a path is relative")
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part == "":
            raise ConnectorError(f"an empty part in {path!r}")
        if "*" in part and part not in ("*", "**") and not (i == len(parts) - 1 and re.fullmatch(r"\*\.[A-Za-z0-9.]+", part)):
            raise ConnectorError(f"{part!r}: wildcards are whole parts, or *.ext at the end")
        for m in re.finditer(r"%(.?)", part):
            if m[1] not in _STRFTIME:
                raise ConnectorError(f"no directive %{m[1]} in paths")


def path_globs(path: str, since: dt.datetime | None, until: dt.datetime | None, spread: str | None = None) -> list[str]:
    """The globs of a path: with directives and both bounds, one per period between them, else with wildcards.

    Rows of a folder may lie up to spread before or after its period. Directives finer than a minute are wildcards.
    """
    if "%" not in path:
        return [path]
    if since is None or until is None:
        return [re.sub(r"%.", "*", path)]
    path = re.sub(r"%[Sf]", "*", path)
    step = next((dt.timedelta(**{unit: 1}) for d, unit in (("%M", "minutes"), ("%H", "hours"), ("%d", "days"), ("%j", "days")) if d in path), dt.timedelta(days=28))
    since, until = (x.astimezone(dt.timezone.utc).replace(tzinfo=None) if x.tzinfo else x for x in (since, until))
    margin = step + dt.timedelta(microseconds=t.duration_us(spread) if spread else 0)
    found: dict[str, None] = {}
    at = since - margin
    while at <= until + margin:
        found[at.strftime(path)] = None
        at += step
    return list(found)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the globs that match something; Spark fails for the others. All, if none does."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(paths[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    return [p for p in paths if len(system.globStatus(hadoop(p)) or [])] or paths


@dataclass(frozen=True)
class Avro:
    registry: str
    url: str
    username: Any = None
    password: Any = None


@dataclass(frozen=True)
class Protobuf:
    registry: str
    url: str
    username: Any = None
    password: Any = None
    token: Any = None

    def __post_init__(self):
        if (self.username is None) == (self.token is None):
            raise ConnectorError("give username and password, or token")


@dataclass(frozen=True)
class Kafka:
    name: str
    bootstrap_servers: str
    security_protocol: str = "PLAINTEXT"
    sasl_mechanism: str | None = None
    sasl_plain_username: Any = None
    sasl_plain_password: Any = None

    def topic(self, topic: str, format: Any = "json") -> Connector:
        if not isinstance(format, (Avro, Protobuf)) and format != "json":
            raise ConnectorError("a topic is json, Avro or Protobuf")
        options = {"kafka.bootstrap.servers": self.bootstrap_servers, "kafka.security.protocol": self.security_protocol}
        if self.sasl_mechanism:
            options["kafka.sasl.mechanism"] = self.sasl_mechanism
        return Connector("kafka", {"topic": topic, "encoding": format, "reader": options})


@dataclass(frozen=True)
class Kinesis:
    name: str
    role_arn: str

    def stream(self, stream_arn: str, init_position: Any = "latest", format: str = "json") -> Connector:
        if format != "json":
            raise ConnectorError("a stream is json")
        if isinstance(init_position, str) and init_position not in ("latest", "trim_horizon"):
            raise ConnectorError("init_position is latest, trim_horizon or a time")
        return Connector("kinesis", {"stream_arn": stream_arn, "init_position": init_position, "encoding": "json"})


@dataclass(frozen=True)
class PubSub:
    name: str
    project_id: str
    credentials: Any = None

    def topic(self, topic_id: str, format: str = "json") -> Connector:
        if format != "json":
            raise ConnectorError("a topic is json")
        return Connector("pubsub", {"topic_id": topic_id, "encoding": "json"})


@dataclass(frozen=True)
class Partitions:
    """A database's table read in parallel: count stretches of a number, date or time column between two bounds. Rows outside of the
    bounds are read too, with the first and the last stretch."""

    column: str
    low: Any
    high: Any
    count: int

    def options(self) -> dict[str, str]:
        return {"partitionColumn": self.column, "lowerBound": str(self.low), "upperBound": str(self.high), "numPartitions": str(self.count)}


@dataclass(frozen=True)
class _Tables:
    name: str
    host: str = ""
    db_name: str = ""
    username: Any = None
    password: Any = None
    port: int | None = None
    jdbc_params: str | None = None

    system = ""
    scheme = ""
    default_port = 0

    def table(self, table_name: str, cursor: str | None = None, partitions: Partitions | None = None) -> Connector:
        """A table; partitions tells how to read it in parallel (a table without is read by one task)."""
        url = f"jdbc:{self.scheme}://{self.host}:{self.port or self.default_port}/{self.db_name}" + (f"?{self.jdbc_params}" if self.jdbc_params else "")
        return Connector(self.system, {"table": table_name, "cursor": cursor, "partitions": partitions, "reader": {"url": url, "user": self.username, "password": self.password}})


class Postgres(_Tables):
    system, scheme, default_port = "postgres", "postgresql", 5432


class MySQL(_Tables):
    system, scheme, default_port = "mysql", "mysql", 3306


@dataclass(frozen=True)
class Redshift(_Tables):
    s3_access_role_arn: str | None = None

    def __post_init__(self):
        if (self.s3_access_role_arn is None) == (self.username is None):
            raise ConnectorError("give s3_access_role_arn, or username and password")

    system, scheme, default_port = "redshift", "redshift", 5439


@dataclass(frozen=True)
class Snowflake:
    name: str
    account: str
    warehouse: str
    db_name: str
    schema: str
    role: str
    username: Any = None
    password: Any = None

    def table(self, table_name: str, cursor: str | None = None) -> Connector:
        reader = {"sfURL": f"{self.account}.snowflakecomputing.com", "sfWarehouse": self.warehouse, "sfDatabase": self.db_name, "sfSchema": self.schema, "sfRole": self.role}
        return Connector("snowflake", {"table": table_name, "cursor": cursor, "reader": {**reader, "sfUser": self.username, "sfPassword": self.password}})


@dataclass(frozen=True)
class BigQuery:
    name: str
    project_id: str
    dataset_id: str
    service_account_key: Any = None

    def table(self, table_name: str, cursor: str | None = None) -> Connector:
        return Connector("bigquery", {"table": f"{self.project_id}.{self.dataset_id}.{table_name}", "cursor": cursor, "reader": {}})


@dataclass(frozen=True)
class Mongo:
    name: str
    host: str
    db_name: str
    username: Any = None
    password: Any = None

    def collection(self, collection_name: str, cursor: str | None = None) -> Connector:
        return Connector("mongo", {"table": collection_name, "cursor": cursor, "reader": {"connection.uri": f"mongodb://{self.host}/{self.db_name}"}})


@dataclass(frozen=True)
class HTTP:
    name: str
    host: str
    healthz: str = ""
    ca_cert: Any = None

    def path(self, endpoint: str, limit: int | None = None, headers: dict[str, str] | None = None) -> Connector:
        return Connector("http", {"host": self.host, "endpoint": endpoint, "limit": limit, "headers": headers or {}})


@dataclass(frozen=True)
class Files:
    """A folder of parquet, csv, json or orc files, batch or stream."""

    path: str
    format: str = "parquet"

    def __call__(self) -> Connector:
        return Connector("files", {"path": self.path, "format": self.format})


# -- sources ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RefPath:
    path: str


def ref(path: str) -> RefPath:
    """Another field of the raw row, nested ones as a[b][c]."""
    if not re.fullmatch(r"[^\[\].]+(\[[^\[\]]+\])*", path):
        raise ConnectorError(f"{path!r} is no reference")
    return RefPath(path)


@dataclass(frozen=True)
class Eval:
    body: Any
    schema: dict[str, Any] | None = None


def eval_(body: Expr | Callable, schema: dict[str, Any] | None = None) -> Eval:
    """A value computed from the raw row, with the types of the raw fields it needs."""
    return Eval(body, schema)


@dataclass(frozen=True)
class Sample:
    rate: float
    using: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 <= self.rate <= 1:
            raise ConnectorError("a sample rate is between 0 and 1")


@dataclass
class Source:
    conn: Connector
    disorder: str
    cdc: str
    every: str | None = None
    since: dt.datetime | None = None
    until: dt.datetime | None = None
    env: tuple[str, ...] | None = None
    preproc: dict[str, Any] = field(default_factory=dict)
    bounded: bool = False
    idleness: str | None = None
    where: Any = None
    sample: Sample | None = None


_CDC = ("append", "upsert", "debezium", "native")


def source(conn: Connector, disorder: str, cdc: str, every: str | None = None, since=None, until=None, env=None, preproc=None, bounded: bool = False, idleness: str | None = None, where=None, sample=None) -> Callable:
    """Decorator that attaches a source to a dataset; several may be stacked."""
    if not isinstance(conn, Connector):
        raise ConnectorError("a source is attached to a table, topic, bucket or endpoint")
    if conn.system == "http":
        raise ConnectorError("there are no sources over HTTP")
    t.duration_us(disorder)
    if cdc not in _CDC:
        raise ConnectorError(f"cdc is one of {_CDC}")
    if conn.options.get("format") == "delta" and cdc != "native" or cdc == "native" and conn.options.get("format") not in ("delta", "hudi"):
        raise ConnectorError("delta and only table formats have native change data")
    if every is not None:
        t.duration_us(every)
    if since is not None and until is not None and since >= until:
        raise ConnectorError("since is before until")
    if bounded != (idleness is not None):
        raise ConnectorError("bounded sources and only they have an idleness")
    if idleness is not None:
        t.duration_us(idleness)
    for name, p in (preproc or {}).items():
        if isinstance(p, RefPath) and "[" in p.path and conn.system in ("s3", "files") and conn.options.get("format") not in ("json", "parquet"):
            raise ConnectorError(f"{name}: nested references need nested rows")
    if sample is not None:
        sample = sample if isinstance(sample, Sample) else Sample(float(sample))
        if any(u in (preproc or {}) for u in sample.using):
            raise ConnectorError("a sample can't use columns made by preproc")

    made = Source(conn, disorder, cdc, every, since, until, environments(env), dict(preproc or {}), bounded, idleness, where, sample)

    def attach(x: Any) -> Any:
        if isinstance(x, Dataset):
            check_source(x, made)
            x.sources.append(made)
        else:
            x.__sources__ = [*getattr(x, "__sources__", []), made]
        return x

    return attach


def check_source(d: Dataset, s: Source) -> None:
    if d.pipelines:
        raise ConnectorError(f"{d._name} comes from a pipeline and takes no source")
    if s.cdc == "append" and d.schema.keyed:
        raise ConnectorError(f"cdc append is for data without keys; {d._name} is keyed")
    if s.cdc in ("upsert", "debezium") and not d.schema.keyed:
        raise ConnectorError(f"cdc {s.cdc} is for keyed data; {d._name} has no keys")
    for name in s.preproc:
        if name not in d.schema.fields:
            raise ConnectorError(f"preproc makes {name}, which is no field of {d._name}")


def sample_columns(s: Source, d: Dataset) -> list[str]:
    """What a sample hashes: its columns, else the keys, else all fields that preproc does not make."""
    if s.sample.using:
        return list(s.sample.using)
    names = list(d.schema.keys) or list(d.schema.fields)
    return [n for n in names if n not in s.preproc] or list(d.schema.fields)


# -- the way in ------------------------------------------------------------------------------------------------


def apply_preproc(df: DataFrame, s: Source) -> DataFrame:
    """Columns by constants, references and expressions over the raw row, all at once."""
    made = {}
    for name, p in s.preproc.items():
        if isinstance(p, RefPath):
            first, *rest = re.findall(r"[^\[\]]+", p.path)
            c = F.col(f"`{first}`")
            for part in rest:
                c = c[part]
            made[name] = c
        elif isinstance(p, Eval):
            types = {f.name: t.from_spark(f.dataType, f.nullable) for f in df.schema.fields} | {k: t.dtype(v) for k, v in (p.schema or {}).items()}
            if isinstance(p.body, Expr):
                made[name] = p.body.column(types)
        else:
            made[name] = F.lit(p)
    out = df.withColumns(made) if made else df
    for name, p in s.preproc.items():
        if isinstance(p, Eval) and not isinstance(p.body, Expr):
            out = _python_column(out, name, p)
    return out


def _python_column(df: DataFrame, name: str, p: Eval) -> DataFrame:
    kind = t.dtype((p.schema or {}).get(name, str)).spark()
    out = T.StructType([f for f in df.schema.fields if f.name != name]).add(name, kind, True)
    body = p.body

    def over(batches):
        for pdf in batches:
            values = body(pdf.copy())
            pdf[name] = list(values)
            yield pdf[[f.name for f in out.fields]]

    return df.mapInPandas(over, out)


def apply_where(df: DataFrame, s: Source) -> DataFrame:
    """The ingest filter, over the row as preproc leaves it."""
    w = s.where
    if w is None:
        return df
    if isinstance(w, Eval):
        types = {f.name: t.from_spark(f.dataType, f.nullable) for f in df.schema.fields} | {k: t.dtype(v) for k, v in (w.schema or {}).items()}
        w = w.body if not isinstance(w.body, Expr) else w.body.column(types)
    elif isinstance(w, Expr):
        w = w.column({f.name: t.from_spark(f.dataType, f.nullable) for f in df.schema.fields})
    if callable(w):
        body = w

        def over(batches):
            for pdf in batches:
                yield pdf[body(pdf).fillna(False).to_numpy(bool)]

        return df.mapInPandas(over, df.schema)
    return df.where(w)


def conform(df: DataFrame, d: Dataset, on_error: str = "raise") -> DataFrame:
    """df with exactly the fields of the dataset in their types.

    Rows that break a type's rule, or have a null in a field that is not optional, raise; or, with on_error "drop" or
    "keep", are left out, or kept and marked by the column _broken. Values of another kind are not converted, but for
    int to float, whole numbers of any width, zone-less times (taken as UTC) and times to microseconds.
    """
    from lodestream.runtime import utc

    df = utc(df)
    columns, checks = [], []
    for name, kind in d.schema.fields.items():
        if name not in df.columns:
            if not kind.optional:
                raise ConnectorError(f"{d._name} needs the field {name}")
            columns.append(F.lit(None).cast(kind.spark()).alias(name))
            continue
        have = df.schema[name].dataType
        if not _fits(have, t.required(kind).spark()):
            raise ConnectorError(f"{d._name}.{name} is {kind}, not {have.simpleString()}")
        c = F.col(f"`{name}`").cast(kind.spark())
        columns.append(c.alias(name))
        value = F.col(f"`{name}`")
        rule = t.required(kind).constraint(value.cast(kind.spark()))
        if not kind.optional:
            checks.append((name, value.isNull()))
        if rule is not None:
            checks.append((name, value.isNotNull() & ~rule))
    out = df.select(*columns)
    if not checks:
        return out if on_error != "keep" else out.withColumn("_broken", F.lit(None).cast("string"))
    broken = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks))
    if on_error == "raise":
        first = next(iter(d.schema.fields))
        checked = F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit(f"{d._name}: a value breaks the type of "), broken))).otherwise(F.lit(None).cast("string"))
        kind = d.schema.fields[first].spark()
        return out.withColumn(first, F.when(checked.isNull(), F.col(f"`{first}`")).otherwise(F.lit(None).cast(kind)))
    marked = out.withColumn("_broken", broken)
    return marked.where("_broken IS NULL").drop("_broken") if on_error == "drop" else marked


def _fits(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(have, T.NullType):
        return True
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if isinstance(want, T.LongType):
        return isinstance(have, whole)
    if isinstance(want, T.DoubleType):
        return isinstance(have, (*whole, T.DoubleType, T.FloatType))
    if isinstance(want, T.DecimalType):
        return isinstance(have, (T.DecimalType, *whole))
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and _fits(have.elementType, want.elementType)
    if isinstance(want, T.MapType):
        return isinstance(have, T.MapType) and _fits(have.valueType, want.valueType)
    if isinstance(want, T.StructType):
        return isinstance(have, T.StructType) and all(f.name in have.names and _fits(have[f.name].dataType, f.dataType) for f in want.fields)
    return type(have) is type(want)


def debezium_rows(df: DataFrame, d: Dataset) -> DataFrame:
    """Rows of change records (before, after, op, ts_ms): the row after, or before for a delete, and _deleted."""
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    out = df.select(row.alias("_row"), (F.col("op") == "d").alias("_deleted"), F.timestamp_millis("ts_ms").alias("_changed"))
    fields = [f.name for f in out.schema["_row"].dataType.fields]
    ts = d.schema.ts
    return out.select(*(F.col(f"_row.`{n}`").alias(n) for n in fields if n != ts), F.when(F.col("_deleted"), F.col("_changed")).otherwise(F.col(f"_row.`{ts}`") if ts in fields else F.col("_changed")).alias(ts), "_deleted")


def read(spark: SparkSession, d: Dataset, s: Source, stream: bool = False, secrets: dict[str, Any] | None = None, since_cursor: Any = None) -> DataFrame:
    """The raw rows of a source, with predicates it can push down."""
    o = s.conn.options
    if s.conn.system == "files":
        reader = (spark.readStream.schema(spark.read.format(o["format"]).load(o["path"]).schema) if stream else spark.read).format(o["format"])
        if o["format"] == "csv":
            reader = reader.option("header", "true").schema(raw_schema(d, s))
        return reader.load(o["path"])
    if s.conn.system == "s3":
        if o["format"] in ("delta", "hudi"):
            return (spark.readStream if stream else spark.read).format(o["format"]).load(f"{o['base']}/{o['prefix'] or o['path']}")
        limits = (None, None) if stream else (s.since, s.until)  # a stream takes one path: all folders, and bounds() leaves the rows between
        paths = [f"{o['base']}/{p}" for p in (path_globs(o["path"], *limits, o["spread"]) if o["path"] else [o["prefix"]])]
        reader = (spark.readStream if stream else spark.read).format(o["format"]).schema(raw_schema(d, s, o.get("headers")))
        if o["format"] == "csv":
            reader = reader.option("header", str(o.get("headers") is None).lower()).option("sep", o["delimiter"]).option("enforceSchema", str(o.get("headers") is not None).lower())
        return reader.load((existing(spark, paths) if len(paths) > 1 else paths) if not stream else paths[0])
    if s.conn.system == "kafka":
        options = {"subscribe": o["topic"], **o["reader"]}
        raw = (spark.readStream if stream else spark.read).format("kafka").options(**{k: resolve_secret(v, secrets or {}) for k, v in options.items()}).load()
        return decode_messages(raw, d, o["encoding"], raw_schema(d, s))
    if s.conn.format is None or s.conn.system == "webhook":
        raise ConnectorError(f"{s.conn.system} is filled by log(), not read")
    reader = spark.read.format(s.conn.format).options(**{k: str(resolve_secret(v, secrets or {})) for k, v in o.get("reader", {}).items() if v is not None})
    if s.conn.format == "jdbc":
        asked = cursor_query(o["table"], o.get("cursor"), since_cursor, s.disorder)
        if o.get("partitions") is not None:  # which Spark takes with a table only, be it a query in brackets
            return reader.option("dbtable", f"({asked}) asked").options(**o["partitions"].options()).load()
        return reader.option("query", asked).load()
    rows = reader.option("dbtable", o["table"]).load()
    if o.get("cursor") and since_cursor is not None:
        if isinstance(since_cursor, dt.datetime):
            since_cursor = since_cursor - dt.timedelta(microseconds=t.duration_us(s.disorder))
        rows = rows.where(F.col(o["cursor"]) > F.lit(since_cursor))
    return rows


def raw_schema(d: Dataset, s: Source, order: list[str] | None = None) -> T.StructType:
    """What is read of a source's rows: the dataset's fields that preproc does not make, and all that preproc and where ask for.

    A path like a[b][c] asks for a struct with the type of the field it makes; an expression for what its schema says. order: the
    columns of files without names, of which those that nobody asks for are text.
    """
    wanted: dict[str, T.DataType] = {n: k.spark() for n, k in d.schema.fields.items() if n not in s.preproc}

    def asked(name: str, kind: T.DataType) -> None:
        have = wanted.get(name)
        if isinstance(have, T.StructType) and isinstance(kind, T.StructType):
            kind = T.StructType([*have.fields, *(f for f in kind.fields if f.name not in have.names)])
        wanted[name] = kind if have is None or isinstance(kind, T.StructType) else have

    for name, p in s.preproc.items():
        if isinstance(p, RefPath):
            first, *rest = re.findall(r"[^\[\]]+", p.path)
            kind = d.schema.fields[name].spark()
            for part in reversed(rest):
                kind = T.StructType([T.StructField(part, kind)])
            asked(first, kind)
    for p, made in [*((p, ()) for p in s.preproc.values()), (s.where, s.preproc)]:
        if isinstance(p, Eval):
            for name, kind in (p.schema or {}).items():
                if name not in made:
                    asked(name, t.dtype(kind).spark())
    if s.cdc == "debezium":
        row = T.StructType([T.StructField(n, k, True) for n, k in wanted.items()])
        return T.StructType([T.StructField("before", row), T.StructField("after", row), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType())])
    return T.StructType([T.StructField(n, wanted.get(n, T.StringType()), True) for n in (order or wanted)])


def cursor_query(table: str, cursor: str | None, last: Any, disorder: str) -> str:
    """What to ask a database for: rows whose cursor is beyond the last seen, less the disorder."""
    if cursor is None or last is None:
        return f"SELECT * FROM {table}"
    if isinstance(last, dt.datetime):
        last = last - dt.timedelta(microseconds=t.duration_us(disorder))
        return f"SELECT * FROM {table} WHERE {cursor} > '{last.isoformat(sep=' ')}'"
    return f"SELECT * FROM {table} WHERE {cursor} > {last!r}"


def decode_messages(raw: DataFrame, d: Dataset, encoding: Any, schema: T.StructType | None = None) -> DataFrame:
    """The rows in the values of messages; JSON with the schema, or the dataset's."""
    if encoding == "json":
        return raw.select(F.from_json(F.col("value").cast("string"), schema or d.schema.spark()).alias("_v")).select("_v.*")
    from pyspark.sql.avro.functions import from_avro
    from pyspark.sql.protobuf.functions import from_protobuf

    options = {"mode": "FAILFAST"}
    if isinstance(encoding, Avro):
        return raw.select(from_avro(F.col("value"), encoding.url, options).alias("_v")).select("_v.*")
    return raw.select(from_protobuf(F.col("value"), d._name, encoding.url, options).alias("_v")).select("_v.*")


def bounds(df: DataFrame, d: Dataset, s: Source) -> DataFrame:
    """Rows at or after since and before until; a predicate on the column as it is, which file scans can use."""
    ts = d.schema.ts
    if ts not in df.columns or not isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        return df
    for limit, keep in ((s.since, ">="), (s.until, "<")):
        if limit is not None:
            at = limit if limit.tzinfo else limit.replace(tzinfo=dt.timezone.utc)
            value = time_literal(df, ts, (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1))
            df = df.where(F.col(f"`{ts}`") >= value if keep == ">=" else F.col(f"`{ts}`") < value)
    return df


def ingest(df: DataFrame, d: Dataset, s: Source | None, on_error: str = "raise") -> DataFrame:
    """Raw rows on their way into a dataset: preproc, where, sample, types, time bounds."""
    if s is not None:
        if s.cdc == "debezium":
            df = debezium_rows(df, d)
        if d.schema.ts not in s.preproc:
            df = bounds(df, d, s)
        df = apply_where(apply_preproc(df, s), s)
        if s.sample is not None:
            from lodestream.operators.temporal import hash_sample

            df = hash_sample(df, s.sample.rate, sample_columns(s, d))
    deleted = "_deleted" in df.columns
    if deleted:
        flag = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_all"))
        kept = flag.select("_all.*")
        out = conform(kept.where("NOT _deleted"), d, on_error).withColumn("_deleted", F.lit(False))
        gone = kept.where("_deleted").select(*(F.col(f"`{n}`").cast(k.spark()).alias(n) if n in kept.columns else F.lit(None).cast(k.spark()).alias(n) for n, k in d.schema.fields.items()), F.lit(True).alias("_deleted"))
        out = out.unionByName(gone)
    else:
        out = conform(df, d, on_error)
    return bounds(out, d, s) if s is not None else out
