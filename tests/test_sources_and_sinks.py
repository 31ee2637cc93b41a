import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Optional

import pytest
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.expr import col
from lodestream.plans.dataset import dataset, field, inputs, pipeline
from lodestream.runtime import shared_path
from lodestream.sources import connectors as cn
from lodestream.sources import sinks
from lodestream.streaming.runner import run_to_files
from lodestream.workspace import Workspace
from tests.conftest import at

s3, kafka, hook = cn.S3("s"), cn.Kafka("k", "host:9092"), cn.Webhook("w")


@dataset
class Plain:
    id: int
    ts: datetime


@dataset
class Keyed:
    id: int = field(key=True)
    name: Optional[str]
    ts: datetime


@dataset
class Derived:
    id: int
    ts: datetime

    @pipeline
    @inputs(Plain)
    def p(cls, d):
        return d.filter(col("id") > 0)


def test_sources_that_are_refused():
    ok = {"disorder": "1d", "cdc": "append"}
    bad = [
        lambda: cn.source(cn.HTTP("h", "x").path("p"), **ok),
        lambda: cn.source(s3, **ok),
        lambda: cn.source(hook.endpoint("e"), disorder="1x", cdc="append"),
        lambda: cn.source(hook.endpoint("e"), disorder="1d", cdc="some"),
        lambda: cn.source(s3.bucket("b", prefix="p", format="delta"), **ok),
        lambda: cn.source(hook.endpoint("e"), disorder="1d", cdc="native"),
        lambda: cn.source(hook.endpoint("e"), since=datetime(2024, 2, 1), until=datetime(2024, 1, 1), **ok),
        lambda: cn.source(hook.endpoint("e"), bounded=True, **ok),
        lambda: cn.source(hook.endpoint("e"), idleness="1h", **ok),
        lambda: cn.source(hook.endpoint("e"), sample=1.5, **ok),
        lambda: cn.source(hook.endpoint("e"), sample=cn.Sample(0.5, ("a",)), preproc={"a": 1}, **ok),
        lambda: cn.source(s3.bucket("b", prefix="p"), preproc={"a": cn.ref("x[y]")}, **ok),
        lambda: cn.source(hook.endpoint("e"), disorder="1d", cdc="append")(Keyed),
        lambda: cn.source(hook.endpoint("e"), disorder="1d", cdc="upsert")(Plain),
        lambda: cn.source(hook.endpoint("e"), **ok)(Derived),
        lambda: cn.source(hook.endpoint("e"), preproc={"nothing": 1}, **ok)(Plain),
        lambda: cn.ref("a[b"),
        lambda: s3.bucket("b"),
        lambda: s3.bucket("b", prefix="p", path="q"),
        lambda: s3.bucket("b", prefix="p", format="xml"),
        lambda: s3.bucket("b", path="/abs"),
        lambda: s3.bucket("b", path="a*b/c"),
        lambda: s3.bucket("b", path="%Q"),
        lambda: s3.bucket("b", prefix="p", presorted=True),
        lambda: kafka.topic("t", format="csv"),
        lambda: cn.Protobuf("confluent", "u"),
        lambda: cn.Kinesis("k", "r").stream("a", init_position="first"),
        lambda: cn.PubSub("p", "i").topic("t", format="avro"),
        lambda: cn.Redshift("r"),
    ]
    for make in bad:
        with pytest.raises((cn.ConnectorError, ValueError)):
            make()


def test_connectors_as_spark_options():
    o = cn.Postgres("p", "host", "db", "u", "pw").table("t", cursor="c")
    assert o.format == "jdbc" and o.options["reader"]["url"] == "jdbc:postgresql://host:5432/db"
    assert cn.MySQL("m", "host", "db", port=1, jdbc_params="a=b").table("t").options["reader"]["url"] == "jdbc:mysql://host:1/db?a=b"
    assert cn.cursor_query("t", "c", datetime(2024, 1, 2), "1d") == "SELECT * FROM t WHERE c > '2024-01-01 00:00:00'"
    assert cn.cursor_query("t", "c", 5, "1d") == "SELECT * FROM t WHERE c > 5" and cn.cursor_query("t", None, None, "1d") == "SELECT * FROM t"
    days = cn.path_globs("x/%Y/%m/%d/*", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert days == ["x/2023/12/31/*", "x/2024/01/01/*", "x/2024/01/02/*", "x/2024/01/03/*"] and cn.path_globs("x/%Y/*.csv", None, None) == ["x/*/*.csv"]
    assert kafka.topic("t").options["reader"]["kafka.bootstrap.servers"] == "host:9092"
    for c in (cn.Snowflake("s", "a", "w", "d", "s", "r").table("t"), cn.BigQuery("b", "p", "d").table("t"), cn.Mongo("m", "h", "d").collection("c"), cn.Kinesis("k", "r").stream("a")):
        assert c.format


def test_messages_of_a_topic(spark):
    raw = spark.createDataFrame([(bytearray(b'{"id": 1, "ts": "2024-01-01T00:00:00Z"}'),), (bytearray(b"{"),)], "value binary")
    assert [r.id for r in cn.decode_messages(raw, Plain, "json").collect()] == [1, None]


def test_files_by_batch_and_stream(spark):
    path = shared_path(spark, "files")
    spark.createDataFrame([(1, at("2024-01-01")), (2, at("2024-01-02"))], "id bigint, ts timestamp").write.parquet(path)

    @cn.source(cn.Files(path)(), disorder="1d", cdc="append", until=datetime(2024, 1, 2))
    @dataset
    class Filed:
        id: int
        ts: datetime

    w = Workspace(spark)
    w.commit("m", [Filed])
    w.ingest_sources()
    assert [r.id for r in w.frame(Filed).collect()] == [1]
    assert cn.read(spark, Filed, Filed.sources[0], stream=True).isStreaming


def folders(spark, path, rows):
    """Rows (id, time) as parquet files in folders: {folder: rows}."""
    base = shared_path(spark, "dated")
    for folder, inside in rows.items():
        spark.createDataFrame([(i, at(x)) for i, x in inside], "id bigint, ts timestamp").coalesce(1).write.parquet(f"{base}/{folder}")
    return s3.bucket(base, path=path, format="parquet", scheme="")


def test_a_stream_of_dated_folders_reads_all_between_its_bounds(spark):
    days = {"x/2023/12/31": [(0, "2023-12-31")], "x/2024/01/01": [(1, "2024-01-01")], "x/2024/01/03": [(2, "2024-01-03T05:00"), (3, "2024-01-03T23:00")], "x/2024/02/01": [(4, "2024-02-01")]}

    @cn.source(folders(spark, "x/%Y/%m/%d/*", days), disorder="1d", cdc="append", since=datetime(2024, 1, 1), until=datetime(2024, 1, 3, 12))
    @dataset
    class Dated:
        id: int
        ts: datetime

    stream = cn.ingest(cn.read(spark, Dated, Dated.sources[0], stream=True), Dated, Dated.sources[0])
    assert sorted(r.id for r in run_to_files(stream, spark, stream.schema).collect()) == [1, 2]


def test_dated_folders_within_the_spread_and_finer_than_a_minute(spark):
    hours = {"x/2023-12-29-10": [(0, "2024-01-01T00:30"), (1, "2023-12-29T10:30")], "x/2024-01-01-00": [(2, "2024-01-01T00:10")], "x/2024-01-03-20": [(3, "2024-01-01T01:30")]}
    seconds = {"x/00-00-07": [(0, "2024-01-01T00:00:07")], "x/00-01-59": [(1, "2024-01-01T00:01:59")], "x/00-05-00": [(2, "2024-01-01T00:05:00")]}
    far = dict(since=datetime(2024, 1, 1), until=datetime(2024, 1, 1, 2), disorder="1d", cdc="append")
    near = {**far, "until": datetime(2024, 1, 1, 0, 2)}
    spread = folders(spark, "x/%Y-%m-%d-%H/*", hours)
    spread.options["spread"] = "3d"
    for conn, how, ids in ((spread, far, [0, 2, 3]), (folders(spark, "x/%H-%M-%S/*", seconds), near, [0, 1])):

        @cn.source(conn, **how)
        @dataset
        class Dated:
            id: int
            ts: datetime

        assert sorted(r.id for r in cn.ingest(cn.read(spark, Dated, Dated.sources[0]), Dated, Dated.sources[0]).collect()) == ids
    zoned = [datetime.fromisoformat(x) for x in ("2024-01-01T05:00+05:00", "2024-01-01T06:00+05:00")]
    assert cn.path_globs("%d-%H", *zoned) == ["31-23", "01-00", "01-01", "01-02"]


def test_change_records_in_and_out(spark):
    row = "struct<id: bigint, name: string, ts: timestamp>"
    a, b = (1, "x", at("2024-01-01")), (1, "y", at("2024-01-02"))
    raw = spark.createDataFrame([(None, a, "c", 0), (a, b, "u", 0), (b, None, "d", 1704326400000)], f"before {row}, after {row}, op string, ts_ms bigint")

    @cn.source(hook.endpoint("e"), disorder="1d", cdc="debezium")
    @dataset
    class Changed:
        id: int = field(key=True)
        name: Optional[str]
        ts: datetime

    w = Workspace(spark)
    w.commit("m", [Changed])
    w.log("w", "e", raw)
    got = [(r.name, r.ts.day, r._valid_to.day) for r in w.frame(Changed).orderBy("ts").collect()]
    assert got == [("x", 1, 2), ("y", 2, 4)]  # the delete ends the last row
    records = [json.loads(r.value) for r in sinks.debezium(w.frame(Changed), Changed).collect()]
    assert sorted((r["op"], r["ts_ms"]) for r in records) == [("c", 1704067200000), ("c", 1704153600000), ("d", 1704153600000), ("d", 1704326400000)]
    assert {r["after"]["name"] for r in records if r["op"] == "c"} == {"x", "y"} and all(r["before"]["id"] == 1 and r["after"] is None for r in records if r["op"] == "d")


def test_how_values_are_encoded(spark):
    from decimal import Decimal

    kinds = {"d": t.Decimal(2), "day": t.Date, "l": t.List(t.Int), "b": t.Bytes}
    df = spark.createDataFrame([(Decimal("-1.50"), datetime(1970, 1, 11).date(), [1, 2], bytearray(b"hi"))], "d decimal(28,2), day date, l array<bigint>, b binary")
    row = df.select(*(sinks.encoded(F.col(n), k).alias(n) for n, k in kinds.items())).collect()[0]
    import base64

    assert int.from_bytes(base64.b64decode(row.d), "big", signed=True) == -150 and (row.day, row.l, row.b) == (10, "[1,2]", "aGk=")


def test_types_on_the_way_in(spark):
    @dataset
    class Strict:
        id: t.between(int, 0, 10, strict_max=True)
        code: t.regex("^[a-z]+$")
        kind: Optional[t.oneof(str, ["p", "q"])]
        vec: t.Embedding(2)
        ts: datetime

    rows = [(1, "ab", None, [1.0, 2.0]), (10, "ab", "p", [1.0, 2.0]), (1, "AB", "p", [1.0, 2.0]), (1, "ab", "z", [1.0, 2.0]), (1, "ab", "q", [1.0]), (None, "ab", "p", [1.0, 2.0]), (0, "z", "q", [0.0, None])]
    df = spark.createDataFrame([(*r, at("2024-01-01")) for r in rows], "id bigint, code string, kind string, vec array<double>, ts timestamp")
    assert [(r.id, r._broken) for r in cn.conform(df, Strict, "keep").collect()] == [(1, None), (10, "id"), (1, "code"), (1, "kind"), (1, "vec"), (None, "id"), (0, "vec")]
    assert cn.conform(df, Strict, "drop").count() == 1
    with pytest.raises(Exception, match="breaks the type"):
        cn.conform(df, Strict).collect()
    for wrong in (df.drop("code"), df.withColumn("id", F.lit("1")), df.withColumn("ts", F.lit(5))):
        with pytest.raises(cn.ConnectorError):
            cn.conform(wrong, Strict)


def test_sinks(spark):
    assert sinks.sink(kafka.topic("t"), cdc="debezium")(Derived) is Derived
    for make in (
        lambda: sinks.sink(kafka.topic("t"))(Derived),
        lambda: sinks.sink(kafka.topic("t"), cdc="debezium", how="incremental"),
        lambda: sinks.sink(hook.endpoint("e"), cdc="debezium"),
        lambda: sinks.sink(s3.bucket("b", prefix="p", format="csv"), how="incremental"),
        lambda: sinks.sink(s3.bucket("b", prefix="p", format="delta"), how="recreate"),
        lambda: sinks.sink(cn.Snowflake("s", "a", "w", "d", "s", "r").table("t"), how="recreate"),
        lambda: sinks.sink(cn.HTTP("h", "x").path("p"), how="incremental"),
        lambda: sinks.sink(kafka.topic("t"), cdc="debezium")(Plain),
        lambda: sinks.SnapshotData("m", 0),
    ):
        with pytest.raises(cn.ConnectorError):
            make()


def test_files_out_appended_recreated_and_in_versions(spark):
    path = shared_path(spark, "out")
    df = spark.createDataFrame([(1, at("2024-01-01")), (2, at("2024-02-01"))], "id bigint, ts timestamp")
    out = cn.Files(path)()
    sinks.write(df, Plain, sinks.Sink(out, how="incremental", renames={"id": "key"}))
    sinks.write(df, Plain, sinks.Sink(out, how="incremental", renames={"id": "key"}, since=datetime(2024, 1, 15)))
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == [1, 2, 2]
    sinks.write(df, Plain, sinks.Sink(out, how="recreate"))
    assert spark.read.parquet(path).count() == 2
    versions = cn.Files(shared_path(spark, "versions"))()
    for _ in range(3):
        sinks.write(df, Plain, sinks.Sink(versions, how=sinks.SnapshotData("_DONE", 2)))
    import os

    assert sorted(x for x in os.listdir(versions.options["path"])) == ["version=1", "version=2"] and os.path.exists(f"{versions.options['path']}/version=2/_DONE")


def test_posting(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(i, at("2024-01-01")) for i in range(5)], "id bigint, ts timestamp").coalesce(1)
    conn = cn.HTTP("h", f"http://127.0.0.1:{server.server_port}").path("in", limit=2)
    sinks.write(df, Plain, sinks.Sink(conn, cdc="debezium"))
    server.shutdown()
    assert [len(b) for b in got] == [2, 2, 1] and sorted(r["after"]["id"] for b in got for r in b) == [0, 1, 2, 3, 4]


def test_time_bounds_reach_the_scan(spark):
    path = shared_path(spark, "bounded")
    spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id)) AS ts FROM range(10)").write.parquet(path)
    s = cn.Source(hook.endpoint("e"), "1d", "append", since=datetime(2024, 1, 3), until=datetime(2024, 1, 5))
    df = cn.ingest(spark.read.parquet(path), Plain, s)
    assert sorted(r.id for r in df.collect()) == [2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03" in plan and "LessThan(ts,2024-01-05" in plan
