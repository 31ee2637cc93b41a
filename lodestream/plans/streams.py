"""Queries of the operators over streams, compared with the SQL of their batch forms."""

from __future__ import annotations

from datetime import datetime
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.expr import col
from lodestream.operators import aggregates as agg
from lodestream.operators.temporal import VALID_TO
from lodestream.plans.catalog import _PURCHASES, _SESSIONS, DAY, Events, LastPurchase, _live_sql, shown
from lodestream.plans.dataset import SEQ, Dataset, dataset, field, inputs, pipeline
from lodestream.runtime import shared_path, utc
from lodestream.streaming.files import stream_table
from lodestream.streaming.pipelines import Maintained, maintain
from lodestream.streaming.runner import UpsertTable, asof_of, continuous_stream, dedup_stream, replay, run_to_files, run_to_table, stateful_session, windowed
from lodestream.types import Continuous, Hopping, Session, Tumbling


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc(stream_table(stateful_session(spark), f"{sf_dir}/events.parquet")).withColumn(SEQ, F.col("event_id"))


def _windows(spark: SparkSession, sf_dir: str, window) -> DataFrame:
    specs = [agg.Count(into_field="n", window=window), agg.Sum("value", into_field="total", window=window)]
    stream = windowed(_events(spark, sf_dir), ["user_id"], "ts", window, specs, Events.schema.fields, "14d")
    mode = "complete" if isinstance(window, Session) else "update"  # sessions that grow change their window
    out = run_to_table(stream, spark, ["user_id", "begin", "end"], mode)
    return shown(out).withColumn("total", F.round("total", 6))


def stream_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    n = Events.filter(col("value") > 50.0).assign(twice=(col("value") * 2).astype(float)).select("event_id", "twice").rename({"event_id": "id"})
    out = n.frame(lambda _: events)
    return shown(run_to_files(out, spark, out.schema))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, Tumbling("1d"))


def stream_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, Hopping("1d", "6h"))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, Session("6h"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_stream(_events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "14d")
    return shown(run_to_files(out, spark, out.schema))


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, upserted batch by batch."""
    out = UpsertTable(spark, f"{shared_path(spark, 'upsert')}/table", ["user_id"])

    def latest(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return (new if old is None else old.unionByName(new)).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r")).select("user_id", "r.*")

    def batch(df: DataFrame, version: int) -> None:
        out.merge(latest(None, df), version, latest)

    (
        _events(spark, sf_dir)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", shared_path(spark, "upsert-checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return shown(out.read())


def stream_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, work = stateful_session(spark), shared_path(spark, "continuous")
    events = utc(session.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", "ts", "value")
    out = continuous_stream(replay(session, events, "ts", work), "user_id", "ts", "value", Continuous("1d"), "0s")
    rows = run_to_files(out, spark, out.schema, work).where("key IS NOT NULL")
    return rows.select(F.col("key").alias("user_id"), F.col("at_us").alias("ts"), "n", F.round("total", 6).alias("total"))


def stream_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, work = stateful_session(spark), shared_path(spark, "asof")
    events = utc(session.read.parquet(f"{sf_dir}/events.parquet")).where("event_type IN ('click', 'purchase')")
    both = events.select(
        "user_id",
        "ts",
        F.when(F.col("event_type") == "click", F.col("event_id")).alias("_id"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("_v"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("_side"),
    )
    out = asof_of(replay(session, both, "ts", work), "user_id", "ts", "0s")
    return run_to_files(out, spark, out.schema, work).select(F.col("left_id").alias("event_id"), F.col("value").alias("paid"))


# -- pipelines over several micro-batches ----------------------------------------------------------------------


def _maintained(spark: SparkSession, sf_dir: str, d: Dataset, in_time: bool = False, disorder: str = "14d") -> Maintained:
    """d over the events, which come in three files: in order of time, or (in_time False) all mixed."""
    session, inbox = stateful_session(spark), shared_path(spark, "inbox")
    events = utc(session.read.parquet(f"{sf_dir}/events.parquet"))
    if in_time:
        cuts = events.select(F.expr("percentile_approx(unix_micros(ts), array(0.3, 0.6), 10000)")).first()[0]
        part = sum((F.when(F.unix_micros("ts") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    else:
        part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in range(3):
        events.where(part == k).coalesce(1).write.mode("append").parquet(inbox)
    stream = session.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox).withColumn(SEQ, F.col("event_id"))
    return maintain(spark, d, {Events: stream}, disorder=disorder, buckets=8)


@dataset
class DailySpend:
    user_id: int = field(key=True)
    n: int
    total: float
    ts: datetime = field(timestamp=True)

    @pipeline
    @inputs(Events)
    def made(cls, events):
        w = {"window": Tumbling("1d")}
        return events.groupby("user_id").aggregate(n=agg.Count(**w), total=agg.Sum("value", **w), emit="final")


@dataset
class Live:
    user_id: int = field(key=True)
    n: int
    high: float
    kinds: int
    ts: datetime = field(timestamp=True)

    @pipeline
    @inputs(Events)
    def made(cls, events):
        w = {"window": Continuous("1d")}
        return events.groupby("user_id").aggregate(n=agg.Count(**w), high=agg.Max("value", default=-1.0, **w), kinds=agg.Count("event_type", unique=True, approx=True, **w))


@dataset
class LastEvents:
    event_id: int
    ts: datetime = field(timestamp=True)
    user_id: int
    event_type: str
    value: float
    props: str

    @pipeline
    @inputs(Events)
    def made(cls, events):
        return events.dedup("user_id", window=Tumbling("1d"))


@dataset
class PaidClicks:
    event_id: int
    user_id: int
    value: float
    paid: Optional[float]
    purchase_id: Optional[int]
    ts: datetime = field(timestamp=True)

    @pipeline
    @inputs(Events, LastPurchase)
    def made(cls, events, purchases):
        clicks = events.filter(col("event_type") == "click").select("event_id", "user_id", "value")
        return clicks.join(purchases, how="left", on=["user_id"])


@dataset
class LastByUser:
    user_id: int = field(key=True)
    event_type: str
    ts: datetime = field(timestamp=True)

    @pipeline
    @inputs(Events)
    def made(cls, events):
        return events.select("user_id", "event_type").groupby("user_id").latest()


@dataset
class Customers:
    event_type: str = field(key=True)
    n: int
    ts: datetime = field(timestamp=True)

    @pipeline
    @inputs(LastByUser)
    def made(cls, last):
        return last.groupby("event_type").aggregate(n=agg.Count())


def stream_pipeline_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark, two days behind, has passed."""
    return shown(_maintained(spark, sf_dir, DailySpend, True, "2d").table()).drop(VALID_TO).withColumn("total", F.round("total", 6))


def stream_pipeline_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_maintained(spark, sf_dir, Live).table()).drop(VALID_TO)


def stream_pipeline_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_maintained(spark, sf_dir, LastEvents).table())


def stream_pipeline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks joined with purchases, both streaming: a purchase that comes late corrects the clicks after it."""
    return shown(_maintained(spark, sf_dir, PaidClicks).table())


def stream_pipeline_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the kind of their last event: corrections of the history go on into the counts over it."""
    return shown(_maintained(spark, sf_dir, Customers).table()).drop(VALID_TO)


QUERIES = {
    "stream_pipeline_final": stream_pipeline_final,
    "stream_pipeline_continuous": stream_pipeline_continuous,
    "stream_pipeline_dedup": stream_pipeline_dedup,
    "stream_pipeline_join": stream_pipeline_join,
    "stream_pipeline_changes": stream_pipeline_changes,
    "stream_stateless": stream_stateless,
    "stream_tumbling": stream_tumbling,
    "stream_hopping": stream_hopping,
    "stream_session": stream_session,
    "stream_dedup": stream_dedup,
    "stream_upsert": stream_upsert,
    "stream_continuous": stream_continuous,
    "stream_asof_join": stream_asof_join,
}

_Q = 6 * 3_600_000_000
ORACLE_SQL = {
    "stream_pipeline_final": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events), m AS (SELECT max(us) - {2 * DAY} AS m FROM e),
pub AS (SELECT user_id, (us // {DAY}) * {DAY} + {DAY} AS ts, count(*) AS n, round(sum(value), 6) AS total FROM e, m GROUP BY user_id, us // {DAY}),
ended AS (SELECT pub.* FROM pub, m WHERE ts <= m)
SELECT * FROM ended UNION ALL SELECT user_id, ts + {DAY}, 0, 0 FROM ended, m WHERE ts + {DAY} <= m AND (user_id, ts + {DAY}) NOT IN (SELECT (user_id, ts) FROM ended)""",
    "stream_pipeline_continuous": _live_sql("count(e.us) AS n, coalesce(max(value), -1) AS high, count(DISTINCT event_type) AS kinds", DAY),
    "stream_pipeline_dedup": "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts DESC, event_id DESC) AS no FROM events) WHERE no = 1",
    "stream_pipeline_join": f"SELECT e.event_id, e.user_id, e.value, p.paid, p.purchase_id, epoch_us(e.ts) AS ts FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts >= p.bought",
    "stream_pipeline_changes": """WITH h AS (SELECT event_type, epoch_us(ts) AS f, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS z FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS no FROM events) WHERE no = 1),
d AS (SELECT event_type, us, sum(n) AS n FROM (SELECT event_type, f AS us, 1 AS n FROM h UNION ALL SELECT event_type, z, -1 FROM h WHERE z IS NOT NULL) GROUP BY ALL)
SELECT event_type, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY us) AS BIGINT) AS n, us AS ts FROM d""",
    "stream_stateless": "SELECT event_id AS id, value * 2 AS twice, epoch_us(ts) AS ts FROM events WHERE value > 50",
    "stream_tumbling": f'SELECT user_id, us // {DAY} * {DAY} AS "begin", us // {DAY} * {DAY} + {DAY} AS "end", count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, epoch_us(ts) AS us FROM events) GROUP BY ALL',
    "stream_hopping": f'SELECT user_id, z - {DAY} AS "begin", z AS "end", count(*) AS n, round(sum(value), 6) AS total FROM (SELECT user_id, value, unnest(range(us // {_Q} * {_Q} + {_Q}, us // {_Q} * {_Q} + {_Q} + {DAY}, {_Q})) AS z FROM (SELECT *, epoch_us(ts) AS us FROM events)) GROUP BY ALL',
    "stream_session": _SESSIONS + 'SELECT user_id, min(us) AS "begin", max(us) + 1 AS "end", count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, s',
    "stream_dedup": "SELECT DISTINCT user_id, event_type, epoch_us(ts) AS ts FROM events",
    "stream_upsert": "SELECT user_id, epoch_us(max(ts)) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id",
    "stream_continuous": _live_sql("count(e.us) AS n, round(coalesce(sum(value), 0), 6) AS total", DAY),
    "stream_asof_join": f"SELECT e.event_id, p.paid FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts >= p.bought",
}
