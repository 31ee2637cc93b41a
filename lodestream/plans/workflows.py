"""Queries through the workspace, sources, sinks and the rules of operators, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.expr import col, when
from lodestream.operators import aggregates as agg
from lodestream.plans.catalog import _PURCHASES, DAY, Events, LastPurchase, PartnerFeatures, Request, Spend, UserFeatures, frames, node, shown
from lodestream.plans.dataset import Dataset, dataset, field, inputs, pipeline
from lodestream.quality import expectations as ex
from lodestream.runtime import shared_path, table, utc
from lodestream.sources import connectors as cn
from lodestream.sources import sinks
from lodestream.types import Continuous, Hopping, Tumbling
from lodestream.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_HOOK = cn.Webhook("hook")
_EV = "event_id, epoch_us(ts) AS ts, user_id, event_type, value, props"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _workspace(spark: SparkSession, sf_dir: str, *datasets: Dataset, featuresets=()) -> Workspace:
    w = Workspace(spark)
    w.commit("first", [Events, *datasets], list(featuresets))
    w.log_frame(Events, table(spark, sf_dir, "events"))
    return w


# -- sources and sinks -----------------------------------------------------------------------------------------


@query(f"SELECT {_EV} FROM events WHERE event_type <> 'view'")
def source_webhook(spark, sf_dir):
    """Rows logged to an endpoint, for every dataset with a source on it."""

    @cn.source(_HOOK.endpoint("events"), disorder="1d", cdc="append", where=cn.eval_(col("event_type") != "view", {"event_type": str}))
    @dataset
    class Seen:
        event_id: int
        ts: datetime = field(timestamp=True)
        user_id: int
        event_type: str
        value: float
        props: str

    w = Workspace(spark)
    w.commit("first", [Seen])
    w.log("hook", "events", table(spark, sf_dir, "events"))
    return shown(w.frame(Seen))


@query("SELECT event_id, epoch_us(ts) AS ts, user_id * 2 AS twice, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06' AND value > 10")
def source_files_raw_columns(spark, sf_dir):
    """Dated folders with raw columns that the dataset lacks, read, changed by preproc and filtered."""
    root = shared_path(spark, "dated")
    events = utc(table(spark, sf_dir, "events")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    events.where("ts < TIMESTAMP '2024-01-10 00:00:00Z'").repartition("day").write.partitionBy("day").parquet(f"{root}/in")

    @dataset
    class Few:
        event_id: int
        ts: datetime = field(timestamp=True)
        twice: int
        kind: str

    s = cn.Source(
        cn.S3("s").bucket(root, path="in/day=%Y-%m-%d/*", format="parquet", scheme=""),
        "1d",
        "append",
        since=datetime(2024, 1, 3),
        until=datetime(2024, 1, 6),
        preproc={"twice": cn.eval_((col("user_id") * 2).astype(int), {"user_id": int}), "kind": cn.ref("event_type")},
        where=cn.eval_(col("value") > 10.0, {"value": float}),
    )
    return shown(cn.ingest(cn.read(spark, Few, s), Few, s))


@query("SELECT event_id, value, epoch_us(ts) AS ts FROM events")
def source_csv_without_header(spark, sf_dir):
    root = shared_path(spark, "csv")
    utc(table(spark, sf_dir, "events")).select("user_id", "event_id", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")).write.option("sep", ";").csv(f"{root}/in")

    @dataset
    class Bare:
        event_id: int
        value: float
        ts: datetime = field(timestamp=True)

    s = cn.Source(cn.S3("s").bucket(root, prefix="in", format="csv(delimiter=;)", scheme="", headers=["user_id", "event_id", "value", "ts"]), "1d", "append")
    return shown(cn.ingest(cn.read(spark, Bare, s), Bare, s))


@dataset(index=True)
class LastSeen:
    user_id: int = field(key=True, erase_key=True)
    event_id: int
    ts: datetime = field(timestamp=True)


@query("""WITH c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 * 1000 AS us, event_type = 'purchase' AS gone FROM events),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, us ORDER BY event_id DESC) AS no FROM c),
h AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM one WHERE no = 1)
SELECT user_id, event_id, us AS ts, nx AS _valid_to FROM h WHERE NOT gone""")
def source_debezium(spark, sf_dir):
    """Change records with updates and deletes into a keyed dataset: a delete ends the row before it."""
    events = utc(table(spark, sf_dir, "events")).coalesce(1).orderBy("event_id")
    ms = F.floor(F.unix_micros("ts") / 1000)
    row = F.struct("user_id", "event_id", F.timestamp_millis(ms).alias("ts"))
    gone = F.col("event_type") == "purchase"
    records = events.select(F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), ms.alias("ts_ms"))
    w = Workspace(spark)
    w.commit("first", [LastSeen])
    w.log_frame(LastSeen, records, cn.Source(_HOOK.endpoint("x"), "1d", "debezium"))
    return shown(w.frame(LastSeen))


@query("SELECT user_id, event_id, epoch_us(ts) AS ts, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS _valid_to FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS no FROM events) WHERE no = 1")
def source_upsert(spark, sf_dir):
    w = Workspace(spark)
    w.commit("first", [LastSeen])
    w.log_frame(LastSeen, table(spark, sf_dir, "events").coalesce(1).orderBy("event_id"), cn.Source(_HOOK.endpoint("x"), "1d", "upsert"))
    return shown(w.frame(LastSeen))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS paid FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def sink_snapshot(spark, sf_dir):
    """The rows that hold now, written as a version of a snapshot and read again."""
    df = frames(spark, sf_dir)(LastPurchase).where("_valid_to IS NULL").select("user_id", "paid")
    root = shared_path(spark, "snapshot")
    for _ in range(3):
        path = sinks.snapshot(df, root, "parquet", sinks.SnapshotData(marker="_SUCCESS_ALL", num_retain=2))
    return spark.read.parquet(path)


# -- joins and aggregates --------------------------------------------------------------------------------------


@dataset(index=True)
class Nothing:
    user_id: int = field(key=True)
    paid: float
    bought: datetime = field(timestamp=True)

    @pipeline
    @inputs(Events)
    def made(cls, events):
        return events.filter(col("value") < -1e9).select("user_id", "value").rename({"value": "paid", "ts": "bought"}).groupby("user_id").latest()


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, NULL::DOUBLE AS paid FROM events")
def join_empty_right(spark, sf_dir):
    return node(Events.select("event_id", "user_id").join(Nothing, how="left", on=["user_id"]), spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, 1.0 AS paid FROM events WHERE false")
def join_empty_right_inner(spark, sf_dir):
    return node(Events.select("event_id", "user_id").join(Nothing, how="inner", on=["user_id"]), spark, sf_dir)


@query(f"""SELECT e.event_id, epoch_us(e.ts) AS ts, e.user_id, p.paid FROM events e LEFT JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts = p.bought""")
def join_equal_times(spark, sf_dir):
    """A right row of the very time of the left one counts; one a moment before the window doesn't."""
    return node(Events.select("event_id", "user_id").join(LastPurchase, how="left", on=["user_id"], within=("0s", "0s"), fields=["paid"]), spark, sf_dir)


_BIG = "CASE WHEN value > 40 THEN value END"


def _tumbled(select: str) -> str:
    return f"SELECT user_id, (epoch_us(ts) // {DAY} + 1) * {DAY} AS ts, {select} FROM events WHERE (epoch_us(ts) // {DAY} + 1) * {DAY} <= (SELECT epoch_us(max(ts)) FROM events) GROUP BY ALL"


@query(f"SELECT * FROM ({_tumbled(f'count({_BIG}) AS known, count(*) AS n, coalesce(min({_BIG}), -1) AS low, coalesce(max({_BIG}), -1) AS high, round(coalesce(avg({_BIG}), 0), 6) AS mean, round(coalesce(sum({_BIG}), 0), 6) AS total')})")
def agg_nulls(spark, sf_dir):
    """Nulls in aggregates: counted unless dropnull, else skipped; defaults where nothing is left."""
    w = {"window": Tumbling("1d")}
    big = Events.select("user_id", "value").assign(big=when(col("value") > 40).then(col("value")).astype(Optional[float]))
    n = big.groupby("user_id").aggregate(
        known=agg.Count("big", dropnull=True, **w), n=agg.Count(**w), low=agg.Min("big", default=-1.0, **w), high=agg.Max("big", default=-1.0, **w), mean=agg.Average("big", **w), total=agg.Sum("big", **w)
    )
    return node(n, spark, sf_dir).drop("_valid_to").where("n > 0").withColumns({c: F.round(c, 6) for c in ("mean", "total")})


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), m AS (SELECT max(us) AS m FROM e),
d AS (SELECT user_id, (us // {DAY} + 1) * {DAY} AS ts, count(*) AS n FROM e, m WHERE (us // {DAY} + 1) * {DAY} <= m GROUP BY ALL),
d2 AS (SELECT * FROM d UNION ALL SELECT user_id, ts + {DAY}, 0 FROM d, m WHERE ts + {DAY} <= m AND (user_id, ts + {DAY}) NOT IN (SELECT (user_id, ts) FROM d)),
h AS (SELECT user_id, z AS ts, count(*) AS n FROM (SELECT user_id, unnest([(us // {2 * DAY} + 1) * {2 * DAY}, (us // {2 * DAY} + 2) * {2 * DAY}]) AS z FROM e), m WHERE z <= m GROUP BY ALL),
h2 AS (SELECT * FROM h UNION ALL SELECT user_id, ts + {2 * DAY}, 0 FROM h, m WHERE ts + {2 * DAY} <= m AND (user_id, ts + {2 * DAY}) NOT IN (SELECT (user_id, ts) FROM h)),
t AS (SELECT user_id, ts FROM d2 UNION SELECT user_id, ts FROM h2)
SELECT t.user_id, t.ts, coalesce(last_value(d2.n IGNORE NULLS) OVER w, 0) AS daily, coalesce(last_value(h2.n IGNORE NULLS) OVER w, 0) AS four
FROM t LEFT JOIN d2 USING (user_id, ts) LEFT JOIN h2 USING (user_id, ts) WINDOW w AS (PARTITION BY t.user_id ORDER BY t.ts)""")
def agg_windows_mixed(spark, sf_dir):
    """Windows of different lengths in one aggregate: every change of one gives a row with both as last published."""
    n = Events.groupby("user_id").aggregate(daily=agg.Count(window=Tumbling("1d")), four=agg.Count(window=Hopping("4d", "2d")))
    return node(n, spark, sf_dir).drop("_valid_to")


@query("SELECT user_id, epoch_us(ts) AS ts, array_to_string(list(event_id ORDER BY event_id DESC), ',') AS same FROM events GROUP BY user_id, ts")
def agg_ties(spark, sf_dir):
    """Rows of one time come in order of arrival, the last first."""
    n = Events.groupby("user_id").aggregate(same=agg.LastK("event_id", limit=1_000_000, window=Continuous("1s")))
    rows = node(n, spark, sf_dir).drop("_valid_to")
    events = frames(spark, sf_dir)(Events).select("user_id", F.unix_micros("ts").alias("ts")).distinct()
    alone = rows.join(events, ["user_id", "ts"])
    at_once = frames(spark, sf_dir)(Events).groupBy("user_id", F.unix_micros("ts").alias("ts")).agg(F.count(F.lit(1)).alias("k"))
    return alone.join(at_once, ["user_id", "ts"]).select("user_id", "ts", F.array_join(F.transform(F.slice("same", F.lit(1), F.col("k").cast("int")), lambda x: x.cast("string")), ",").alias("same"))


# -- the workspace ---------------------------------------------------------------------------------------------


@query(f"""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup')
SELECT q.event_id, q.user_id, p.paid, p.paid IS NOT NULL AS found FROM q ASOF LEFT JOIN {_PURCHASES} p ON q.user_id = p.user_id AND q.ts >= p.bought""")
def workspace_lookup(spark, sf_dir):
    w = _workspace(spark, sf_dir, LastPurchase)
    keys = w.frame(Events).where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("asked"))
    values, found = w.lookup(LastPurchase, keys, fields=["paid"], timestamps="asked")
    return values.select("event_id", "user_id", "paid", F.col(found).alias("found"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS paid FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def workspace_lookup_now(spark, sf_dir):
    w = _workspace(spark, sf_dir, LastPurchase)
    values, found = w.lookup(LastPurchase, w.frame(Events).select("user_id").distinct(), fields=["paid"])
    return values.where(F.col(found)).select("user_id", "paid")


@query("SELECT user_id, event_id, epoch_us(ts) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS no FROM events) WHERE no = 1 AND user_id % 3 <> 0")
def workspace_erase(spark, sf_dir):
    w = Workspace(spark)
    w.commit("first", [LastSeen])
    events = table(spark, sf_dir, "events").coalesce(1).orderBy("event_id")
    w.log_frame(LastSeen, events.where("event_id % 2 = 0"), cn.Source(_HOOK.endpoint("x"), "1d", "upsert"))
    w.erase(LastSeen, events.where("user_id % 3 = 0").select("user_id").distinct())
    w.log_frame(LastSeen, events.where("event_id % 2 = 1"), cn.Source(_HOOK.endpoint("x"), "1d", "upsert"))
    kept = w.frame(LastSeen).drop("_valid_to")
    return shown(kept)


@query(f"SELECT {_EV} FROM events ORDER BY ts DESC LIMIT 25")
def workspace_inspect(spark, sf_dir):
    return shown(_workspace(spark, sf_dir).inspect(Events, 25))


@query(f"""WITH q AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
s AS (SELECT q.event_id, count(p.us) AS n FROM q LEFT JOIN (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') p
  ON p.user_id = q.user_id AND p.us <= q.us AND p.us > q.us - {2 * DAY + 1_000_000} GROUP BY q.event_id)
SELECT event_id, n, us AS asked FROM s JOIN q USING (event_id)""")
def workspace_query_offline(spark, sf_dir):
    w = _workspace(spark, sf_dir, Spend, LastPurchase, featuresets=[Request, UserFeatures, PartnerFeatures])
    asked = w.frame(Events).where("event_type = 'signup'")
    df = asked.select(F.col("event_id").alias("Request.event_id"), F.col("user_id").alias("Request.user_id"), F.array("user_id").alias("Request.partners"), F.col("ts").alias("asked"))
    out = w.query_offline(["Request.event_id", "UserFeatures.n"], df, "asked")
    return out.select(F.col("`Request.event_id`").alias("event_id"), F.col("`UserFeatures.n`").alias("n"), F.unix_micros("asked").alias("asked"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def workspace_env(spark, sf_dir):
    """Of two pipelines that of the branch's environment runs."""

    @dataset(index=True)
    class Counted:
        user_id: int = field(key=True)
        n: int
        ts: datetime = field(timestamp=True)

        @pipeline(env="test")
        @inputs(Events)
        def few(cls, events):
            return events.filter(col("event_type") == "purchase").groupby("user_id").aggregate(n=agg.Count())

        @pipeline(env="~test")
        @inputs(Events)
        def all(cls, events):
            return events.groupby("user_id").aggregate(n=agg.Count())

    w = Workspace(spark)
    w.commit("first", [Events, Counted], env="test")
    w.log_frame(Events, table(spark, sf_dir, "events"))
    return w.frame(Counted).where("_valid_to IS NULL").select("user_id", "n")


# -- expressions and expectations ------------------------------------------------------------------------------


@query("SELECT event_id, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS back, user_id AS num, 'int' AS kind, length(event_type) > 4 AS long FROM events")
def expr_to_int_and_types(spark, sf_dir):
    e = col("event_id").num.to_string().str.to_int()
    kinds = Events.schema.fields
    df = frames(spark, sf_dir)(Events)
    out = df.select("event_id", e.column(kinds).alias("back"), col("user_id").column(kinds).alias("num"), (col("event_type").str.len() > 4).column(kinds).alias("long"))
    return out.withColumn("kind", F.lit(str(e.typeof(kinds))))


@query("""WITH r AS (SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS p FROM lineitem), n AS (SELECT count(*) AS n FROM r),
c AS (SELECT [count(*) FILTER (regexp_matches(f, '^[AN]$')), count(*) FILTER (NOT regexp_matches(f, '^[AN]$')), count(*) FILTER (f IN ('A', 'N')), count(*) FILTER (f NOT IN ('R')), count(*) FILTER (f IS NULL),
  count(*) FILTER (length(f) BETWEEN 1 AND 2), count(*) FILTER (f = s), count(*) FILTER ((f, s) IN (('A', 'F'), ('N', 'O'))), count(*) FILTER (abs(q + d - 10) < 1e-9), count(*) FILTER (regexp_matches(f, 'A') OR regexp_matches(f, 'R')),
  count(*) FILTER (NOT (regexp_matches(f, 'A') OR regexp_matches(f, 'R'))), count(*)] AS ok FROM r)
SELECT unnest(range(12)) AS no, n AS n_rows, unnest(ok) AS n_ok FROM c, n""")
def expectations_all(spark, sf_dir):
    suite = [
        ex.expect_column_values_to_match_regex("l_returnflag", "^[AN]$"),
        ex.expect_column_values_to_not_match_regex("l_returnflag", "^[AN]$"),
        ex.expect_column_values_to_be_in_set("l_returnflag", ["A", "N"]),
        ex.expect_column_values_to_not_be_in_set("l_returnflag", ["R"]),
        ex.expect_column_values_to_be_null("l_returnflag"),
        ex.expect_column_value_lengths_to_be_between("l_returnflag", 1, 2),
        ex.expect_column_pair_values_to_be_equal("l_returnflag", "l_linestatus"),
        ex.expect_column_pair_values_to_be_in_set("l_returnflag", "l_linestatus", [("A", "F"), ("N", "O")]),
        ex.expect_multicolumn_sum_to_equal(["l_quantity", "l_discount"], 10.0),
        ex.expect_column_values_to_match_regex_list("l_returnflag", ["A", "R"]),
        ex.expect_column_values_to_not_match_regex_list("l_returnflag", ["A", "R"]),
        ex.expect_column_values_to_be_in_type_list("l_quantity", [float, int]),
    ]
    lines = table(spark, sf_dir, "lineitem")
    parts = [ex.report(lines, [e]).select(F.lit(k).cast("bigint").alias("no"), "n_rows", "n_ok") for k, e in enumerate(suite)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS d, event_type AS k, props AS p, json_extract(props, '$.k')::BIGINT AS x FROM events)
SELECT unnest(range(4)) AS no, unnest([count(*), 0, count(*), count(*) FILTER (x BETWEEN 2 AND 5)]) AS n_ok FROM e""")
def expectations_formats(spark, sf_dir):
    events = utc(table(spark, sf_dir, "events")).select(F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type", "props")
    suite = [
        ex.expect_column_values_to_match_strftime_format("d", "%Y-%m-%d"),
        ex.expect_column_values_to_match_strftime_format("event_type", "%Y-%m-%d"),
        ex.expect_column_values_to_be_json_parseable("props"),
        ex.expect_column_values_to_match_json_schema("props", {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 2, "maximum": 5}}}),
    ]
    parts = [ex.report(events, [e]).select(F.lit(k).cast("bigint").alias("no"), "n_ok") for k, e in enumerate(suite)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
