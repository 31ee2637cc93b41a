"""Queries over the driver's tables, one or more per operator, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Optional

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.expr import col, from_epoch, lit, now, repeat, var, when
from lodestream.features import extractor, feature, featureset
from lodestream.features.extractors import AT, extractor_order, run
from lodestream.operators import aggregates as agg
from lodestream.operators import temporal
from lodestream.plans.dataset import SEQ, Dataset, Node, dataset, field, index, inputs, outputs
from lodestream.quality import expectations as ex
from lodestream.runtime import table, utc
from lodestream.sources import connectors as cn
from lodestream.sources import sinks
from lodestream.types import Continuous, Hopping, Session, Tumbling, struct

# -- datasets over the driver's tables -------------------------------------------------------------------------


@dataset
class Events:
    event_id: int
    ts: datetime = field(timestamp=True)
    user_id: int
    event_type: str
    value: float
    props: str


@dataset
class Orders:
    o_orderkey: int
    o_custkey: int
    o_orderstatus: str
    o_totalprice: float
    o_orderdate: datetime = field(timestamp=True)
    o_orderpriority: str


def frames(spark: SparkSession, sf_dir: str) -> Callable[[Dataset], DataFrame]:
    """Frames of the datasets above, and of datasets derived from them by a pipeline."""

    def frame(d: Dataset) -> DataFrame:
        if d.pipelines:
            rows = d.pipelines[0].node.frame(frame)
            return rows if SEQ in rows.columns else rows.withColumn(SEQ, F.lit(0).cast("bigint"))
        if d is Events:
            return utc(table(spark, sf_dir, "events")).withColumn(SEQ, F.col("event_id"))
        if d is Orders:
            return utc(table(spark, sf_dir, "orders")).withColumn(SEQ, F.col("o_orderkey"))
        raise ValueError(d._name)

    return frame


def shown(df: DataFrame) -> DataFrame:
    """Without hidden columns, and times in microseconds."""
    out = []
    for f in df.schema.fields:
        if f.name == SEQ:
            continue
        c = F.col(f"`{f.name}`")
        out.append(F.unix_micros(c).alias(f.name) if f.dataType.typeName() == "timestamp" else c)
    return df.select(*out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def node(n: Node, spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(n.frame(frames(spark, sf_dir)))


# -- stateless operators ---------------------------------------------------------------------------------------


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events WHERE value > 50 AND event_type = 'purchase'")
def filter_expr(spark, sf_dir):
    return node(Events.filter((col("value") > 50.0) & (col("event_type") == "purchase")), spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events WHERE value > 50 AND user_id % 2 = 0")
def filter_python(spark, sf_dir):
    return node(Events.filter(lambda df: (df["value"] > 50) & (df["user_id"] % 2 == 0)), spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props, value * 2 AS twice, event_id + user_id AS both, value > 10 AS big FROM events")
def assign_expr(spark, sf_dir):
    n = Events.assign(twice=(col("value") * 2).astype(float), both=(col("event_id") + col("user_id")).astype(int), big=(col("value") > 10).astype(bool))
    return node(n, spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props, length(event_type) AS n FROM events")
def assign_python(spark, sf_dir):
    return node(Events.assign("n", int, lambda df: df["event_type"].str.len()), spark, sf_dir)


@query("SELECT epoch_us(ts) AS ts, user_id, upper(event_type) AS kind, value + 1 AS value FROM events")
def transform_python(spark, sf_dir):
    def up(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ts": df["ts"], "user_id": df["user_id"], "kind": df["event_type"].str.upper(), "value": df["value"] + 1})

    return node(Events.transform(up, {"ts": datetime, "user_id": int, "kind": str, "value": float}), spark, sf_dir)


@query("SELECT event_id AS id, epoch_us(ts) AS happened, user_id AS who, value FROM events")
def select_drop_rename(spark, sf_dir):
    n = Events.select("event_id", "user_id", "value", "props").drop("props").rename({"event_id": "id", "user_id": "who", "ts": "happened"})
    return node(n, spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props, CASE WHEN value > 20 THEN value END AS big FROM events WHERE value > 20")
def dropnull(spark, sf_dir):
    n = Events.assign(big=when(col("value") > 20).then(col("value")).astype(Optional[float])).dropnull("big")
    return node(n, spark, sf_dir)


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, unnest(string_split(event_type, 'i')) AS part, unnest(string_split(event_type, 'i')) AS again FROM events")
def explode_lists(spark, sf_dir):
    parts = col("event_type").str.split("i").astype(list[str])
    n = Events.select("event_id", "user_id", "event_type").assign(part=parts, again=parts).drop("event_type").explode("part", "again")
    return node(n, spark, sf_dir)


@query("""SELECT o_custkey AS who, o_totalprice AS amount, epoch_us(o_orderdate) AS moment FROM orders
UNION ALL SELECT user_id, value, epoch_us(ts) FROM events""")
def union_streams(spark, sf_dir):
    a = Orders.select("o_custkey", "o_totalprice").rename({"o_custkey": "who", "o_totalprice": "amount", "o_orderdate": "moment"})
    b = Events.select("user_id", "value").rename({"user_id": "who", "value": "amount", "ts": "moment"})
    return node(a + b, spark, sf_dir)


# -- dedup, first, latest, changelog ---------------------------------------------------------------------------

_EV = "event_id, epoch_us(ts) AS ts, user_id, event_type, value, props"


@query(f"SELECT {_EV} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) AS no FROM events) WHERE no = 1")
def dedup_rows(spark, sf_dir):
    return node(Events.dedup("user_id", "event_type"), spark, sf_dir)


@query(f"SELECT {_EV} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts DESC, event_id DESC) AS no FROM events) WHERE no = 1")
def dedup_tumbling(spark, sf_dir):
    return node(Events.dedup("user_id", window=Tumbling("1d")), spark, sf_dir)


@query(f"""WITH a AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 21600000000 AS fresh FROM events),
b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT {_EV} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY ts DESC, event_id DESC) AS no FROM b) WHERE no = 1""")
def dedup_session(spark, sf_dir):
    return node(Events.dedup("user_id", window=Session("6h")), spark, sf_dir)


@query(f"SELECT {_EV} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events) WHERE no = 1")
def first_per_key(spark, sf_dir):
    return node(Events.groupby("user_id").first(), spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", "props")


_HISTORY = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority,
lead(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS _valid_to FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS no FROM orders) WHERE no = 1)"""


@query(f"SELECT * FROM {_HISTORY}")
def latest_history(spark, sf_dir):
    return node(Orders.groupby("o_custkey").latest(), spark, sf_dir)


@dataset(index=True)
class LastOrder:
    o_custkey: int = field(key=True)
    o_orderkey: int
    o_orderstatus: str
    o_totalprice: float
    o_orderdate: datetime = field(timestamp=True)
    o_orderpriority: str

    from lodestream.plans.dataset import pipeline as _pipeline

    @_pipeline
    @inputs(Orders)
    def latest(cls, orders):
        return orders.groupby("o_custkey").latest()


_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query(f"SELECT {_COLS}, o_orderdate, false AS gone FROM {_HISTORY} UNION ALL SELECT {_COLS}, _valid_to, true FROM {_HISTORY} WHERE _valid_to IS NOT NULL")
def changelog_delete(spark, sf_dir):
    return node(LastOrder.changelog(delete="gone"), spark, sf_dir)


@query(f"SELECT {_COLS}, o_orderdate, true AS here FROM {_HISTORY} UNION ALL SELECT {_COLS}, _valid_to, false FROM {_HISTORY} WHERE _valid_to IS NOT NULL")
def changelog_insert(spark, sf_dir):
    return node(LastOrder.changelog(insert="here"), spark, sf_dir)


# -- joins -----------------------------------------------------------------------------------------------------


@dataset(index=True)
class LastPurchase:
    user_id: int = field(key=True)
    paid: float
    purchase_id: int
    bought: datetime = field(timestamp=True)

    from lodestream.plans.dataset import pipeline as _pipeline

    @_pipeline
    @inputs(Events)
    def latest(cls, events):
        return events.filter(col("event_type") == "purchase").select("user_id", "value", "event_id").rename({"value": "paid", "event_id": "purchase_id", "ts": "bought"}).groupby("user_id").latest()


_PURCHASES = "(SELECT user_id, value AS paid, event_id AS purchase_id, ts AS bought FROM events WHERE event_type = 'purchase')"
_CLICKS = Events.filter(col("event_type") == "click").select("event_id", "user_id", "value")


@query(f"SELECT e.event_id, epoch_us(e.ts) AS ts, e.user_id, e.value, p.paid, p.purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts >= p.bought")
def join_asof_left(spark, sf_dir):
    return node(_CLICKS.join(LastPurchase, how="left", on=["user_id"]), spark, sf_dir)


@query(f"SELECT e.event_id, epoch_us(e.ts) AS ts, e.user_id, e.value, p.paid, epoch_us(p.bought) AS bought FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.ts >= p.bought")
def join_asof_inner(spark, sf_dir):
    return node(_CLICKS.join(LastPurchase, how="inner", on=["user_id"], fields=["paid", "bought"]), spark, sf_dir)


@query(f"""SELECT e.event_id, epoch_us(e.ts) AS ts, e.user_id, e.value, CASE WHEN p.bought >= e.ts - INTERVAL 7 DAY THEN p.paid END AS paid,
CASE WHEN p.bought >= e.ts - INTERVAL 7 DAY THEN p.purchase_id END AS purchase_id
FROM (SELECT *, ts + INTERVAL 1 HOUR AS late FROM events WHERE event_type = 'click') e ASOF LEFT JOIN {_PURCHASES} p ON e.user_id = p.user_id AND e.late >= p.bought""")
def join_asof_bounded(spark, sf_dir):
    return node(_CLICKS.join(LastPurchase, how="left", on=["user_id"], within=("7d", "1h")), spark, sf_dir)


_LEFT_HISTORY = """(SELECT user_id, value, epoch_us(ts) AS f, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 4611686018427387904) AS z FROM events WHERE event_type = 'signup')"""
_RIGHT_HISTORY = """(SELECT user_id, value AS paid, epoch_us(ts) AS f, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 4611686018427387904) AS z FROM events WHERE event_type = 'purchase')"""
_MET = f"""SELECT l.user_id, l.value, r.paid, greatest(l.f, r.f) AS ts, least(l.z, r.z) AS z, l.f AS lf FROM {_LEFT_HISTORY} l JOIN {_RIGHT_HISTORY} r ON l.user_id = r.user_id AND l.f < r.z AND r.f < l.z"""
_SIGNUPS = Events.filter(col("event_type") == "signup").select("user_id", "value").groupby("user_id").latest()


def _open_end(sql: str) -> str:
    return f"SELECT user_id, value, paid, ts, CASE WHEN z < 4611686018427387904 THEN z END AS _valid_to FROM ({sql})"


@query(_open_end(_MET))
def join_history_inner(spark, sf_dir):
    return node(_SIGNUPS.join(LastPurchase, how="inner", on=["user_id"], fields=["paid"]), spark, sf_dir)


@query(_open_end(f"""SELECT user_id, value, paid, ts, z FROM ({_MET}) UNION ALL
SELECT l.user_id, l.value, NULL, l.f, least(l.z, coalesce((SELECT min(f) FROM {_RIGHT_HISTORY} r WHERE r.user_id = l.user_id), l.z))
FROM {_LEFT_HISTORY} l WHERE l.f < coalesce((SELECT min(f) FROM {_RIGHT_HISTORY} r WHERE r.user_id = l.user_id), l.z)"""))
def join_history_left(spark, sf_dir):
    # purchases never end, so the only part without one is that before the first
    return node(_SIGNUPS.join(LastPurchase, how="left", on=["user_id"], fields=["paid"]), spark, sf_dir)


# -- aggregates of discrete windows ----------------------------------------------------------------------------

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _discrete_sql(ends: str, stride: int, lookback: int = 0) -> str:
    return f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
w AS (SELECT user_id, {ends} AS ts, value FROM e),
m AS (SELECT max(us) - {lookback} AS m FROM e),
pub AS (SELECT user_id, ts, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high, stddev_pop(value) AS dev
  FROM w, m WHERE ts <= m GROUP BY user_id, ts),
fin AS (SELECT DISTINCT user_id, ts + {stride} AS ts FROM pub, m WHERE ts + {stride} <= m),
rows_out AS (SELECT * FROM pub UNION ALL SELECT user_id, ts, 0, 0, 0, 0, 0, -1 FROM fin ANTI JOIN pub USING (user_id, ts))
SELECT user_id, ts, n, round(total, 6) AS total, round(mean, 6) AS mean, low, high, round(dev, 6) AS dev FROM rows_out"""


def _discrete(window, spark, sf_dir):
    w = {"window": window}
    n = Events.groupby("user_id").aggregate(
        n=agg.Count(**w),
        total=agg.Sum("value", **w),
        mean=agg.Average("value", **w),
        low=agg.Min("value", default=0.0, **w),
        high=agg.Max("value", default=0.0, **w),
        dev=agg.Stddev("value", default=-1.0, **w),
    )
    return _rounded(node(n, spark, sf_dir).drop("_valid_to"), "total", "mean", "dev")


@query(_discrete_sql(f"(us // {DAY}) * {DAY} + {DAY}", DAY))
def agg_tumbling(spark, sf_dir):
    return _discrete(Tumbling("1d"), spark, sf_dir)


@query(_discrete_sql(f"(us // {DAY}) * {DAY} + {DAY}", DAY, 5 * DAY))
def agg_tumbling_lookback(spark, sf_dir):
    return _discrete(Tumbling("1d", lookback="5d"), spark, sf_dir)


@query(_discrete_sql(f"unnest(range((us // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR}, (us // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} + {DAY}, {6 * HOUR}))", 6 * HOUR))
def agg_hopping(spark, sf_dir):
    return _discrete(Hopping("1d", "6h"), spark, sf_dir)


@query(f"""WITH e AS (SELECT user_id, (epoch_us(ts) // {DAY}) * {DAY} + {DAY} AS ts, epoch_us(ts) AS us, value FROM events),
d AS (SELECT user_id, ts, count(*) AS n, sum(value) AS s FROM e GROUP BY ALL)
SELECT user_id, ts, n, round(total, 6) AS total FROM (SELECT user_id, ts, CAST(sum(n) OVER w AS BIGINT) AS n, sum(s) OVER w AS total FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE ts <= (SELECT max(us) FROM e)""")
def agg_hopping_forever(spark, sf_dir):
    w = {"window": Hopping("forever", "1d")}
    n = Events.groupby("user_id").aggregate(n=agg.Count(**w), total=agg.Sum("value", **w))
    return _rounded(node(n, spark, sf_dir).drop("_valid_to"), "total")


_SESSIONS = f"""WITH a AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {6 * HOUR} AS fresh FROM events),
b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM a)"""


@query(_SESSIONS + "SELECT user_id, max(us) + 1 AS ts, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, s")
def agg_session(spark, sf_dir):
    w = {"window": Session("6h")}
    n = Events.groupby("user_id").aggregate(n=agg.Count(**w), total=agg.Sum("value", **w))
    return _rounded(node(n, spark, sf_dir).drop("_valid_to"), "total")


def _window_shown(df: DataFrame) -> DataFrame:
    return df.select("*", F.unix_micros("window.begin").alias("w_begin"), F.unix_micros("window.end").alias("w_end")).drop("window", "_valid_to")


@query(_SESSIONS + "SELECT user_id, max(us) + 1 AS ts, min(us) AS w_begin, max(us) + 1 AS w_end, count(*) AS n FROM b GROUP BY user_id, s")
def agg_session_key(spark, sf_dir):
    n = Events.groupby("user_id", window=Session("6h")).aggregate(n=agg.Count())
    return _window_shown(node(n, spark, sf_dir))


@query(
    _discrete_sql(f"unnest(range((us // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR}, (us // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} + {DAY}, {6 * HOUR}))", 6 * HOUR).replace(
        "SELECT user_id, ts, n, round(total, 6) AS total, round(mean, 6) AS mean, low, high, round(dev, 6) AS dev FROM", f"SELECT user_id, ts, ts - {DAY} AS w_begin, ts AS w_end, n, high FROM"
    )
)
def agg_hopping_key(spark, sf_dir):
    n = Events.groupby("user_id", window=Hopping("1d", "6h")).aggregate(n=agg.Count(), high=agg.Max("value", default=0.0))
    return _window_shown(node(n, spark, sf_dir))


@query(f"SELECT DISTINCT user_id, (epoch_us(ts) // {DAY} + 1) * {DAY} AS ts, (epoch_us(ts) // {DAY}) * {DAY} AS w_begin, (epoch_us(ts) // {DAY} + 1) * {DAY} AS w_end FROM events WHERE (epoch_us(ts) // {DAY} + 1) * {DAY} <= (SELECT epoch_us(max(ts)) FROM events)")
def agg_window_keys(spark, sf_dir):
    return _window_shown(node(Events.groupby("user_id", window=Tumbling("1d")).aggregate(), spark, sf_dir))


# -- aggregates of continuous windows --------------------------------------------------------------------------


def _live_sql(select: str, us: int | None, source: str = "(SELECT *, epoch_us(ts) AS us FROM events)") -> str:
    """Aggregates of the rows live at each change, by joining changes and rows."""
    ends = f"UNION SELECT user_id, us + {us + 1_000_000} FROM e" if us else ""
    alive = f"AND e.us > m.us - {us + 1_000_000}" if us else ""
    return f"""WITH e AS {source}, m AS (SELECT user_id, us FROM e {ends})
SELECT m.user_id, m.us AS ts, {select} FROM m LEFT JOIN e ON e.user_id = m.user_id AND e.us <= m.us {alive} GROUP BY m.user_id, m.us"""


@query(_live_sql("count(e.us) AS n, round(coalesce(sum(value), 0), 6) AS total, round(coalesce(avg(value), 0), 6) AS mean", DAY))
def agg_continuous(spark, sf_dir):
    w = {"window": Continuous("1d")}
    n = Events.groupby("user_id").aggregate(n=agg.Count(**w), total=agg.Sum("value", **w), mean=agg.Average("value", **w))
    # sums of floats that come and go leave a rest in the last digits
    return node(n, spark, sf_dir).drop("_valid_to").withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("total", "mean")})


@query(_live_sql("count(e.us) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(stddev_pop(value), 6) AS dev", None))
def agg_forever(spark, sf_dir):
    n = Events.groupby("user_id").aggregate(n=agg.Count(), total=agg.Sum("value"), low=agg.Min("value", default=0.0), high=agg.Max("value", default=0.0), dev=agg.Stddev("value"))
    return node(n, spark, sf_dir).drop("_valid_to").withColumns({"total": F.round("total", 4), "dev": F.round("dev", 6)})


@query(_live_sql("coalesce(min(value), -1) AS low, coalesce(max(value), -1) AS high, round(coalesce(stddev_pop(value), -1), 6) AS dev", 2 * DAY))
def agg_continuous_extremes(spark, sf_dir):
    w = {"window": Continuous("2d")}
    n = Events.groupby("user_id").aggregate(low=agg.Min("value", default=-1.0, **w), high=agg.Max("value", default=-1.0, **w), dev=agg.Stddev("value", **w))
    return node(n, spark, sf_dir).drop("_valid_to").withColumn("dev", F.round("dev", 6))


@query(_live_sql("CASE WHEN count(value) > 0 THEN list_sort(list(value) FILTER (value IS NOT NULL))[least(count(value), CAST(floor(0.5 * count(value)) AS BIGINT) + 1)] ELSE -1 END AS median", 3 * DAY))
def agg_quantile(spark, sf_dir):
    n = Events.groupby("user_id").aggregate(median=agg.Quantile("value", window=Continuous("3d"), p=0.5, default=-1.0))
    return node(n, spark, sf_dir).drop("_valid_to")


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


@query(_live_sql("coalesce(array_to_string(list_slice(list(event_id ORDER BY e.us DESC, event_id DESC) FILTER (event_id IS NOT NULL), 1, 3), ','), '') AS last3, coalesce(array_to_string(list_slice(list(event_id ORDER BY e.us, event_id) FILTER (event_id IS NOT NULL), 1, 2), ','), '') AS first2", 5 * DAY))
def agg_lastk_firstk(spark, sf_dir):
    w = {"window": Continuous("5d")}
    n = Events.groupby("user_id").aggregate(last3=agg.LastK("event_id", limit=3, **w), first2=agg.FirstK("event_id", limit=2, **w))
    return _joined(node(n, spark, sf_dir).drop("_valid_to"), "last3", "first2")


@query(_live_sql("coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type IS NOT NULL)), ','), '') AS kinds, count(DISTINCT event_type) AS n_kinds", 2 * DAY))
def agg_distinct_unique(spark, sf_dir):
    w = {"window": Continuous("2d")}
    n = Events.groupby("user_id").aggregate(kinds=agg.Distinct("event_type", unordered=True, **w), n_kinds=agg.Count("event_type", unique=True, approx=True, **w))
    return _joined(node(n, spark, sf_dir).drop("_valid_to"), "kinds")


@query(_live_sql("round(coalesce(sum(value * exp(-(m.us - e.us) / 1e6 * ln(2) / 86400)), 0), 6) AS decayed", None))
def agg_exp_decay(spark, sf_dir):
    n = Events.groupby("user_id").aggregate(decayed=agg.ExpDecaySum("value", half_life="1d"))
    return _rounded(node(n, spark, sf_dir).drop("_valid_to"), "decayed")


@query(_live_sql("count(e.us) AS n", DAY, "(SELECT user_id, epoch_us(ts) - 3600000000 AS us FROM events)"))
def agg_along(spark, sf_dir):
    earlier = from_epoch(col("ts").dt.since_epoch("microsecond") - 3_600_000_000, unit="microsecond").astype(datetime)
    n = Events.select("user_id", "event_id").assign(seen=earlier).groupby("user_id").aggregate(agg.Count(into_field="n", window=Continuous("1d")), along="seen")
    return node(n, spark, sf_dir).drop("_valid_to")


@query(f"""WITH h AS {_HISTORY}, m AS (SELECT o_orderpriority, o_orderdate AS us FROM h UNION SELECT o_orderpriority, _valid_to FROM h WHERE _valid_to IS NOT NULL),
d AS (SELECT o_orderpriority, us, sum(n) AS n FROM (SELECT o_orderpriority, o_orderdate AS us, 1 AS n FROM h UNION ALL SELECT o_orderpriority, _valid_to, -1 FROM h WHERE _valid_to IS NOT NULL) GROUP BY ALL)
SELECT o_orderpriority, us AS o_orderdate, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY us) AS BIGINT) AS n FROM d""")
def agg_keyed_input(spark, sf_dir):
    """Customers by the priority of their last order: a customer's row ends with the next one."""
    n = LastOrder.groupby("o_orderpriority").aggregate(n=agg.Count())
    return node(n, spark, sf_dir).drop("_valid_to")


@query(f"""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), p AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'purchase')
SELECT p.user_id, p.us AS ts, count(e.us) AS n, round(coalesce(sum(value), 0), 4) AS total, coalesce(max(value), 0) AS high
FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.us <= p.us AND e.us > p.us - {7 * DAY + 1_000_000} GROUP BY p.user_id, p.us""")
def agg_asof_points(spark, sf_dir):
    df = frames(spark, sf_dir)(Events)
    w = {"window": Continuous("7d")}
    specs = [agg.Count(into_field="n", **w), agg.Sum("value", into_field="total", **w), agg.Max("value", into_field="high", default=0.0, **w)]
    points = df.where("event_type = 'purchase'").select("user_id", "ts")
    out = agg.aggregate_asof(df, ["user_id"], "ts", specs, Events.schema.fields, points, "ts", [SEQ])
    return shown(out).withColumn("total", F.round("total", 4))


@query(f"SELECT event_id, ((epoch_us(ts) // {DAY}) - 1) * {DAY} AS b, (epoch_us(ts) // {DAY}) * {DAY} AS e FROM events")
def bucketize_time(spark, sf_dir):
    df = frames(spark, sf_dir)(Events).select("event_id", agg.bucketize(F.col("ts"), Tumbling("1d")).alias("w"))
    return df.select("event_id", F.unix_micros("w.begin").alias("b"), F.unix_micros("w.end").alias("e"))


# -- expressions -----------------------------------------------------------------------------------------------


def evaluated(df: DataFrame, types: dict, keep: list[str], **exprs) -> DataFrame:
    types = {k: t.dtype(v) for k, v in types.items()}
    return df.select(*keep, *(e.column(types).alias(n) for n, e in exprs.items()))


_LINE = {"l_orderkey": int, "l_linenumber": int, "l_quantity": float, "l_extendedprice": float, "l_discount": float}


@query("""SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, CAST(floor(l_quantity / 7) AS BIGINT) AS f, abs(-l_extendedprice) AS a,
round(sqrt(l_extendedprice), 6) AS s, round(pow(l_quantity, 2), 6) AS p, CAST(pow(l_linenumber, 2) AS BIGINT) AS ip, round(ln(l_extendedprice), 6) AS lg, round(log10(l_extendedprice), 6) AS l10,
round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS co, round(tan(l_quantity), 4) AS ta, round(asin(l_discount), 6) AS asi, round(acos(l_discount), 6) AS aco, round(atan(l_quantity), 6) AS ata,
isnan(l_quantity) AS nan, isinf(l_quantity) AS inf, CAST(round(l_extendedprice) AS BIGINT) AS r0, CAST(l_linenumber AS VARCHAR) AS txt FROM lineitem""")
def expr_numeric(spark, sf_dir):
    q, e, d, n = col("l_quantity"), col("l_extendedprice"), col("l_discount"), col("l_linenumber")
    out = evaluated(
        table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")),
        _LINE,
        ["l_orderkey"],
        l_linenumber=n,
        c=(q / 7).ceil(),
        f=(q / 7).floor(),
        a=(-e).abs(),
        s=e.num.sqrt(),
        p=q.num.pow(2.0),
        ip=n.num.pow(2),
        lg=e.num.log(),
        l10=e.num.log(10),
        si=q.num.sin(),
        co=q.num.cos(),
        ta=q.num.tan(),
        asi=d.num.arcsin(),
        aco=d.num.arccos(),
        ata=q.num.arctan(),
        nan=q.num.is_nan(),
        inf=q.num.is_infinite(),
        r0=e.round(),
        txt=n.num.to_string(),
    )
    return _rounded(out, "s", "p", "lg", "l10", "si", "co", "asi", "aco", "ata").withColumn("ta", F.round("ta", 4))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey - 1000 AS m, CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(floor((l_orderkey - 1000) / (l_linenumber - 3)) AS BIGINT) END AS fd,
CASE WHEN l_linenumber = 3 THEN 0 ELSE (l_orderkey - 1000) % (l_linenumber - 3) END AS md,
CASE WHEN l_linenumber = 3 THEN CASE WHEN l_orderkey > 1000 THEN 'Infinity' WHEN l_orderkey < 1000 THEN '-Infinity' ELSE 'NaN' END ELSE 'finite' END AS d,
l_quantity * 2 - 1 + l_discount AS mixed FROM lineitem""")
def expr_arithmetic(spark, sf_dir):
    n, k = col("l_linenumber"), col("l_orderkey") - 1000
    df = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    out = evaluated(df, _LINE, ["l_orderkey"], l_linenumber=n, m=k, fd=k // (n - 3), md=k % (n - 3), d=k / (n - 3), mixed=col("l_quantity") * 2 - 1 + col("l_discount"))
    return out.withColumn("d", F.when(F.col("d").cast("string").isin("NaN", "Infinity", "-Infinity"), F.col("d").cast("string")).otherwise("finite"))


@query("""SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS level, CASE WHEN value > 50 THEN value END AS some,
coalesce(CASE WHEN value > 50 THEN value END, 0) AS filled, value <= 50 AS missing, (value > 10 AND event_type = 'click') OR user_id >= 100 AS logic, NOT (value < 5) AS neg, event_type != 'view' AS ne FROM events""")
def expr_case_null_logic(spark, sf_dir):
    v = col("value")
    some = when(v > 50).then(v)
    return evaluated(
        frames(spark, sf_dir)(Events),
        Events.schema.fields,
        ["event_id"],
        level=when(v > 50).then("high").when(v > 10).then("mid").otherwise("low"),
        some=some,
        filled=some.fillnull(0.0),
        missing=some.isnull(),
        logic=((v > 10) & (col("event_type") == "click")) | (col("user_id") >= 100),
        neg=~(v < 5),
        ne=col("event_type") != "view",
    )


@query("""SELECT doc_id, lower(text) AS lo, length(text) AS n, contains(text, 'the') AS has, starts_with(text, 'A') AS sw, ends_with(text, '.') AS ew,
lang || ':' || source AS joined, len(string_split(text, ' ')) AS words FROM documents""")
def expr_string(spark, sf_dir):
    s = col("text").str
    types = {"doc_id": int, "text": Optional[str], "lang": Optional[str], "source": Optional[str]}
    return evaluated(
        table(spark, sf_dir, "documents"),
        types,
        ["doc_id"],
        lo=s.lower(),
        n=s.len(),
        has=s.contains("the"),
        sw=s.startswith("A"),
        ew=s.endswith("."),
        joined=col("lang").str.concat(":").str.concat(col("source")),
        words=s.split(" ").list.len(),
    )


@query("""SELECT event_id, year(ts) AS y, month(ts) AS m, week(ts) AS w, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, epoch_us(ts) % 1000000 // 1000 AS ms, epoch_us(ts) % 1000000 AS us,
epoch_us(ts) // 1000000 AS secs, epoch_us(ts) // 86400000000 AS days, (epoch_us(ts) - 1704067200000000) // 3600000000 AS hours, strftime(ts, '%Y-%m-%d %H:%M:%S') AS txt,
epoch_us(date_trunc('second', ts)) AS back, epoch_us(to_timestamp(user_id)) AS made FROM events""")
def expr_datetime(spark, sf_dir):
    from lodestream.expr import datetime as dt_lit

    d = col("ts").dt
    text = d.strftime("%Y-%m-%d %H:%M:%S")
    return shown(
        evaluated(
            frames(spark, sf_dir)(Events),
            Events.schema.fields,
            ["event_id"],
            y=d.year,
            m=d.month,
            w=d.week,
            d=d.day,
            h=d.hour,
            mi=d.minute,
            s=d.second,
            ms=d.millisecond,
            us=d.microsecond,
            secs=d.since_epoch("second"),
            days=d.since_epoch("day"),
            hours=d.since(dt_lit(2024, 1, 1), "hour"),
            txt=text,
            back=text.str.strptime("%Y-%m-%d %H:%M:%S"),
            made=from_epoch(col("user_id"), "second"),
        )
    )


@query("""SELECT event_id, hour(timezone('Asia/Tokyo', timezone('UTC', ts))) AS tokyo, strftime(timezone('America/New_York', timezone('UTC', ts)), '%d/%m/%Y') AS ny FROM events""")
def expr_timezone(spark, sf_dir):
    d = col("ts").dt
    return evaluated(frames(spark, sf_dir)(Events), Events.schema.fields, ["event_id"], tokyo=d.with_tz("Asia/Tokyo").hour, ny=d.strftime("%d/%m/%Y", timezone="America/New_York"))


@query("""SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS s, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS m, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi,
CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS out, len(list_filter(embedding, lambda x: x > 0)) AS pos, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 6) AS twice,
len(list_filter(embedding, lambda x: x > 0)) > 0 AS some, len(list_filter(embedding, lambda x: x > -9)) = len(embedding) AS every, list_contains(list_transform(embedding, lambda x: x > 0), true) AS has, false AS nulls FROM embeddings""")
def expr_list(spark, sf_dir):
    e = col("embedding").list
    df = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    x = var("x")
    out = evaluated(
        df,
        {"vec_id": int, "embedding": list[float]},
        ["vec_id"],
        n=e.len(),
        s=e.sum(),
        m=e.mean(),
        lo=e.min(),
        hi=e.max(),
        first=e.at(0),
        last=e.at(-1),
        out=e.at(100_000),
        pos=e.filter("x", x > 0.0).list.len(),
        twice=e.map("x", x * 2).list.sum(),
        some=e.map("x", x > 0.0).list.any(),
        every=e.map("x", x > -9.0).list.all(),
        has=e.map("x", x > 0.0).list.contains(True),
        nulls=e.hasnull(),
    )
    return _rounded(out, "s", "m", "twice")


@struct
class Point:
    kind: str
    size: float


@query("""SELECT event_id, event_type AS kind, value AS size, 3 AS n_rep, 2 AS n_zip, event_type AS z0 FROM events""")
def expr_struct(spark, sf_dir):
    p = Point.expr(kind=col("event_type"), size=col("value"))
    zipped = Point.zip(kind=repeat(col("event_type"), 3), size=repeat(col("value"), 2))
    return evaluated(frames(spark, sf_dir)(Events), Events.schema.fields, ["event_id"], kind=p.struct.kind, size=p.struct.get("size"), n_rep=repeat(col("value"), 3).list.len(), n_zip=zipped.list.len(), z0=zipped.list.at(0).struct.kind)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS txt, CAST(NULL AS VARCHAR) AS none, CAST(json_extract(props, '$.k') AS BIGINT) AS via, -1 AS other, 1 AS n, true AS has FROM events""")
def expr_json_dict(spark, sf_dir):
    parsed = col("props").str.parse(dict[str, int])
    return evaluated(
        frames(spark, sf_dir)(Events),
        Events.schema.fields,
        ["event_id"],
        k=parsed.dict.get("k"),
        txt=col("props").str.json_extract("$.k"),
        none=col("props").str.json_extract("$.absent"),
        via=col("props").str.json_extract("$.k").fillnull("0").str.parse(int),
        other=parsed.dict.get("absent", -1),
        n=parsed.dict.len(),
        has=parsed.dict.contains("k"),
    )


# -- reading ---------------------------------------------------------------------------------------------------


@dataset(index=True)
class Spend:
    user_id: int = field(key=True)
    n: int
    total: float
    ts: datetime = field(timestamp=True)

    from lodestream.plans.dataset import pipeline as _pipeline

    @_pipeline
    @inputs(Events)
    def made(cls, events):
        w = {"window": Continuous("2d")}
        return events.filter(col("event_type") == "purchase").groupby("user_id").aggregate(n=agg.Count(**w), total=agg.Sum("value", **w))


_SPEND_SQL = f"""count(p.us) AS n, round(coalesce(sum(p.value), 0), 4) AS total
FROM q LEFT JOIN (SELECT user_id, value, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') p ON p.user_id = q.user_id AND p.us <= q.us AND p.us > q.us - {2 * DAY + 1_000_000} GROUP BY"""


@query(f"WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup') SELECT q.event_id, q.user_id, {_SPEND_SQL} q.event_id, q.user_id")
def lookup_asof(spark, sf_dir):
    """What was spent in the two days before each signup, with zeros where nothing was."""
    from lodestream.features.extractors import lookup_join

    frame = frames(spark, sf_dir)
    asked = frame(Events).where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias(AT))
    out = lookup_join(asked, frame(Spend), Spend, ["user_id"], AT, {"n": "n", "total": "total"})
    return out.select("event_id", "user_id", "n", F.round("total", 4).alias("total"))


@featureset
class Request:
    event_id: int
    user_id: int
    partners: list[int]


@featureset
class UserFeatures:
    user_id: int = feature(Request.user_id)
    n: int = feature(Spend.n, default=0)
    total: float = feature(Spend.total, default=0.0)
    paid: Optional[float] = feature(LastPurchase.paid)
    rich: bool = feature((col("total") > 60.0) & (col("n") > 0))
    hour: int = feature(now().dt.hour)
    label: str

    @extractor(deps=[LastPurchase])
    @inputs("user_id", "n")
    @outputs("label")
    def labelled(cls, ts: pd.Series, user_id: pd.Series, n: pd.Series) -> pd.Series:
        values, found = LastPurchase.lookup(ts, user_id=user_id, fields=["purchase_id"])
        return pd.Series([f"{int(p)}/{k}" if f else "none" for p, f, k in zip(values["purchase_id"], found, n, strict=True)])


@featureset
class PartnerFeatures:
    user_id: list[int] = feature(Request.partners)
    paid: list[Optional[float]] = feature(LastPurchase.paid)


_FEATURESETS = {"Request": Request, "UserFeatures": UserFeatures, "PartnerFeatures": PartnerFeatures}


def _features(spark, sf_dir, wanted: list[str]) -> DataFrame:
    frame = frames(spark, sf_dir)
    asked = frame(Events).where("event_type = 'signup'")
    partners = F.array(F.col("user_id"), F.col("user_id") + 1)
    df = asked.select(F.col("event_id").alias("Request.event_id"), F.col("user_id").alias("Request.user_id"), partners.alias("Request.partners"), F.col("ts").alias(AT))
    out = run(df, extractor_order(_FEATURESETS, wanted, {"Request.event_id", "Request.user_id", "Request.partners"}), _FEATURESETS, frame)
    return out.select(F.col("`Request.event_id`").alias("event_id"), *(F.col(f"`{w}`").alias(w.split(".")[1]) for w in wanted))


_ASKED = "q AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us FROM events WHERE event_type = 'signup')"


@query(f"""WITH {_ASKED}, s AS (SELECT q.event_id, q.us, q.user_id, {_SPEND_SQL} q.event_id, q.us, q.user_id),
l AS (SELECT q.event_id, p.paid FROM q ASOF LEFT JOIN {_PURCHASES} p ON q.user_id = p.user_id AND q.ts >= p.bought)
SELECT event_id, user_id, n, total, paid, total > 60 AND n > 0 AS rich, us // {HOUR} % 24 AS hour FROM s JOIN l USING (event_id)""")
def features_offline(spark, sf_dir):
    out = _features(spark, sf_dir, [f"UserFeatures.{n}" for n in ("user_id", "n", "total", "paid", "rich", "hour")])
    return out.withColumn("total", F.round("total", 4))


@query(f"""WITH {_ASKED}, s AS (SELECT q.event_id, {_SPEND_SQL} q.event_id),
l AS (SELECT q.event_id, p.purchase_id FROM q ASOF LEFT JOIN {_PURCHASES} p ON q.user_id = p.user_id AND q.ts >= p.bought)
SELECT event_id, CASE WHEN purchase_id IS NULL THEN 'none' ELSE purchase_id || '/' || n END AS label FROM s JOIN l USING (event_id)""")
def features_python(spark, sf_dir):
    return _features(spark, sf_dir, ["UserFeatures.label"])


@query(f"""WITH {_ASKED}, a AS (SELECT q.event_id, p.paid FROM q ASOF LEFT JOIN {_PURCHASES} p ON q.user_id = p.user_id AND q.ts >= p.bought),
b AS (SELECT r.event_id, p.paid FROM (SELECT event_id, ts, user_id + 1 AS user_id FROM q) r ASOF LEFT JOIN {_PURCHASES} p ON r.user_id = p.user_id AND r.ts >= p.bought)
SELECT a.event_id, a.paid AS own, b.paid AS next FROM a JOIN b USING (event_id)""")
def features_list_lookup(spark, sf_dir):
    out = _features(spark, sf_dir, ["PartnerFeatures.paid"])
    return out.select("event_id", F.get("paid", F.lit(0)).alias("own"), F.get("paid", F.lit(1)).alias("next"))


# -- sources, sinks, quality -----------------------------------------------------------------------------------

_RAW = cn.Webhook("raw")


@query("SELECT event_id, epoch_us(ts) AS ts, user_id * 10 AS user_id, 'purchase' AS event_type, value, 'fixed' AS props FROM events WHERE event_type = 'purchase' AND value < 40")
def source_preproc_where(spark, sf_dir):
    @dataset
    class Ten:
        event_id: int
        ts: datetime = field(timestamp=True)
        user_id: int
        event_type: t.oneof(str, ["purchase"])
        value: t.between(float, 0, 40)
        props: str

    s = cn.Source(
        _RAW.endpoint("e"),
        "1d",
        "append",
        preproc={"user_id": cn.eval_((col("uid") * 10).astype(int), {"uid": int}), "props": "fixed", "event_type": cn.ref("kind")},
        where=cn.eval_((col("kind") == "purchase") & (col("value") < 40.0), {"kind": str, "value": float}),
    )
    raw = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "uid", "event_type": "kind"}).drop("props")
    return shown(cn.ingest(raw, Ten, s))


@query(f"SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events WHERE ('0x' || md5(user_id || chr(31) || event_type)[:15])::BIGINT < {2**58}")
def source_sample(spark, sf_dir):
    return shown(temporal.hash_sample(frames(spark, sf_dir)(Events), 0.25, ["user_id", "event_type"]))


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events WHERE value >= 5 AND value <= 60")
def source_constraints(spark, sf_dir):
    @dataset
    class Narrow:
        event_id: int
        ts: datetime = field(timestamp=True)
        user_id: int
        event_type: t.regex("^[a-z]+$")
        value: t.between(float, 5, 60)
        props: Optional[str]

    return shown(cn.conform(table(spark, sf_dir, "events"), Narrow, on_error="drop"))


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def source_time_bounds(spark, sf_dir):
    s = cn.Source(_RAW.endpoint("e"), "1d", "append", since=datetime(2024, 1, 5), until=datetime(2024, 1, 20))
    return shown(cn.ingest(table(spark, sf_dir, "events"), Events, s))


@query("""SELECT user_id, event_id, paid, ms AS ts_ms, op FROM (SELECT user_id, event_id, value AS paid, epoch_us(ts) // 1000 AS ms, 'c' AS op FROM events WHERE event_type = 'purchase'
UNION ALL SELECT user_id, event_id, value, epoch_us(nx) // 1000, 'd' FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events WHERE event_type = 'purchase') WHERE nx IS NOT NULL)""")
def sink_debezium(spark, sf_dir):
    """Change records of each user's last purchase, decoded again; all of it from the records."""
    records = sinks.debezium(frames(spark, sf_dir)(LastPurchase), LastPurchase)
    row = "struct<user_id: bigint, paid: double, purchase_id: bigint, bought: bigint>"
    got = records.select(F.from_json("value", f"before {row}, after {row}, op string, ts_ms bigint").alias("r")).select(F.coalesce("r.after", "r.before").alias("x"), "r.op", "r.ts_ms")
    return got.select("x.user_id", F.col("x.purchase_id").alias("event_id"), "x.paid", "ts_ms", "op")


@query("""SELECT unnest(['not_null', 'in_set', 'between', 'pair_greater', 'type', 'length_equal']) AS name,
unnest([count(*), count(*), count(*), count(*), count(*), count(*)]) AS n_rows,
unnest([count(l_quantity), count(*) FILTER (l_returnflag IN ('A', 'R')), count(*) FILTER (l_quantity BETWEEN 5 AND 40), count(*) FILTER (l_extendedprice > l_quantity), count(*), count(*) FILTER (length(l_linestatus) = 1)]) AS n_ok,
unnest([count(l_quantity) = count(*), count(*) FILTER (l_returnflag IN ('A', 'R')) >= 0.9 * count(*), count(*) FILTER (l_quantity BETWEEN 5 AND 40) >= 0.5 * count(*), count(*) FILTER (l_extendedprice > l_quantity) = count(*), true, count(*) FILTER (length(l_linestatus) = 1) = count(*)]) AS success FROM lineitem""")
def expectations_report(spark, sf_dir):
    suite = [
        ex.expect_column_values_to_not_be_null("l_quantity"),
        ex.expect_column_values_to_be_in_set("l_returnflag", ["A", "R"], mostly=0.9),
        ex.expect_column_values_to_be_between("l_quantity", 5, 40, mostly=0.5),
        ex.expect_column_pair_values_A_to_be_greater_than_B("l_extendedprice", "l_quantity"),
        ex.expect_column_values_to_be_of_type("l_quantity", float),
        ex.expect_column_value_lengths_to_equal("l_linestatus", 1),
    ]
    return ex.report(table(spark, sf_dir, "lineitem"), suite).select("name", "n_rows", "n_ok", "success")


_ = (index, lit)
