"""Queries of the general data problems, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.operators.geo import last_positions, points_in_regions, points_near, rectangle, region_edges
from lodestream.operators.known_at import known_at
from lodestream.operators.rolling import daily_totals, trailing_totals
from lodestream.operators.sessions import sessionize
from lodestream.operators.shredding import assemble, nested, parse_json, shred, tree
from lodestream.runtime import table
from lodestream.streaming.entity_features import code, feature_rows, maintain_features

# -- 1: sessions -----------------------------------------------------------------------------------------------


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(
        table(spark, sf_dir, "page_views"),
        {"device": F.lower(F.trim("uuid")), "user": F.col("user_id").cast("string")},
        time="timestamp",
        distinct=["document_id"],
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_sessions(spark, sf_dir).where("n_events >= 2").select("entity_kind", "entity_id", "start_us", "end_us")


_SESSIONS_SQL = """
WITH views AS (
  SELECT DISTINCT entity_kind, entity_id, document_id, epoch_us(ts) AS us FROM (
    SELECT 'device' AS entity_kind, lower(trim(uuid)) AS entity_id, document_id, "timestamp" AS ts FROM page_views
    UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), document_id, "timestamp" FROM page_views)
  WHERE entity_id IS NOT NULL AND ts IS NOT NULL),
flagged AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh
  FROM views WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY us, document_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_kind, entity_id ORDER BY us, document_id) AS no FROM flagged),
sessions AS (SELECT entity_kind, entity_id, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us,
  count(*) AS n_events FROM numbered GROUP BY entity_kind, entity_id, no)
"""

# -- 2: features -----------------------------------------------------------------------------------------------

AS_OF_US = 1_751_328_000_000_000  # 2025-07-01
SINCE_US = 1_748_736_000_000_000  # 2025-06-01


def _payment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain_features(
        spark,
        f"{sf_dir}/payment_event.parquet",
        entity="customer_id",
        event_type=F.concat(code(F.col("result")), F.lit("|"), code(F.col("payment_method"))),
        time="created",
        as_of_us=AS_OF_US,
    )


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(_payment_features(spark, sf_dir)).select(F.col("entity").alias("customer_id"), "event_type", "n", "latest_us")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_features(spark, sf_dir).where(f"n >= 3 AND latest_us >= {SINCE_US}").select("customer_id", "event_type")


_CODE_SQL = r"coalesce(regexp_replace(regexp_replace(upper({}), '[\s_\-]+', '_', 'g'), '^_|_$', '', 'g'), 'NONE')"
_FEATURES_SQL = f"""
WITH events AS (SELECT DISTINCT customer_id, {_CODE_SQL.format("result")} || '|' || {_CODE_SQL.format("payment_method")} AS event_type,
  epoch_us(created) AS us FROM payment_event WHERE customer_id IS NOT NULL AND epoch_us(created) < {AS_OF_US}),
features AS (SELECT customer_id, event_type, count(*) AS n, max(us) AS latest_us FROM events GROUP BY ALL)
"""

# -- 3: attributes as known ------------------------------------------------------------------------------------


def _charges_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_at(
        table(spark, sf_dir, "charges"),
        table(spark, sf_dir, "reservation"),
        event_entity="reservation_id",
        event_time="created",
        change_entity="reservation_id",
        valid_from="created",
        change_id="change_id",
        known_from="received_at",
        attributes=["driver_id", "current_status", "vehicle_id"],
        event_columns=["charge_id"],
    )


def p3_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges_known(spark, sf_dir).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charges_known(spark, sf_dir).select("charge_id", "change_id").distinct()


_KNOWN_SQL = """
WITH firsts AS (SELECT change_id, reservation_id, min(received_at) AS received_at, arg_min(created, received_at) AS created,
  arg_min(row(driver_id, current_status, vehicle_id), received_at) AS a
  FROM reservation WHERE created IS NOT NULL AND received_at IS NOT NULL AND reservation_id IS NOT NULL GROUP BY change_id, reservation_id),
ranked AS (SELECT DISTINCT c.charge_id, r.change_id, r.a,
  row_number() OVER (PARTITION BY c.charge_id, c.created, c.reservation_id ORDER BY r.created DESC, r.change_id DESC) AS no
  FROM (SELECT DISTINCT charge_id, created, reservation_id FROM charges) c JOIN firsts r ON c.reservation_id = r.reservation_id AND r.created <= c.created AND r.received_at <= c.created)
"""

# -- 4: nested records -----------------------------------------------------------------------------------------

_TRANSACTION = {
    **dict.fromkeys(("transaction_id", "account_id", "amount", "date", "date_posted", "merchant_name", "original_description", "pending", "iso_currency_code")),
    "credit_category": dict.fromkeys(("primary", "detailed")),
    "location": dict.fromkeys(("city", "store_number", "lat", "lon")),
}
_ACCOUNT = {"type": None, "transactions": [_TRANSACTION]}
_ITEM = {**dict.fromkeys(("item_id", "institution_id", "institution_name", "date_last_updated")), "accounts": [_ACCOUNT]}
REPORT_SCHEMA = nested({"report": [{**dict.fromkeys(("report_id", "date_generated", "days_requested")), "items": [_ITEM]}]})
LINK_SCHEMA = nested({"report": [{"report_id": None, "items": [{"item_id": None, "accounts": [{"transactions": [{"transaction_id": None}]}]}]}]})


def reports_of(payload: object) -> list[dict]:
    """The reports a delivery holds, as one record: an object with a report, or a list of such; the report may be JSON in a string."""
    reports = []
    for part in payload if isinstance(payload, list) else [payload]:
        part = parse_json(part) if isinstance(part, str) else part
        if isinstance(part, dict):
            report = parse_json(part["report"]) if isinstance(part.get("report"), str) else part.get("report")
            reports += [r for r in (report if isinstance(report, list) else [report]) if isinstance(r, dict)]
    return [{"report": reports}] if reports else []


def _reports(spark: SparkSession, sf_dir: str, schema: StructType = REPORT_SCHEMA) -> DataFrame:
    return shred(table(spark, sf_dir, "mini"), "payload", schema, reports_of, ["request_id"])


def _table(spark: SparkSession, sf_dir: str, group: str, links: list[str], own: list[str]) -> DataFrame:
    """A row per element of a group: the delivery it came in, its position within each group above it, from the report's within the
    delivery on (links that hold for elements without id), the ids above it and its own leaves."""
    return assemble(_reports(spark, sf_dir), REPORT_SCHEMA, group, [*links, *own], ["request_id"])


_ITEM_LEAVES = ("item_id", "institution_id", "institution_name", "date_last_updated")


def p4_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "report", [], [f"report.{c}" for c in ("report_id", "date_generated", "days_requested")])


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "report.items", ["report.report_id"], [f"report.items.{c}" for c in _ITEM_LEAVES])


def p4_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "report.items.accounts", ["report.report_id", "report.items.item_id"], ["report.items.accounts.type"])


def p4_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = "report.items.accounts.transactions"
    own = [leaf.path for leaf in tree(REPORT_SCHEMA).leaves() if leaf.path.startswith(f"{group}.")]
    return _table(spark, sf_dir, group, ["report.report_id", "report.items.item_id"], own)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = "report.items.accounts.transactions"
    rows = assemble(
        _reports(spark, sf_dir, LINK_SCHEMA).drop("request_id"), LINK_SCHEMA, group, ["report.report_id", "report.items.item_id", f"{group}.transaction_id"], outer=True
    )
    return (
        rows.where("items_no >= 0 AND report_report_id IS NOT NULL AND items_item_id IS NOT NULL AND (transactions_no < 0 OR transactions_transaction_id IS NOT NULL)")
        .select(
            F.col("report_report_id").alias("report_id"),
            F.col("items_item_id").alias("item_id"),
            F.col("accounts_no").alias("account_no"),
            F.coalesce("transactions_transaction_id", F.lit("")).alias("transaction_id"),
        )
        .distinct()
    )


_ELEMENTS = "CASE json_type({0}) WHEN 'ARRAY' THEN list_filter(CAST({0} AS JSON[]), lambda x: json_type(x) = 'OBJECT') WHEN 'OBJECT' THEN [{0}] ELSE [] END"
_INNER = "CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid({0} ->> '$') THEN ({0} ->> '$')::JSON END ELSE {0} END"


def _leaf_sql(at: str, path: str) -> str:
    j = f"json_extract({at}, '$.{path}')"
    return f"CASE WHEN json_type({j}) = 'VARCHAR' THEN {j} ->> '$' WHEN json_type({j}) <> 'NULL' THEN {j}::VARCHAR END"


def _children_sql(table: str, parent: str, up: str, name: str, group: str, links: str, outer: bool = False) -> str:
    inner = _ELEMENTS.format(f"json_extract({up}, '$.{group}')")
    source = f"CASE WHEN len({inner}) > 0 THEN {inner} ELSE [NULL] END" if outer else inner
    return f"""{table} AS (SELECT {links}, unnest({source}) AS {name},
  {f"CASE WHEN len({inner}) > 0 THEN" if outer else ""} unnest(range(greatest(len({inner}), {1 if outer else 0}))) {"ELSE -1 END" if outer else ""} AS {group}_no FROM {parent})"""


def _nested_sql(outer: bool = False) -> str:
    keep = "request_id, report_no, r"
    return f"""
WITH texts AS (SELECT request_id, payload::JSON AS j FROM mini WHERE json_valid(payload)),
whole AS (SELECT request_id, {_INNER.format("j")} AS j FROM texts),
parts AS (SELECT request_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) AS p, unnest(range(CASE WHEN json_type(j) = 'ARRAY' THEN len(CAST(j AS JSON[])) ELSE 1 END)) AS k FROM whole),
objects AS (SELECT request_id, k, {_INNER.format("p")} AS p FROM parts),
bodies AS (SELECT request_id, k, {_INNER.format("json_extract(p, '$.report')")} AS b FROM objects WHERE json_type(p) = 'OBJECT'),
numbered AS (SELECT request_id, k, unnest({_ELEMENTS.format("b")}) AS r, unnest(range(len({_ELEMENTS.format("b")}))) AS n FROM bodies),
reports AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY k, n) - 1 AS report_no, r FROM numbered),
{_children_sql("items_in", "reports", "r", "i", "items", keep, outer)},
{_children_sql("accounts_in", "items_in", "i", "a", "accounts", keep + ", i, items_no", outer)},
{_children_sql("transactions_in", "accounts_in", "a", "t", "transactions", keep + ", i, items_no, a, accounts_no", outer)}
"""


def _leaves_sql(at: str, parent: str, paths: list[str]) -> str:
    return ", ".join(f"{_leaf_sql(at, p)} AS {'_'.join(f'{parent}.{p}'.split('.')[-2:])}" for p in paths)


_REPORT_ID = f"{_leaf_sql('r', 'report_id')} AS report_report_id"
_ITEM_ID = f"{_leaf_sql('i', 'item_id')} AS items_item_id"
_TRANSACTION_LEAVES = [leaf.path for leaf in tree(nested(_TRANSACTION)).leaves()]

# -- 6: near points and regions --------------------------------------------------------------------------------


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_positions(table(spark, sf_dir, "vehicle_summary"), "vehicle_id", "latitude", "longitude", "created")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_near(
        _vehicles(spark, sf_dir), "entity", "lat", "lon", table(spark, sf_dir, "rental_location"), "id", "latitude", "longitude", metres=500.0
    ).select(F.col("_point").alias("vehicle_id"), F.col("_place").alias("location_id"))


def p6_market_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.lit(0.005)
    cells = table(spark, sf_dir, "location_to_new_market_area").where("gid IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    regions = cells.select(F.struct("gid", "latitude", "longitude").alias("cell"), rectangle(F.col("latitude"), F.col("longitude"), half, half).alias("ring"))
    found = points_in_regions(_vehicles(spark, sf_dir), "entity", "lat", "lon", region_edges(regions, "cell", "ring"))
    return found.select(F.col("_point").alias("vehicle_id"), F.col("_region.gid").alias("gid")).distinct()


_VEHICLES_SQL = """
WITH v AS (SELECT vehicle_id, max(row(created, latitude, longitude)) AS p FROM vehicle_summary
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND created IS NOT NULL AND vehicle_id IS NOT NULL GROUP BY vehicle_id),
vehicles AS (SELECT vehicle_id, p[2] AS lat, p[3] AS lon FROM v)
"""

# -- 7: rolling totals -----------------------------------------------------------------------------------------


def _cents(column: str) -> Column:
    """Hundredths; null for NaN and infinities. Amounts beyond a bigint of hundredths raise."""
    c = F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), F.col(column))
    return F.when(F.abs(c * 100) >= F.lit(2.0**63), F.raise_error(F.lit(f"{column} is too large"))).otherwise(F.round(c * 100).cast("long"))


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = daily_totals(table(spark, sf_dir, "charges"), "customer", "created", _cents("amount"), "charge_id")
    cards = daily_totals(table(spark, sf_dir, "credit_card_transactions"), "cc_num", "trans_date_trans_time", _cents("amt"), "trans_num")
    daily = customers.withColumn("entity_kind", F.lit("customer")).unionByName(cards.withColumn("entity_kind", F.lit("card")))
    return trailing_totals(daily, [7, 30], ["entity_kind", "entity_id"]).withColumn("day_on", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd"))


def p7_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = ["total_7d", "n_7d", "total_30d", "n_30d"]
    return _trailing(spark, sf_dir).select("entity_kind", "entity_id", "day_on", *cents, *(F.round(c, 6).alias(c) for c in ("avg_7d", "avg_30d")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trailing(spark, sf_dir).where("total_7d >= 40000 AND total_30d >= 90000").select("entity_kind", "entity_id", "day_on")


def _rolling_sql() -> str:
    part = """SELECT DISTINCT ON ({id}) '{kind}' AS entity_kind, CAST({who} AS VARCHAR) AS entity_id, CAST({at} AS DATE) AS d,
      CAST(round({amount} * 100) AS BIGINT) AS cents FROM {table}
      WHERE {id} IS NOT NULL AND {who} IS NOT NULL AND {at} IS NOT NULL AND {amount} IS NOT NULL AND NOT isnan({amount})"""
    a = part.format(id="charge_id", kind="customer", who="customer", at="created", amount="amount", table="charges")
    b = part.format(id="trans_num", kind="card", who="cc_num", at="trans_date_trans_time", amount="amt", table="credit_card_transactions")
    return f"""
WITH rows_in AS ({a} UNION ALL {b}),
daily AS (SELECT entity_kind, entity_id, d, sum(cents)::BIGINT AS cents, count(*) AS n FROM rows_in GROUP BY ALL),
span AS (SELECT entity_kind, entity_id, min(d) AS a, max(d) AS b FROM daily GROUP BY ALL),
days AS (SELECT entity_kind, entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
dense AS (SELECT days.entity_kind, days.entity_id, days.d, coalesce(cents, 0) AS cents, coalesce(n, 0) AS n
  FROM days LEFT JOIN daily USING (entity_kind, entity_id, d)),
rolling AS (SELECT entity_kind, entity_id, strftime(d, '%Y-%m-%d') AS day_on,
  sum(cents) OVER w7 AS total_7d, sum(n) OVER w7 AS n_7d, sum(cents) OVER w30 AS total_30d, sum(n) OVER w30 AS n_30d FROM dense
  WINDOW w7 AS (PARTITION BY entity_kind, entity_id ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY entity_kind, entity_id ORDER BY d ROWS 29 PRECEDING))
"""


QUERIES = {
    "p1_found": p1_found,
    "p1_sessions": p1_sessions,
    "p2_found": p2_found,
    "p2_features": p2_features,
    "p3_found": p3_found,
    "p3_known": p3_known,
    "p4_found": p4_found,
    "p4_reports": p4_reports,
    "p4_items": p4_items,
    "p4_accounts": p4_accounts,
    "p4_transactions": p4_transactions,
    "p6_found": p6_found,
    "p6_market_area": p6_market_area,
    "p7_found": p7_found,
    "p7_rolling": p7_rolling,
}

ORACLE_SQL = {
    "p1_found": _SESSIONS_SQL + "SELECT entity_kind, entity_id, start_us, end_us FROM sessions WHERE n_events >= 2",
    "p1_sessions": _SESSIONS_SQL + "SELECT * FROM sessions",
    "p2_found": _FEATURES_SQL + f"SELECT customer_id, event_type FROM features WHERE n >= 3 AND latest_us >= {SINCE_US}",
    "p2_features": _FEATURES_SQL + "SELECT * FROM features",
    "p3_found": _KNOWN_SQL + "SELECT DISTINCT charge_id, change_id FROM ranked WHERE no = 1",
    "p3_known": _KNOWN_SQL + "SELECT DISTINCT charge_id, change_id, a[1] AS driver_id, a[2] AS current_status, a[3] AS vehicle_id FROM ranked WHERE no = 1",
    "p4_found": _nested_sql(True)
    + f"""SELECT DISTINCT report_id, item_id, accounts_no AS account_no, coalesce(transaction_id, '') AS transaction_id FROM
(SELECT {_leaf_sql("r", "report_id")} AS report_id, {_leaf_sql("i", "item_id")} AS item_id, accounts_no, transactions_no, {_leaf_sql("t", "transaction_id")} AS transaction_id, items_no FROM transactions_in)
WHERE items_no >= 0 AND report_id IS NOT NULL AND item_id IS NOT NULL AND (transactions_no < 0 OR transaction_id IS NOT NULL)""",
    "p4_reports": _nested_sql() + f"SELECT request_id, report_no, {_leaves_sql('r', 'report', ['report_id', 'date_generated', 'days_requested'])} FROM reports",
    "p4_items": _nested_sql() + f"SELECT request_id, report_no, items_no, {_REPORT_ID}, {_leaves_sql('i', 'items', list(_ITEM_LEAVES))} FROM items_in",
    "p4_accounts": _nested_sql() + f"SELECT request_id, report_no, items_no, accounts_no, {_REPORT_ID}, {_ITEM_ID}, {_leaves_sql('a', 'accounts', ['type'])} FROM accounts_in",
    "p4_transactions": _nested_sql()
    + f"SELECT request_id, report_no, items_no, accounts_no, transactions_no, {_REPORT_ID}, {_ITEM_ID}, {_leaves_sql('t', 'transactions', _TRANSACTION_LEAVES)} FROM transactions_in",
    "p6_found": _VEHICLES_SQL
    + """SELECT DISTINCT vehicle_id, id AS location_id FROM vehicles JOIN rental_location r ON abs(r.latitude - lat) < 0.0046 AND
2 * 6371008.8 * asin(sqrt(pow(sin(radians(r.latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(r.latitude)) * pow(sin(radians(r.longitude - lon) / 2), 2))) <= 500""",
    "p6_market_area": _VEHICLES_SQL
    + """SELECT DISTINCT vehicle_id, gid FROM vehicles JOIN location_to_new_market_area m ON lat >= round(m.latitude - 0.005, 7) AND lat < round(m.latitude + 0.005, 7)
AND lon >= round(m.longitude - 0.005, 7) AND lon < round(m.longitude + 0.005, 7) WHERE gid IS NOT NULL""",
    "p7_found": _rolling_sql() + "SELECT entity_kind, entity_id, day_on FROM rolling WHERE total_7d >= 40000 AND total_30d >= 90000",
    "p7_rolling": _rolling_sql()
    + """SELECT entity_kind, entity_id, day_on, total_7d::BIGINT AS total_7d, n_7d::BIGINT AS n_7d, total_30d::BIGINT AS total_30d, n_30d::BIGINT AS n_30d,
round(total_7d / 7.0::DOUBLE, 6) AS avg_7d, round(total_30d / 30.0::DOUBLE, 6) AS avg_30d FROM rolling""",
}
