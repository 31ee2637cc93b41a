import json

import pytest

from lodestream.operators.shredding import Shredder, assemble, nested, parse_json, shred
from lodestream.plans.problems import reports_of

SCHEMA = nested({"name": None, "links": {"back": None}, "lists": [{"code": None, "items": [{"id": None, "tags": [{"t": None}]}]}]})


def levels(records):
    s = Shredder(SCHEMA)
    for r in records:
        s.add(r)
    return s.columns


def test_levels():
    got = levels([{"name": "x", "lists": [{"code": "a", "items": [{"id": 1, "tags": [{"t": "p"}, {"t": None}]}, {"id": 2}]}, {"code": None}]}, {}])
    assert got["name"] == ([0, 0], [1, 0], ["x", None])
    assert got["lists.code"] == ([0, 1, 0], [2, 1, 0], ["a", None, None])
    assert got["lists.items.id"] == ([0, 2, 1, 0], [3, 3, 1, 0], ["1", "2", None, None])
    assert got["lists.items.tags.t"] == ([0, 3, 2, 1, 0], [4, 3, 2, 1, 0], ["p", None, None, None, None])


def frame(spark, payloads):
    return spark.createDataFrame([(i, p, "z") for i, p in enumerate(payloads)], "n int, payload string, levels string")


def table(spark, payloads, ancestor, leaves, **how):
    got = shred(frame(spark, payloads), "payload", SCHEMA, keep=["n"])
    return [tuple(r) for r in assemble(got, SCHEMA, ancestor, leaves, keep=["n"], **how).collect()]


def test_tables_keep_parent_links(spark):
    record = {"name": "x", "lists": [{"code": "a", "items": [{"id": 1, "tags": [{"t": "p"}, {"t": "q"}]}, {"id": 2}]}, {"code": "b", "items": {"id": 3, "tags": {"t": "r"}}}, {"code": "c", "items": []}]}
    payloads = [json.dumps(record), json.dumps({"lists": None}), None, "", '{"lists": [', "7", json.dumps([record, {"lists": [{"items": [{"id": 9}]}]}])]
    assert table(spark, payloads[:1], "lists", ["lists.code"]) == [(0, "a", 0), (0, "b", 1), (0, "c", 2)]
    assert table(spark, payloads[:1], "lists.items", ["lists.code", "lists.items.id"]) == [(0, "a", "1", 0, 0), (0, "a", "2", 0, 1), (0, "b", "3", 1, 0)]
    tags = table(spark, payloads, "lists.items.tags", ["lists.items.id", "lists.items.tags.t"], outer=True)
    one = [("1", "p", 0, 0, 0), ("1", "q", 0, 0, 1), ("2", None, 0, 1, -1), ("3", "r", 1, 0, 0), (None, None, 2, -1, -1)]
    assert tags == [(0, *r) for r in one] + [(6, *r) for r in one] + [(6, "9", None, 0, 0, -1)]


def test_many_records_over_batches(spark):
    payloads = [json.dumps({"lists": [{"code": str(i), "items": [{"id": j} for j in range(i % 4)]}]}) for i in range(2500)]
    got = table(spark, payloads, "lists.items", ["lists.code", "lists.items.id"])
    assert sorted(got) == sorted((i, str(i), str(j), 0, j) for i in range(2500) for j in range(i % 4))


def test_wrong_shapes_long_values_and_clashing_fields(spark):
    long = "é" * 200_000
    payloads = [json.dumps(x) for x in ({"lists": 5}, {"lists": [5, None, {"code": {"deep": 1}, "payload": 1}]}, {"lists": [{"code": long}]}, {"name": 1, "lists": {"code": True}})]
    assert table(spark, payloads, "lists", ["lists.code"]) == [(1, '{"deep":1}', 0), (2, long, 0), (3, "true", 0)]
    assert table(spark, [], "lists", ["lists.code"]) == []


def test_errors(spark):
    got = shred(frame(spark, []), "payload", SCHEMA)
    with pytest.raises(ValueError):
        assemble(got, SCHEMA, "links", ["links.back"])
    with pytest.raises(ValueError):
        assemble(got, SCHEMA, "lists", ["lists.items.id"])


def test_reports_of_deliveries():
    r = {"report": {"report_id": "a"}}
    assert reports_of(r) == [{"report": [{"report_id": "a"}]}] == reports_of({"report": json.dumps(r["report"])}) == reports_of([r])
    assert reports_of(None) == reports_of({}) == reports_of({"report": None}) == reports_of({"report": "{"}) == reports_of(5) == []
    assert parse_json(json.dumps(json.dumps({"a": 1}))) == {"a": 1} and parse_json('{"a": 1') is None and parse_json(None) is None


def test_transactions_with_all_their_leaves(spark):
    import json

    from lodestream.plans.problems import p4_transactions
    from lodestream.runtime import shared_path

    full = {"transaction_id": "t", "account_id": "a", "amount": 1.5, "date": "d", "date_posted": "p", "merchant_name": "m", "original_description": "o", "pending": True, "iso_currency_code": "USD"}
    full |= {"credit_category": {"primary": "x", "detailed": "y"}, "location": {"city": "c", "store_number": "7", "lat": 1.25, "lon": 2.5}}
    transactions = [full, {"amount": 2, "pending": True}, {"amount": 2, "pending": False}, {"amount": 2, "pending": False}, full]
    report = {"report": {"report_id": "r", "items": [{"item_id": "i", "accounts": []}, {"item_id": "j", "accounts": [{"transactions": transactions}]}]}}
    path = shared_path(spark, "mini")
    spark.createDataFrame([("d1", json.dumps(report)), ("d2", json.dumps([report, report]))], "request_id string, payload string").write.parquet(f"{path}/mini.parquet")
    rows = sorted(p4_transactions(spark, path).collect(), key=lambda r: (r.request_id, r.report_no, r.transactions_no))
    # a row for each, linked by delivery and positions, whether it has an id or not
    places = [(d, n, 1, 0, k) for d, n in (("d1", 0), ("d2", 0), ("d2", 1)) for k in range(5)]
    assert [(r.request_id, r.report_no, r.items_no, r.accounts_no, r.transactions_no) for r in rows] == places
    assert [r.transactions_pending for r in rows[:5]] == ["true", "true", "false", "false", "true"]
    assert list(rows[0])[1:18] == ["r", "j", "t", "a", "1.5", "d", "p", "m", "o", "true", "USD", "x", "y", "c", "7", "1.25", "2.5"]


def test_halves_of_characters_and_numbers_that_are_not_json(spark):
    schema = nested({"a": [{"b": None}]})
    payloads = ['{"a": [{"b": "x\\ud800y"}, {"b": "\\ud83d\\ude00"}]}', '{"a": [{"b": NaN}]}', '{"a": [{"b": -Infinity}]}', '{"a": [{"b": 1}]} x']
    levels = shred(spark.createDataFrame([(p,) for p in payloads], "payload string"), "payload", schema)
    assert [(r.a_no, r.a_b) for r in assemble(levels, schema, "a", ["a.b"]).collect()] == [(0, "x\ufffdy"), (1, "\U0001f600")]
