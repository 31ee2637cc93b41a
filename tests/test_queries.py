"""Every registered query of the core over the smallest tables, against its SQL or a plain reading."""

import json

import pytest

from lodestream.plans import catalog, problems, streams, workflows
from tests.queries import SF_DIR, check, connection

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no tables here")
QUERIES = {n: (q, m.ORACLE_SQL.get(n)) for m in (problems, catalog, streams, workflows) for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connection()


#: Run by tools/compare.py only: several micro-batches each, like those that are run here.
LONG = {"stream_pipeline_continuous", "stream_pipeline_dedup", "stream_pipeline_join"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, con, name):
    check(spark, con, *QUERIES[name])


def test_nested_reports_against_a_plain_reading(spark, con):
    def listed(x):
        return [] if x is None else x if isinstance(x, list) else [x]

    def parsed(x):
        while isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return None
        return x

    want = set()
    for (payload,) in con.execute("SELECT payload FROM mini").fetchall():
        for delivery in listed(parsed(payload)):
            report = parsed(delivery.get("report")) if isinstance(delivery, dict) else None
            for item in listed(report.get("items")) if isinstance(report, dict) else []:
                accounts = listed(item.get("accounts"))
                if not accounts:
                    want.add((report["report_id"], item["item_id"], -1, ""))
                for n, account in enumerate(accounts):
                    ids = [x["transaction_id"] for x in listed(account.get("transactions"))] or [""]
                    want |= {(report["report_id"], item["item_id"], n, i) for i in ids}
    got = {tuple(r) for r in problems.p4_found(spark, str(SF_DIR)).select("report_id", "item_id", "account_no", "transaction_id").collect()}
    assert got == want and len(want) > 20
