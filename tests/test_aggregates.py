"""Aggregates against brute force, with a key that has half of all rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestream import types as t
from lodestream.operators import aggregates as agg

SECOND, HOUR = 1_000_000, 3_600_000_000
TYPES = {"k": t.Int, "v": t.optional(t.Float), "id": t.Int}


def sample(n: int, span: int, seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    times = [rng.randrange(span) for _ in range(n // 2)]
    return [(0 if i % 2 else rng.randrange(1, 4), rng.choice(times), rng.choice([None, 1.0, 2.5, -3.0, 7.0, 1e12]) if i % 3 else 1.0, i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, us bigint, v double, id bigint").select("k", F.timestamp_micros("us").alias("ts"), "v", "id")


def live(rows, k, at, window_us):
    return [r for r in rows if r[0] == k and r[1] <= at and (window_us is None or at < r[1] + window_us + SECOND)]


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-3)  # 1e12 comes and goes in doubles


@pytest.mark.parametrize("half_life", ["1s", "30m", "2d", "1000d"])
@pytest.mark.parametrize("window", ["forever", "6h"])
def test_decaying_sums_have_no_horizon(spark, half_life, window):
    rows = sample(120, 90 * HOUR)
    w = t.Continuous(window)
    s = agg.ExpDecaySum("v", w, "heat", half_life=half_life)
    got = agg.aggregate(frame(spark, rows), ["k"], "ts", [s], TYPES, ["id"]).select("k", F.unix_micros("ts").alias("us"), "heat").collect()
    assert len({(r.k, r.us) for r in got}) == len(got) > 0
    for r in got:
        want = sum(x[2] * math.exp(-(r.us - x[1]) / SECOND * s.rate) for x in live(rows, r.k, r.us, w.us) if x[2] is not None)
        assert close(r.heat, want), (r, want)


def test_a_great_value_counts_after_forty_half_lives(spark):
    df = frame(spark, [(1, 0, 1e12, 1), (2, 0, -1e12, 2), (3, 0, 1.0, 3)])
    points = spark.createDataFrame([(k, 40 * HOUR) for k in (1, 2, 3, 4)], "k bigint, us bigint").select("k", F.timestamp_micros("us").alias("ts"))
    got = agg.aggregate_asof(df, ["k"], "ts", [agg.ExpDecaySum("v", into_field="heat", half_life="1h")], TYPES, points, "ts")
    found = {r.k: r.heat for r in got.collect()}
    assert found[1] == pytest.approx(1e12 / 2**40) and found[2] == pytest.approx(-1e12 / 2**40) and found[3] == 0.0 and found[4] == 0.0


@pytest.mark.parametrize("window", ["forever", "6h"])
def test_unique_counts_are_run_up(spark, window):
    rows = sample(160, 40 * HOUR)
    w = t.Continuous(window)
    specs = [agg.Count("v", w, "n", unique=True, approx=True), agg.Count("v", w, "known", unique=True, approx=True, dropnull=True), agg.Count("", w, "rows")]
    specs[2] = agg.Count(None, w, "rows")
    df = agg.aggregate(frame(spark, rows), ["k"], "ts", specs, TYPES, ["id"])
    for r in df.select("k", F.unix_micros("ts").alias("us"), "n", "known", "rows").collect():
        alive = [x[2] for x in live(rows, r.k, r.us, w.us)]
        assert (r.n, r.known, r.rows) == (len(set(alive)), len(set(alive) - {None}), len(alive))


def test_hopping_windows_are_put_together_from_panes(spark):
    rows = sample(200, 30 * HOUR)
    w = t.Hopping("5h", "2h")  # no multiple of its stride
    specs = [
        agg.Count(None, w, "n"), agg.Sum("v", w, "total"), agg.Average("v", w, "mean"), agg.Min("v", w, "low", default=0.0), agg.Max("v", w, "high", default=0.0),
        agg.Stddev("id", w, "dev"), agg.Quantile("v", w, "median", p=0.5, default=-1.0), agg.Distinct("id", w, "kinds", unordered=True), agg.LastK("id", w, "last", limit=2),
        agg.FirstK("id", w, "first", limit=2), agg.Count("id", w, "unique", unique=True, approx=True), agg.ExpDecaySum("v", w, "heat", half_life="1h"),
    ]
    df = agg.aggregate(frame(spark, rows), ["k"], "ts", specs, TYPES, ["id"])
    seen = 0
    for r in df.select("k", F.unix_micros("ts").alias("us"), *(s.into_field for s in specs)).collect():
        inside = sorted((x for x in rows if x[0] == r.k and r.us - w.us <= x[1] < r.us), key=lambda x: (x[1], x[3]))
        values = [x[2] for x in inside if x[2] is not None]
        ids = [x[3] for x in inside]
        assert (r.n, r.low, r.high) == (len(inside), min(values, default=0.0), max(values, default=0.0)) and close(r.total, sum(values))
        assert close(r["mean"], sum(values) / len(values) if values else 0.0)
        assert r.median == (sorted(values)[min(len(values) - 1, int(0.5 * len(values)))] if values else -1.0)
        assert r["last"] == ids[::-1][:2] and r["first"] == ids[:2] and r.unique == len(ids) and set(r.kinds) == set(ids)
        if ids:
            assert r.dev == pytest.approx(math.sqrt(sum((i - sum(ids) / len(ids)) ** 2 for i in ids) / len(ids)))
        assert close(r.heat, sum(x[2] * 2.0 ** (-(r.us - x[1]) / HOUR) for x in inside if x[2] is not None))
        seen += bool(inside)
    assert seen > 20


def test_no_key_is_ordered_as_a_whole(spark):
    rows = frame(spark, sample(400, 2000 * HOUR))
    w = {"window": t.Continuous("1d")}
    makers = {
        "continuous": [agg.Count(None, into_field="n", **w), agg.Sum("v", into_field="s", **w), agg.Min("v", into_field="low", default=0.0, **w), agg.Count("v", into_field="u", unique=True, approx=True, **w)],
        "decay": [agg.ExpDecaySum("v", into_field="h", half_life="1h")],
        "session": [agg.Count(None, t.Session("1h"), "n")],
        "hopping": [agg.Count(None, t.Hopping("1d", "6h"), "n")],
    }
    for name, specs in makers.items():
        plan = agg.aggregate(rows, ["k"], "ts", specs, TYPES, ["id"])._jdf.queryExecution().optimizedPlan().toString()
        found = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan)
        assert found
        for spec in found:
            columns = re.findall(r"(_\w+)#", spec)
            # within a bucket of a key; or over one row per bucket, or per stretch of a hundred mean lives
            assert set(columns) & {"_b", "_nb", "_n"}, (name, spec)
    # the crowded key's rows lie in many groups
    assert agg.aggregate(rows, ["k"], "ts", makers["continuous"], TYPES, ["id"]).where("k = 0").select(F.window("ts", "1 day")).distinct().count() > 50
