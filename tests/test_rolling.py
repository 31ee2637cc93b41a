import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators.rolling import daily_totals, trailing_totals

DAY = 86_400


def brute(daily, windows):
    out = {}
    for who in {w for w, _ in daily}:
        days = [d for w, d in daily if w == who]
        for d in range(min(days), max(days) + 1):
            out[who, d] = tuple((sum(daily.get((who, x), (0, 0))[i] for x in range(d - w + 1, d + 1))) for w in windows for i in (0, 1))
    return out


def check(spark, rows, windows):
    df = spark.createDataFrame(rows, "id bigint, who string, day int, amount bigint").select(
        "id", "who", (F.col("day") * DAY).cast("timestamp").alias("t"), "amount", F.lit(9).alias("total"), F.lit("y").alias("_record"), F.lit(1).alias("entity_id")
    )
    daily = daily_totals(df, "who", "t", F.col("amount"), "id")
    got = trailing_totals(daily, windows).collect()
    counted = {}
    seen = set()
    for i, who, day, amount in rows:
        if None in (i, who, day, amount) or i in seen:
            continue
        seen.add(i)
        a, n = counted.get((who, day), (0, 0))
        counted[who, day] = (a + amount, n + 1)
    want = brute(counted, windows)
    assert {(r.entity_id, r.day): tuple(r[f"{c}_{w}d"] for w in windows for c in ("total", "n")) for r in got} == want
    assert len(got) == len(want)
    for r in got:
        for w in windows:
            assert r[f"avg_{w}d"] == r[f"total_{w}d"] / w
            assert (r[f"avg_record_{w}d"] is None) == (r[f"n_{w}d"] == 0)


def test_random_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, str(rng.integers(4)), int(rng.integers(-40, 90)), int(rng.integers(-500, 500))) for i in range(150)]
    rows += [(1000 + i, "hot", i // 50, 1) for i in range(3000)] + [(5000, "one", 3, 7)]
    check(spark, rows, [7, 30])
    check(spark, rows, [1, 2, 5])


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a", 0, 5), (1, "a", 0, 5), (2, None, 0, 5), (3, "a", None, 5), (4, "a", 2, None), (None, "a", 1, 5), (5, "a", 9, -5), (6, "b", 1, 0)]
    check(spark, rows, [7, 30])
    check(spark, [], [7])


def test_records_that_differ_count_once_by_the_least(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2025, 1, 2), 7), (1, "a", dt.datetime(2025, 1, 1), 9)], "id int, who string, t timestamp, amount int")
    assert [(r.day, r.total) for r in daily_totals(df, "who", "t", F.col("amount"), "id").collect()] == [(20089, 9)]
