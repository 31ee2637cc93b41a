import numpy as np
from pyspark.sql import functions as F

from lodestream.operators.known_at import known_at

SEC = 1_000_000


def brute(events, changes):
    firsts = {}
    for c, e, valid, known in changes:
        if None in (c, e, valid, known):
            continue
        if (e, c) not in firsts or (known, -valid) < (firsts[e, c][1], -firsts[e, c][0]):
            firsts[e, c] = (valid, known)
    out = []
    for i, e, t in events:
        best = max(((v, c) for (x, c), (v, k) in firsts.items() if x == e and t is not None and v <= t and k <= t), default=None)
        if e is not None and best:
            out.append((i, best[1]))
    return sorted(out)


def check(spark, events, changes, **how):
    e = spark.createDataFrame(events, "id bigint, entity string, t bigint").select("id", "entity", F.timestamp_micros("t").alias("t"), F.lit(1).alias("_at"), F.lit(2).alias("driver"))
    c = spark.createDataFrame(changes, "c bigint, entity string, v bigint, k bigint").select("c", "entity", F.timestamp_micros("v").alias("v"), F.timestamp_micros("k").alias("k"), F.lit(None).cast("int").alias("driver"), F.lit(0).alias("_rank"))
    got = known_at(e, c, "entity", "t", "entity", "v", "c", "k", ["driver"], ["id", "driver"], **how)
    assert got.columns == ["id", "driver", "c", "driver_known"]
    rows = got.collect()
    assert all(r.driver == 2 and r.driver_known is None for r in rows)
    return sorted((r.id, r.c) for r in rows)


def test_random_against_brute_force_in_any_buckets(spark):
    rng = np.random.default_rng(7)
    events = [(i, str(rng.integers(4)), int(rng.integers(0, 400)) * SEC) for i in range(150)] + [(150, "hot", i * SEC) for i in range(300)]
    changes = []
    for i in range(120):
        v = int(rng.integers(0, 300))
        changes.append((i, str(rng.integers(5)), v * SEC, (v + int(rng.integers(-5, 60))) * SEC))
    changes += [(1000 + i, "hot", i * SEC, i * SEC + int(rng.integers(0, 3)) * SEC) for i in range(300)]
    changes += changes[:40]
    want = brute(events, changes)
    for bucket in (SEC, 7 * SEC, 10_000 * SEC):
        assert check(spark, events, changes, bucket_us=bucket) == want


def test_ties_receipts_and_nulls(spark):
    events = [(1, "a", 10), (2, "a", 9), (3, None, 10), (4, "a", None), (5, "b", 10), (1, "a", 10), (6, "a", 4)]
    changes = [(1, "a", 5, 5), (2, "a", 5, 5), (3, "a", 10, 10), (4, "a", 8, 20), (5, "a", None, 3), (6, None, 3, 3), (7, "b", 3, None), (2, "a", 5, 30), (None, "a", 6, 6)]
    assert check(spark, events, changes) == brute(events, changes) == [(1, 3), (1, 3), (2, 2)]


def test_empty_and_left(spark):
    assert check(spark, [], [(1, "a", 1, 1)]) == []
    assert check(spark, [(1, "a", 1)], []) == []
    e = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "id bigint, entity string, t bigint").select("id", "entity", F.timestamp_micros("t").alias("t"))
    c = spark.createDataFrame([], "c bigint, entity string, v timestamp")
    got = known_at(e, c, "entity", "t", "entity", "v", "c", how="left").collect()
    assert sorted((r.id, r.c) for r in got) == [(1, None), (2, None)]
