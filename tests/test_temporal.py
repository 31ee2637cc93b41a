import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import temporal as tp
from lodestream.operators.temporal import VALID_TO


def timed(spark, rows, ddl, *times):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumns({c: F.timestamp_micros(F.col(c)) for c in times})


def micro(df, *times):
    return df.withColumns({c: F.unix_micros(c) for c in times})


#: Left valid in [1, 4), [6, 9), [10, ...), right in [2, 3), [5, 7), [8, 11), for two keys; times in days.
LEFT = [(k, n, f, z) for k, names in ((1, "ABC"), (2, "DEF")) for n, f, z in zip(names, (1, 6, 10), (4, 9, None))]
RIGHT = [(k, v, f, z) for k, values in ((1, "123"), (2, "456")) for v, f, z in zip(values, (2, 5, 8), (3, 7, 11))]
MET = {(1, "A", "1", 2, 3), (1, "B", "2", 6, 7), (1, "B", "3", 8, 9), (1, "C", "3", 10, 11), (2, "D", "4", 2, 3), (2, "E", "5", 6, 7), (2, "E", "6", 8, 9), (2, "F", "6", 10, 11)}
GAPS = {(k, n, None, f, z) for k, names in ((1, "ABBC"), (2, "DEEF")) for n, f, z in ()} | {
    (1, "A", None, 1, 2), (1, "A", None, 3, 4), (1, "B", None, 7, 8), (1, "C", None, 11, None), (2, "D", None, 1, 2), (2, "D", None, 3, 4), (2, "E", None, 7, 8), (2, "F", None, 11, None),
}


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_histories_joined_by_common_intervals(spark, how, overlapping):
    left = timed(spark, LEFT, f"id int, name string, ts bigint, {VALID_TO} bigint", "ts", VALID_TO)
    right = timed(spark, RIGHT, f"cust int, value string, ts bigint, {VALID_TO} bigint", "ts", VALID_TO)
    got = micro(tp.history_join(left, right, [("id", "cust")], "ts", "ts", {"value": "value"}, how, overlapping), "ts", VALID_TO).select("id", "name", "value", "ts", VALID_TO)
    assert {tuple(r) for r in got.collect()} == (MET | GAPS if how == "left" else MET)
    none = right.limit(0)
    rows = tp.history_join(left, none, [("id", "cust")], "ts", "ts", {"value": "value"}, how, overlapping).collect()
    assert len(rows) == (6 if how == "left" else 0)


def brute_histories(left, right, how):
    """Moment by moment."""
    out = set()
    for i, k, a, z in left:
        moments = [t for t in range(a, z)]
        at = {t: next((v for k2, v, f, e in right if k2 == k and f <= t < e), None) for t in moments}
        start = 0
        for n in range(1, len(moments) + 1):
            if n == len(moments) or at[moments[n]] != at[moments[start]]:
                if how == "left" or at[moments[start]] is not None:
                    out.add((i, at[moments[start]], moments[start], moments[n - 1] + 1))
                start = n
    return out


@pytest.mark.parametrize("how", ["inner", "left"])
def test_random_histories_against_brute_force(spark, how):
    rng = np.random.default_rng(17)

    def history(n, keys):
        rows, count = [], 0
        for k in range(keys):
            at = int(rng.integers(-20, 5))
            for _ in range(n):
                at += int(rng.integers(0, 6))
                end = at + int(rng.integers(1, 15))
                rows.append((count, k, at, end))
                at, count = end, count + 1
        return rows

    left, right = history(8, 4), history(10, 4)
    many = [(100 + i, k, a + s, z + s) for i, k, a, z in left for s in (0, 3)]
    many = [(n, *r[1:]) for n, r in enumerate(many)]
    b = timed(spark, [(k, f"v{i}", a, z) for i, k, a, z in right], f"k int, v string, ts bigint, {VALID_TO} bigint", "ts", VALID_TO)
    r = [(k, f"v{i}", a, z) for i, k, a, z in right]
    for rows, overlapping in ((left, False), (left, True), (many, True)):
        a = timed(spark, rows, f"i int, k int, ts bigint, {VALID_TO} bigint", "ts", VALID_TO)
        for bucket in (5, 10_000):
            got = micro(tp.history_join(a, b, [("k", "k")], "ts", "ts", {"v": "v"}, how, overlapping, bucket), "ts", VALID_TO)
            assert {(x.i, x.v, x.ts, x[VALID_TO]) for x in got.collect()} == brute_histories(rows, r, how)


def brute_asof(left, right, low, high):
    out = []
    for i, k, s in left:
        fits = [(s2, o, v) for k2, s2, o, v in right if None not in (k, s, k2, s2) and k2 == k and s2 <= s + high]
        best = max(fits, default=None, key=lambda r: (r[0], r[1]))
        out.append((i, best[2] if best and (low is None or best[0] >= s - low) else None))
    return sorted(out)


@pytest.mark.parametrize("low,high", [(None, 0), (50, 0), (20, 10), (0, 0)])
def test_asof_against_brute_force(spark, low, high):
    rng = np.random.default_rng(11)
    left = [(i, int(rng.integers(4)), int(rng.integers(-100, 300))) for i in range(120)] + [(500, None, 5), (501, 1, None), (502, 99, 5)]
    right = [(int(rng.integers(4)), int(rng.integers(-100, 300)), i, f"v{i}") for i in range(120)] + [(None, 5, 900, "x"), (1, None, 901, "y")]
    a = timed(spark, left, "i int, k int, ts bigint", "ts")
    b = timed(spark, right, "k int, ts bigint, o int, v string", "ts")
    for bucket in (7, 10_000):
        got = tp.asof_join(a, b, [("k", "k")], "ts", "ts", {"v": "v"}, low, high, order=["o"], bucket_us=bucket, found="hit").collect()
        assert sorted((r.i, r.v) for r in got) == brute_asof(left, right, low, high)
        assert all(r.hit == (r.v is not None) for r in got)
    inner = tp.asof_join(a, b, [("k", "k")], "ts", "ts", {"v": "v"}, low, high, "inner", ["o"]).collect()
    assert sorted((r.i, r.v) for r in inner) == [x for x in brute_asof(left, right, low, high) if x[1]]
    assert all(r.v is None for r in tp.asof_join(a, b.limit(0), [("k", "k")], "ts", "ts", {"v": "v"}).collect())


def test_validity_first_latest_changelog(spark):
    df = timed(spark, [(1, "a", 5, 1), (1, "b", 5, 2), (1, "c", 9, 3), (2, "d", 1, 4)], "k int, v string, ts bigint, o int", "ts")
    history = tp.validity(df, ["k"], "ts", ["o"])
    assert sorted((r.k, r.v, r.ts, r[VALID_TO]) for r in micro(history, "ts", VALID_TO).collect()) == [(1, "b", 5, 9), (1, "c", 9, None), (2, "d", 1, None)]
    log = micro(tp.changelog(history, "ts", delete="gone"), "ts").collect()
    assert sorted((r.v, r.ts, r.gone) for r in log) == [("b", 5, False), ("b", 9, True), ("c", 9, False), ("d", 1, False)]
    assert sorted((r.k, r.v) for r in tp.first_rows(df, ["k"], "ts", ["o"]).collect()) == [(1, "a"), (2, "d")]
    with pytest.raises(ValueError):
        tp.changelog(history, "ts")


def test_dedup_by_time_window_and_session(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("a", 6, 3), ("a", 12, 4), ("a", 17, 5), ("b", 3, 6), (None, 3, 7), (None, 3, 8)]
    df = timed(spark, rows, "k string, ts bigint, o int", "ts")
    pick = lambda **how: sorted(r.o for r in tp.dedup(df, ["k"], "ts", order=["o"], **how).collect())
    assert pick() == [2, 3, 4, 5, 6, 8] and pick(window_us=10) == [3, 5, 6, 8]
    assert pick(gap_us=6) == [2, 3, 5, 6, 8]  # rows six apart are in different sessions, rows five apart are not


def test_explode(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", None]), (2, [], []), (3, None, None)], "i int, x array<int>, y array<string>")
    assert sorted(map(str, (tuple(r) for r in tp.explode_lists(df, ["x", "y"]).collect()))) == ["(1, 1, 'a')", "(1, 2, None)", "(2, None, None)", "(3, None, None)"]
    with pytest.raises(Exception, match="unequal"):
        tp.explode_lists(spark.createDataFrame([(1, [1], ["a", "b"])], df.schema), ["x", "y"]).collect()


def test_samples_are_stable(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 500).alias("k"))
    one = {r.k for r in tp.hash_sample(df, 0.3, ["k"]).collect()}
    assert 90 < len(one) < 210 and {r.k for r in tp.hash_sample(df.repartition(7), 0.3, ["k"]).collect()} == one
    assert tp.hash_sample(df, 0.3, ["k"]).count() == 4 * len(one) and tp.hash_sample(df, 1, ["k"]).count() == 2000 and tp.hash_sample(df, 0, ["k"]).count() == 0
