import random

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm.mixing import _settle, mix, pivot, shares

TARGET = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 3), ("none", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1)]


def sizes(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaaabc"), rng.randrange(1, 200)) for i in range(n)] + [(9000, None, 5), (9001, "other", 5), (9002, "a", 0), (9003, "zero", 9)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, rows=TARGET):
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int")


@pytest.mark.parametrize("how", [{}, {"group_size": 7, "fan_in": 3}, {"group_size": 1000}])
def test_shares_repeats_and_totals(spark, how):
    rows, df = sizes(spark)
    got = mix(df, targets(spark), **how).collect()
    have = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    total = min(have[s] * r / w for s, w, r in TARGET[:3])
    size = {i: n for i, _, n in rows}
    for s, w, r in TARGET[:3]:
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.copies * x.n_tokens for x in mine) - w * total) <= max(n for _, x, n in rows if x == s)
        assert all(1 <= x.copies <= r and x.n_tokens == size[x.doc_id] for x in mine)
        rate = w * total / have[s]
        assert {x.copies for x in mine} <= {int(rate), int(rate) + 1}
    assert {x.source for x in got} == {"a", "b", "c"} and len({x.doc_id for x in got}) == len(got)


def test_the_same_whatever_the_partitioning(spark):
    _, df = sizes(spark)
    one = sorted(tuple(r) for r in mix(df.repartition(1), targets(spark), group_size=20).collect())
    assert one == sorted(tuple(r) for r in mix(df.repartition(5), targets(spark), group_size=20).collect())
    assert one != sorted(tuple(r) for r in mix(df, targets(spark), group_size=20, seed=2).collect())


def test_expectations_are_kept():
    n = 20
    rows = {"source": ["a"] * n, "node": [0] * n, "doc_id": list(range(n)), "n_tokens": list(range(1, n + 1)), "copies": [0] * n, "mass": [0.4 * i for i in range(1, n + 1)]}
    used = np.zeros(n)
    for seed in range(400):
        out = _settle(seed, True)((pa.scalar("a"), pa.scalar(0)), pa.table(rows))
        copies = out["copies"].to_numpy()
        used += copies
        assert out["mass"].null_count == n and abs((copies * out["n_tokens"].to_numpy()).sum() - 0.4 * 210) <= n
    assert (abs(used / 400 - 0.4) < 0.12).all()


def test_pivot_keeps_mass_and_settles_one():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = rng.randrange(1, 50), rng.randrange(1, 50)
        x, y = rng.random() * a, rng.random() * b
        up, down = pivot(a, x, b, y, 0.0), pivot(a, x, b, y, 0.999999)
        for p, q in (up, down):
            assert abs(p + q - x - y) < 1e-9 and (p in (0.0, float(a)) or q in (0.0, float(b))) and 0 <= p <= a and 0 <= q <= b
        d1, d2 = up[0] - x, x - down[0]
        if d1 + d2:
            assert abs(d2 / (d1 + d2) * d1 - d1 / (d1 + d2) * d2) < 1e-9


def test_too_large_a_total_caps_and_report(spark):
    rows, df = sizes(spark)
    mixture = mix(df, targets(spark), total_tokens=10**9)
    report = {r.source: r for r in shares(mixture, targets(spark)).collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"].share == 0 and report["none"].tokens == 0
    for s, _, r in TARGET[:3]:
        assert report[s].tokens == r * sum(n for _, x, n in rows if x == s) and report[s].most_copies == r
    assert abs(sum(r.share for r in report.values()) - 1) < 1e-9


def test_empty(spark):
    _, df = sizes(spark)
    assert mix(df.limit(0), targets(spark)).collect() == []
    assert mix(df, targets(spark, [])).collect() == []
