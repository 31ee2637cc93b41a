import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators.sessions import close_runs, sessionize

MIN = 60_000_000


def brute(rows, gap):
    """(kind, entity) -> sessions of distinct (document, time)."""
    seen = {}
    for kind, entity, t, d in rows:
        if entity is not None and t is not None:
            seen.setdefault((kind, entity), set()).add((t, d))
    out = set()
    for (kind, entity), views in seen.items():
        times = sorted(t for t, _ in views)
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.add((kind, entity, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((kind, entity, start, last, n))
    return out


def found(spark, rows, gap=30 * MIN, block=86_400_000_000):
    df = spark.createDataFrame(rows, "who string, t bigint, d bigint").select("who", F.timestamp_micros("t").alias("t"), "d", F.lit(1).alias("_at"), F.lit("x").alias("n_events"), F.lit(2).alias("entity_id"))
    got = sessionize(df, {"k": F.col("who")}, "t", ["d"], gap, block).collect()
    assert all(r.duration_us == r.end_us - r.start_us for r in got)
    assert len(got) == len({(r.entity_id, r.start_us) for r in got})
    return {(r.entity_kind, r.entity_id, r.start_us, r.end_us, r.n_events) for r in got}


def test_gap_edges_ties_repeats_and_nulls(spark):
    g = 30 * MIN
    rows = [("a", 0, 1), ("a", g, 1), ("a", 2 * g + 1, 1), ("b", 5, None), ("b", 5, None), ("b", 5, 1), (None, 5, 1), ("c", None, 1), ("d", -g, 1), ("d", 0, 2)]
    assert found(spark, rows) == brute([("k", *r) for r in rows], g)
    assert ("k", "a", 0, g, 2) in found(spark, rows) and ("k", "b", 5, 5, 2) in found(spark, rows)


def test_empty(spark):
    assert found(spark, []) == set()


@pytest.mark.parametrize("block", [7 * MIN, 60 * MIN, 86_400_000_000])
def test_random_against_brute_force_in_any_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = [(str(rng.integers(3)), int(rng.integers(0, 2_000)) * MIN // 4, int(rng.integers(2))) for _ in range(600)]
    rows += [("hot", int(i) * MIN, 0) for i in range(3000)]  # one session through many blocks and Arrow batches
    for gap in (1, 20 * MIN, 30 * MIN):
        assert found(spark, rows, gap, block) == brute([("k", *r) for r in rows], gap)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=40, unique=True), st.integers(1, 20))
def test_closing_is_that_of_the_bitmap(points, gap):
    points = sorted(points)
    group, start = (np.array(x) for x in zip(*points))
    first, end = close_runs(group, start, start + 1, gap)
    for g in set(group.tolist()):
        bits = np.zeros(61 + 2 * gap, bool)
        bits[start[group == g]] = True
        wide = np.zeros(len(bits) + gap, bool)
        for k in range(gap):
            wide[k : k + len(bits)] |= bits
        closed = np.array([wide[i : i + gap].all() for i in range(len(bits))])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], closed.astype(int), [0]])))
        mine = [(int(start[f]), int(e)) for f, e in zip(first, end) if group[f] == g]
        assert mine == list(zip(edges[::2].tolist(), edges[1::2].tolist())) == brute_runs(start[group == g], gap)


def brute_runs(times, gap):
    out, a, last = [], int(times[0]), int(times[0])
    for t in times.tolist():
        if t - last > gap:
            out.append((a, last + 1))
            a = t
        last = t
    return [*out, (a, last + 1)]
