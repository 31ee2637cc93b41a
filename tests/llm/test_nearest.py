import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm.nearest import nearest_in_time
from lodestream.llm.queries import checkout_pages

SEC = 1_000_000


def brute(left, right, tolerance):
    out = set()
    for i, e, t in left:
        if None in (i, e, t):
            continue
        fits = [(abs(s - t), s, j) for j, f, s in right if None not in (j, f, s) and f == e and abs(s - t) <= tolerance]
        if fits:
            d, s, j = min(fits)
            out.add((i, j, s - t))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, who string, t bigint").select("id", "who", F.timestamp_micros("t").alias("t"), F.lit(1).alias("at"), F.lit("s").alias("side"), F.lit(0).alias("entity"))


def found(spark, left, right, tolerance, **how):
    rows = nearest_in_time(frame(spark, left), frame(spark, right), "who", "t", "t", "id", "id", tolerance, **how).collect()
    assert len(rows) == len(set(rows))
    return {(r.left_id, r.right_id, r.gap_us) for r in rows}


def sample(seed=0, n=250):
    rng = np.random.default_rng(seed)
    one = lambda p, k: [(f"{p}{i}", str(rng.integers(5)), int(rng.integers(0, 4000)) * SEC) for i in range(k)]
    return one("l", n) + [(f"h{i}", "hot", i * 7 * SEC) for i in range(n)], one("r", n) + [(f"g{i}", "hot", i * 5 * SEC) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"chunk_us": 60 * SEC, "rows_per_bucket": 20}, {"rows_per_slice": 150, "chunk_us": 500 * SEC}])
def test_random_against_brute_force_in_any_chunks_and_slices(spark, how):
    left, right = sample()
    assert found(spark, left, right, 20 * SEC, **how) == brute(left, right, 20 * SEC)


def test_rows_come_out_while_later_slices_wait(spark):
    left, right = sample(3, 100)
    report = []
    assert found(spark, left, right, 20 * SEC, report=report) == brute(left, right, 20 * SEC)
    assert len(report) == 6 and 0 < report[1] < report[2] < report[3] < report[5], report  # four slices and two closing rows


def test_a_tolerance_longer_than_a_chunk(spark):
    left, right = sample(1, 60)
    assert found(spark, left, right[::9], 500 * SEC, chunk_us=60 * SEC) == brute(left, right[::9], 500 * SEC)
    left, right = [("page", "x", 5400 * SEC)], [("login", "x", 1800 * SEC)]
    assert found(spark, left, right, 7200 * SEC) == brute(left, right, 7200 * SEC) == {("page", "login", -3600 * SEC)}


def test_a_live_stream_with_a_tolerance_longer_than_its_chunks(spark):
    from lodestream.llm.nearest import join_stream, side_rows
    from lodestream.runtime import shared_path
    from lodestream.streaming.runner import run_to_files, stateful_session

    left, right = sample(2, 60)
    session, inbox = stateful_session(spark), shared_path(spark, "inbox")
    base = 1_700_000_000 * SEC
    far = [("end", "x", 10_000 * SEC)]  # lets all that waits go
    for rows in ((left, right[::9]), (far, [])):
        sides = [side_rows(frame(spark, [(i, w, base + t) for i, w, t in part]), "who", "t", "id", k, 500 * SEC, 60 * SEC) for k, part in enumerate(rows)]
        sides[0].unionByName(sides[1]).coalesce(1).write.mode("append").parquet(inbox)
    stream = session.readStream.schema("entity string, chunk bigint, at bigint, side int, id string").option("maxFilesPerTrigger", 1).parquet(inbox)
    out = join_stream(stream, 500 * SEC, 60 * SEC, 4)
    assert {(r.left_id, r.right_id, r.gap_us) for r in run_to_files(out, spark, out.schema).collect()} == brute(left, right[::9], 500 * SEC)


def test_limits_ties_and_nulls(spark):
    left = [("a", "x", 100), ("b", "x", 1000), (None, "x", 5), ("c", None, 5), ("d", "x", None), ("e", "y", 100), ("a", "x", 100), ("f", "x", -7200 * SEC)]
    right = [("2", "x", 90), ("1", "x", 90), ("3", "x", 110), ("4", "x", 1010), ("5", "x", 989), (None, "x", 100), ("6", None, 100), ("7", "x", None), ("8", "x", -7200 * SEC)]
    assert found(spark, left, right, 10) == brute(left, right, 10) == {("a", "1", -10), ("b", "4", 10), ("f", "8", 0)}


def test_times_beyond_every_watermark(spark):
    far = 8_000_000_000_000_000  # the year 2223
    assert found(spark, [("a", "x", far), ("b", "x", -9_000_000_000_000_000)], [("r", "x", far + 1), ("s", "x", -9_000_000_000_000_000)], 5) == {("a", "r", 1), ("b", "s", 0)}


def test_empty_and_unmatched(spark):
    assert found(spark, [], [("r", "x", 1)], 5) == set()
    assert found(spark, [("l", "x", 1)], [], 5) == set()
    assert found(spark, [("l", "x", 1), ("m", "x", 50)], [("r", "x", 2)], 5, keep_unmatched=True) == {("l", "r", 1), ("m", None, None)}


def test_pages_get_the_only_driver_of_their_device(spark):
    rows = [("1", 1, 7, "A-b"), ("2", 2, None, "ab "), ("3", None, 8, "C"), ("4", 3, None, "c"), ("5", 3, 9, "D"), ("6", 3, 10, "d"), ("7", 4, None, "D"), ("8", 4, None, None), ("9", 4, None, " - ")]
    df = spark.createDataFrame(rows, "id string, created int, driver_id int, device_id string")
    assert {(r.id, r.driver) for r in checkout_pages(df).collect()} == {("1", 7), ("2", 7), ("4", 8), ("5", 9), ("6", 10)}


def test_a_live_stream_emits_once_the_horizon_has_passed(spark):
    from lodestream.llm.nearest import join_stream, side_rows
    from lodestream.runtime import shared_path
    from lodestream.streaming.runner import run_to_files, stateful_session

    session, inbox, work = stateful_session(spark), shared_path(spark, "inbox"), shared_path(spark, "live")
    base = 1_700_000_000 * SEC

    def arrive(left, right):
        sides = [side_rows(frame(spark, [(i, w, base + t * SEC) for i, w, t in rows]), "who", "t", "id", k, 10 * SEC, 60 * SEC) for k, rows in enumerate((left, right))]
        sides[0].unionByName(sides[1]).coalesce(1).write.mode("append").parquet(inbox)
        stream = session.readStream.schema("entity string, chunk bigint, at bigint, side int, id string").option("maxFilesPerTrigger", 1).parquet(inbox)
        out = join_stream(stream, 10 * SEC, 60 * SEC, 4, lateness="5 seconds", keep_unmatched=True)
        return {(r.left_id, r.right_id) for r in run_to_files(out, spark, out.schema, work).collect()}

    assert arrive([("a", "x", 100)], [("r", "x", 95)]) == set()
    assert arrive([("b", "x", 130)], [("s", "x", 103)]) == {("a", "s")}  # the watermark is at 125
    assert arrive([("c", "y", 300)], []) == {("a", "s"), ("b", None)}
