import pytest
from pyspark.sql import functions as F

from lodestream.runtime import shared_path
from lodestream.streaming.entity_features import FeatureTable, code, feature_rows, maintain_features, wide

ROWS = [("a", "X", 1, 2.0), ("a", "X", 1, 2.0), ("a", "x ", 5, 1.0), ("a", None, 7, None), (None, "X", 1, 1.0), ("b", "X", None, 1.0), ("b", "Y-z", 3, 4.0), ("b", "y z", 9, 1.0), ("b", "Y_Z", 50, 1.0)]


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "who string, kind string, t bigint, amount double").withColumn("t", F.timestamp_micros("t")).withColumn("entity", F.lit(1)).withColumn("features", F.lit(2))
    df.coalesce(1).write.mode("append").parquet(path)


def features(spark, path, work=None, **how):
    df = maintain_features(spark, path, "who", code(F.col("kind")), "t", total="amount", work_dir=work, **how)
    return df, sorted(tuple(r) for r in feature_rows(df).collect())


WANT = [("a", "NONE", 1, 7, 0.0), ("a", "X", 2, 5, 3.0), ("b", "Y_Z", 2, 9, 5.0)]


def test_counts_latest_totals_and_repeats(spark):
    path = shared_path(spark, "in")
    write(spark, path, ROWS)
    df, got = features(spark, path, as_of_us=50)
    assert got == WANT
    row = wide(df.where("entity = 'a'"), ["X", "Q"], 100).collect()[0]
    assert (row.n_X, row.recency_us_X, row.total_X, row.n_Q, row.recency_us_Q, row.total_Q) == (2, 95, 3.0, 0, None, 0.0)


def test_many_batches_and_a_second_run_give_the_same(spark):
    path, work = shared_path(spark, "in"), shared_path(spark, "work")
    for r in ROWS[:6]:
        write(spark, path, [r])
    features(spark, path, work, as_of_us=50, max_files=2)
    for r in ROWS[6:] + ROWS[:2]:  # later files, some of them repeats of events seen before
        write(spark, path, [r])
    assert features(spark, path, work, as_of_us=50, max_files=2)[1] == WANT
    assert features(spark, path, work, as_of_us=50)[1] == WANT


def test_a_folder_is_for_one_time_and_batches_touch_their_buckets_only(spark):
    path, work = shared_path(spark, "in"), shared_path(spark, "work")
    rows = [(f"e{i}", "X", i, 1.0) for i in range(40)]
    write(spark, path, rows)
    features(spark, path, work, buckets=16)
    write(spark, path, [("e3", "X", 99, 1.0), ("e3", "X", 3, 1.0)])
    got = features(spark, path, work, buckets=16)[1]
    assert len(got) == 40 and ("e3", "X", 2, 99, 2.0) in got
    table = FeatureTable(spark, f"{work}/features", 16)
    versions = list(table.listed(table.last()).values())
    assert len(versions) > 8 and versions.count(max(versions)) == 1
    with pytest.raises(ValueError, match="as of"):
        features(spark, path, work, as_of_us=50)


def test_repeats_within_a_horizon(spark):
    path = shared_path(spark, "in")
    day = 86_400_000_000
    write(spark, path, [("a", "X", 100 * day, 1.0), ("a", "X", 100 * day, 1.0), ("a", "X", 101 * day, 1.0)])
    write(spark, path, [("a", "X", 100 * day, 1.0), ("a", "X", 102 * day, 2.0)])
    assert features(spark, path, repeats_within="5d", max_files=1)[1] == [("a", "X", 3, 102 * day, 4.0)]


def test_no_events(spark):
    path = shared_path(spark, "in")
    write(spark, path, [(None, "X", 1, 1.0)])
    assert features(spark, path)[1] == []


def test_code(spark):
    df = spark.createDataFrame([("card - Debit",), ("CARD__debit ",), (None,), ("",), ("é x",)], "c string")
    assert [r[0] for r in df.select(code(F.col("c"))).collect()] == ["CARD_DEBIT", "CARD_DEBIT", "NONE", "", "É_X"]
