import os

import pytest
from pyspark.sql import functions as F

from lodestream import runtime as rt


def test_staged_tables_and_cleaning(spark):
    df = rt.staged(spark.range(5), "x")
    assert df.count() == 5
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert path.startswith(rt.shared_dir(spark)) and os.path.exists(path)
    rt.clean(spark)
    assert not os.path.exists(path)
    kept = rt.staged(spark.range(3), "kept")
    with rt.lifetime(spark):
        path = rt.staged(spark.range(5), "x").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_times_without_zone_are_utc_whatever_the_session_says(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00.000001' n, TIMESTAMP '2024-01-01 00:00:00Z' z, DATE '1970-01-02' d, 5L b, CAST(NULL AS TIMESTAMP_NTZ) e")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert tuple(df.select(*(rt.micros(df, c) for c in df.columns)).first()) == (1704067200000001, 1704067200000000, 86_400_000_000, 5, None)
        assert rt.utc(df).select(F.unix_micros("n")).first()[0] == 1704067200000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("rows_per_salt", [1, 3, 1000])
def test_salted_joins_are_whole(spark, rows_per_salt):
    left = spark.range(60).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k bigint, v string")
    got = rt.salted_join(left, right, ["k"], rows_per_salt)
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "v").collect()))
    assert set(got.columns) == {"k", "id", "v"}
