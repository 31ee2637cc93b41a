import pytest
from pyspark.sql import functions as F

from lodestream.operators import aggregates as agg
from lodestream.quality import expectations as ex
from lodestream.runtime import shared_path
from lodestream.streaming.runner import asof_of, continuous_stream, dedup_stream, replay, run_to_files, run_to_table, stateful_session, windowed
from lodestream.types import Continuous, Tumbling

SEC = 1_000_000


def write(spark, path, rows):
    spark.createDataFrame(rows, "k string, t bigint, v double").select("k", F.timestamp_micros(F.col("t") * SEC).alias("ts"), "v").coalesce(1).write.mode("append").parquet(path)


def test_windows_over_several_batches_and_runs(spark):
    session, path, work = stateful_session(spark), shared_path(spark, "in"), shared_path(spark, "work")
    schema = "k string, ts timestamp, v double"
    w = Tumbling("10s")
    specs = [agg.Count(into_field="n", window=w), agg.Sum("v", into_field="s", window=w)]
    stream = lambda: windowed(session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["k"], "ts", w, specs, {"v": agg.t.Float}, "1h")
    for rows in ([("a", 1, 1.0), ("a", 12, 2.0)], [("a", 3, 4.0), ("b", 5, 1.0)]):
        write(spark, path, rows)
    run_to_table(stream(), spark, ["k", "begin", "end"], work_dir=work)
    write(spark, path, [("a", 4, 8.0)])
    got = run_to_table(stream(), spark, ["k", "begin", "end"], work_dir=work)
    assert sorted((r.k, r.begin.second, r.n, r.s) for r in got.collect()) == [("a", 0, 3, 13.0), ("a", 10, 1, 2.0), ("b", 0, 1, 1.0)]


def test_dedup(spark):
    session, path = stateful_session(spark), shared_path(spark, "in")
    for _ in range(3):
        write(spark, path, [("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, 1.0)])
    stream = session.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(path)
    assert run_to_files(dedup_stream(stream, ["k"], "ts", "1h"), spark, stream.schema).count() == 2


def test_continuous_windows_and_joins_in_event_order(spark):
    session = stateful_session(spark)
    rows = spark.createDataFrame([("a", 5, 2.0), ("a", 0, 1.0), ("b", -7, 4.0)], "k string, t bigint, v double").select("k", F.timestamp_micros(F.col("t") * SEC).alias("ts"), "v")
    work = shared_path(spark, "c")
    out = continuous_stream(replay(session, rows, "ts", work), "k", "ts", "v", Continuous("9s"), "0s")
    got = run_to_files(out, spark, out.schema, work).where("key IS NOT NULL").collect()
    assert sorted((r.key, r.at_us // SEC, r.n, r.total) for r in got) == [("a", 0, 1, 1.0), ("a", 5, 2, 3.0), ("a", 10, 1, 2.0), ("a", 15, 0, 0.0), ("b", -7, 1, 4.0), ("b", 3, 0, 0.0)]
    both = spark.createDataFrame([("a", 1, None, 1.5, 0), ("a", 1, 7, None, 1), ("a", 0, 8, None, 1), ("b", 9, 9, None, 1)], "k string, t bigint, _id bigint, _v double, _side int")
    both = both.select("k", F.timestamp_micros(F.col("t") * SEC).alias("ts"), "_id", "_v", "_side")
    work = shared_path(spark, "j")
    out = asof_of(replay(session, both, "ts", work), "k", "ts", "0s")
    assert sorted((r.left_id, r.value) for r in run_to_files(out, spark, out.schema, work).collect()) == [(7, 1.5), (8, None), (9, None)]


def test_rows_after_the_end_of_replays_count(spark):
    session = stateful_session(spark)
    times = ["2200-01-01 00:00:00", "2223-05-06 00:00:00", "9999-12-31 00:00:00"]
    rows = session.createDataFrame([("a", x, float(i)) for i, x in enumerate(times)], "k string, t string, v double").select("k", F.col("t").cast("timestamp").alias("ts"), "v")
    us = [r.us for r in rows.select(F.unix_micros("ts").alias("us")).collect()]
    work = shared_path(spark, "far")
    out = continuous_stream(replay(session, rows, "ts", work), "k", "ts", "v", Continuous("forever"), "0s")
    assert sorted(tuple(r) for r in run_to_files(out, spark, out.schema, work).collect()) == [("a", us[0], 1, 0.0), ("a", us[1], 2, 1.0), ("a", us[2], 3, 3.0)]
    both = rows.select("k", "ts", F.when(F.col("v") > 0, F.col("v").cast("long")).alias("_id"), F.when(F.col("v") == 0, 5.0).alias("_v"), (F.col("v") > 0).cast("int").alias("_side"))
    work = shared_path(spark, "far-asof")
    out = asof_of(replay(session, both, "ts", work), "k", "ts", "0s")
    assert sorted(tuple(r) for r in run_to_files(out, spark, out.schema, work).collect()) == [(1, 5.0), (2, 5.0)]


def test_json_schemas_with_unknown_keywords_are_refused(spark):
    import pytest

    from lodestream.quality.expectations import expect_column_values_to_match_json_schema as expect

    expect("j", {"title": "t", "type": "object", "properties": {"pattern": {"type": "string"}}})
    for schema in ({"pattern": "a"}, {"properties": {"x": {"const": 1}}}, {"items": {"anyOf": []}}, {"items": [{"type": "string"}]}, {"items": True}):
        with pytest.raises(ValueError):
            expect("j", schema)


def test_expectations(spark):
    rows = [(1, "a1", "2024-01-02", '{"x": 1}', 1, 2), (2, None, "x", "{", 3, 3), (None, "bb", None, '{"x": "s"}', 5, 4), (4, "c", "2024-02-30", "[]", 2, 5)]
    df = spark.createDataFrame(rows, "n bigint, s string, d string, j string, p int, q int")
    want = {
        ex.expect_column_values_to_not_be_null("n"): (3, 4), ex.expect_column_values_to_be_null("s"): (1, 4), ex.expect_column_values_to_be_of_type("n", int): (4, 4), ex.expect_column_values_to_be_in_type_list("n", [str, float]): (0, 4),
        ex.expect_column_values_to_be_in_set("n", [1, 2]): (2, 3), ex.expect_column_values_to_not_be_in_set("n", [1]): (2, 3), ex.expect_column_values_to_be_between("n", 1, 4, strict_min=True, strict_max=True): (1, 3),
        ex.expect_column_value_lengths_to_be_between("s", 2, 3): (2, 3), ex.expect_column_value_lengths_to_equal("s", 1): (1, 3), ex.expect_column_values_to_match_regex("s", "^[a-b]"): (2, 3), ex.expect_column_values_to_not_match_regex("s", "1"): (2, 3),
        ex.expect_column_values_to_match_regex_list("s", ["a", "c"]): (2, 3), ex.expect_column_values_to_match_regex_list("s", ["a", "1"], match_on="all"): (1, 3), ex.expect_column_values_to_not_match_regex_list("s", ["a", "c"]): (1, 3),
        ex.expect_column_values_to_match_strftime_format("d", "%Y-%m-%d"): (1, 3), ex.expect_column_values_to_be_dateutil_parseable("d"): (1, 3), ex.expect_column_values_to_be_json_parseable("j"): (3, 4),
        ex.expect_column_values_to_match_json_schema("j", {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}): (1, 4), ex.expect_column_pair_values_to_be_equal("p", "q"): (1, 4),
        ex.expect_column_pair_values_A_to_be_greater_than_B("p", "q"): (1, 4), ex.expect_column_pair_values_A_to_be_greater_than_B("p", "q", or_equal=True): (2, 4), ex.expect_column_pair_values_to_be_in_set("p", "q", [(1, 2), (5, 4)]): (2, 4), ex.expect_multicolumn_sum_to_equal(["p", "q"], 7): (1, 4),
    }
    got = {r.no: r for r in ex.report(df, list(want)).collect()}
    assert [(got[i].n_ok, got[i].n_rows) for i in range(len(want))] == list(want.values())
    r = ex.report(df, [ex.expect_column_values_to_be_null("s", mostly=0.25), ex.expect_column_values_to_be_null("s", mostly=0.3)]).orderBy("no").collect()
    assert [x.success for x in r] == [True, False] and ex.report(df.limit(0), [ex.expect_column_values_to_be_null("s")]).collect()[0].success
    with pytest.raises(ValueError):
        ex.expect_column_values_to_be_null("s", mostly=2)
