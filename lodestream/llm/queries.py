"""Queries of the text and matching problems, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, lookalike, mixing
from lodestream.llm.nearest import nearest_in_time
from lodestream.runtime import salted_join, staged, table

# -- 5: nearest in time ----------------------------------------------------------------------------------------


def _device(column: str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(column), r"[\s\-]", ""), F.lit(""))


def checkout_pages(pages: DataFrame) -> DataFrame:
    """id, created and driver of each page; pages without driver get the only one their device is shown with."""
    rows = pages.select("id", "created", "driver_id", _device("device_id").alias("device"))
    owners = (
        rows.where("device IS NOT NULL AND driver_id IS NOT NULL")
        .groupBy("device")
        .agg(F.min("driver_id").alias("owner"), F.max("driver_id").alias("_other"))
        .where("owner = _other")
        .drop("_other")
    )
    timed = rows.where("created IS NOT NULL AND id IS NOT NULL")
    found = salted_join(timed.where("driver_id IS NULL AND device IS NOT NULL"), owners, ["device"])
    return timed.where("driver_id IS NOT NULL").select("id", "created", F.col("driver_id").alias("driver")).unionByName(found.select("id", "created", F.col("owner").alias("driver")))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = table(spark, sf_dir, "login_event").select("id", "created", F.col("driver_id").alias("driver"))
    found = nearest_in_time(
        checkout_pages(table(spark, sf_dir, "booking_flow_checkout_page")), logins, "driver", "created", "created", "id", "id", tolerance_us=600_000_000
    )
    return found.select(F.col("left_id").alias("checkout_id"), F.col("right_id").alias("login_id"), "gap_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_nearest(spark, sf_dir).select("checkout_id", "login_id")


_NEAREST_SQL = r"""
WITH rows_in AS (SELECT id, created, driver_id, nullif(regexp_replace(lower(device_id), '[\s\-]', '', 'g'), '') AS device FROM booking_flow_checkout_page),
owners AS (SELECT device, min(driver_id) AS owner FROM rows_in WHERE device IS NOT NULL AND driver_id IS NOT NULL GROUP BY device HAVING min(driver_id) = max(driver_id)),
pages AS (SELECT DISTINCT id, created, coalesce(driver_id, owner) AS driver FROM rows_in LEFT JOIN owners USING (device) WHERE created IS NOT NULL),
pairs AS (SELECT p.id AS checkout_id, l.id AS login_id, epoch_us(l.created) - epoch_us(p.created) AS gap_us,
  row_number() OVER (PARTITION BY p.id, p.created, p.driver ORDER BY abs(epoch_us(l.created) - epoch_us(p.created)), l.created, l.id) AS no
  FROM pages p JOIN login_event l ON l.driver_id = p.driver AND l.created BETWEEN p.created - INTERVAL 10 MINUTE AND p.created + INTERVAL 10 MINUTE)
"""

# -- 8: encoding -----------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact round trip: the texts put together again from their ids."""
    return bpe.decode(p8_ids(spark, sf_dir)).select("doc_id", "text")


# -- 9: mixing -------------------------------------------------------------------------------------------------


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    return mixing.mix(bpe.count_tokens(documents, keep=["source"]), table(spark, sf_dir, "mix_target"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target source is used at all, within one document of its budget, and no document too often."""
    target = table(spark, sf_dir, "mix_target")
    sizes = staged(bpe.count_tokens(table(spark, sf_dir, "documents").where("source IS NOT NULL"), keep=["source"]), "sizes")
    plans = [(p["source"], float(p["budget"])) for p in mixing.plan(sizes, target)]  # one row per target source
    budgets = spark.createDataFrame(plans, "source string, budget double")
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    reached = mixing.shares(mixing.mix(sizes, target), target).join(budgets, "source").join(largest, "source", "left")
    return reached.select(
        "source",
        (F.col("tokens") > 0).alias("used"),
        (F.abs(F.col("tokens") - F.col("budget")) <= F.coalesce("largest", F.lit(0))).alias("within_budget"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"),
    )


# -- 10: look-alike texts --------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_classes(table(spark, sf_dir, "documents"))


def p10_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "consistent")


QUERIES = {
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_bounds": p9_bounds,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_consistent": p10_consistent,
}

ORACLE_SQL = {
    "p5_found": _NEAREST_SQL + "SELECT DISTINCT checkout_id, login_id FROM pairs WHERE no = 1",
    "p5_nearest": _NEAREST_SQL + "SELECT DISTINCT checkout_id, login_id, gap_us FROM pairs WHERE no = 1",
    "p9_bounds": "SELECT source, source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS used, true AS within_budget, true AS within_repeats FROM mix_target",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
