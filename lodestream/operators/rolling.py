"""Trailing totals by block decomposition.

Days are cut into blocks as long as the window. Within each block stand prefix sums (block start to day) and
suffix sums (day to block end). The window that ends on a day covers the tail of one block and the head of the
next, so its total is one suffix plus one prefix, whatever the window's length.

Rows are first summed to entity days, with partial aggregation before the shuffle; an entity then has at most as
many rows as its calendar has days, however many records it had. That bound is what lets an entity's days be
ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.runtime import micros

DAY_US = 86_400_000_000


def daily_totals(rows: DataFrame, entity: str, time: str, amount: Column, record: str | None = None) -> DataFrame:
    """entity_id, day (days since 1970-01-01), total, n. Rows of one record (if named) count once.

    Rows with null entity, time, amount or record take no part. Of rows of one record that differ, the least by
    (time, entity, amount) counts.
    """
    picked = rows.select(
        F.col(f"`{entity}`").cast("string").alias("entity_id"),
        micros(rows, time).alias("_at"),
        amount.alias("_amount"),
        *([F.col(f"`{record}`").alias("_record")] if record else []),
    ).dropna()
    if record:
        picked = picked.groupBy("_record").agg(F.min(F.struct("_at", "entity_id", "_amount")).alias("_r")).select("_r.*")
    return picked.groupBy("entity_id", F.floor(F.col("_at") / F.lit(DAY_US)).cast("int").alias("day")).agg(
        F.sum("_amount").alias("total"), F.count(F.lit(1)).alias("n")
    )


def trailing_totals(daily: DataFrame, windows: list[int], keys: list[str] | None = None) -> DataFrame:
    """Every calendar day of each entity from its first to its last, with trailing totals and averages.

    daily: keys (["entity_id"] unless named), day int, total and n, one row per entity day. Columns added for
    each window of w days: total_wd, n_wd, avg_wd (total over w days), avg_record_wd (total over records, null
    without any). Days without a row count as 0, and so do days before the entity's first. Empty in, empty out.
    """
    keys = keys or ["entity_id"]
    if min(windows) < 1:
        raise ValueError("windows must be at least a day long")
    ordered = Window.partitionBy(*keys).orderBy("day")
    known = daily.select(*keys, "day", "total", "n", F.lead("day").over(ordered).alias("_next"))
    # each known day brings the days without activity that follow it
    dense = known.select(
        *keys,
        "total",
        "n",
        F.col("day").alias("_known"),
        F.explode(F.sequence(F.col("day"), F.coalesce(F.col("_next") - 1, F.col("day")))).alias("day"),
    ).select(
        *keys,
        "day",
        *(F.when(F.col("day") == F.col("_known"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("total", "n")),
    )
    for w in windows:
        block = F.floor(F.col("day") / F.lit(w))
        head = Window.partitionBy(*keys, block).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        tail = Window.partitionBy(*keys, block).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
        for c in ("total", "n"):
            dense = dense.withColumn(f"_{c}_head", F.sum(c).over(head)).withColumn(f"_{c}_tail", F.sum(c).over(tail))
        # a window that fills its block is the block's own prefix
        whole = F.pmod(F.col("day"), F.lit(w)) == w - 1
        for c in ("total", "n"):
            suffix = F.coalesce(F.lag(f"_{c}_tail", w - 1).over(ordered), F.lit(0)) if w > 1 else F.lit(0)
            if w > 1:
                # before the entity's first day the block's suffix starts with its first known day
                suffix = F.when(whole, F.lit(0)).otherwise(
                    F.when(F.lag("day", w - 1).over(ordered).isNotNull(), suffix).otherwise(F.col(f"_{c}_before"))
                )
                first_day = F.min("day").over(Window.partitionBy(*keys))
                first_tail = F.first(f"_{c}_tail").over(ordered)
                dense = dense.withColumn(
                    f"_{c}_before",
                    F.when(F.floor(first_day / F.lit(w)) < block, F.when(F.floor(first_day / F.lit(w)) == block - 1, first_tail).otherwise(F.lit(0))).otherwise(F.lit(0)),
                )
            dense = dense.withColumn(f"{c}_{w}d", F.col(f"_{c}_head") + suffix)
        dense = dense.drop(*(f"_{c}_{p}" for c in ("total", "n") for p in ("head", "tail", "before")))
    averages = []
    for w in windows:
        averages.append((F.col(f"total_{w}d").cast("double") / F.lit(w)).alias(f"avg_{w}d"))
        averages.append((F.when(F.col(f"n_{w}d") > 0, F.col(f"total_{w}d").cast("double") / F.col(f"n_{w}d"))).alias(f"avg_record_{w}d"))
    return dense.select(*keys, "day", "total", "n", *(f"{c}_{w}d" for w in windows for c in ("total", "n")), *averages)
