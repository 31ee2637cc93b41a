"""Attributes as known at event time: validity intervals, cut at time buckets, equi-joined by entity and bucket.

A change carries the time it is valid from and the time it became known. It can speak for an event from the later
of the two on; among the changes that can, the one valid from the latest time does (ties: the higher change id).
So, in order of the time k from which changes can speak, the changes that are a new maximum of
(valid_from, change id) are the ones that ever speak, each during [k, k of the next such change).

These intervals are cut at the borders of time buckets, so events find theirs by an equi-join on (entity, bucket)
and a half-open containment test. Nothing orders an entity's changes as a whole: the running maximum is taken
within each (entity, bucket), and only one maximum per bucket is carried forward over the entity's buckets, of which
there are at most span / width, however busy the entity. An interval is written only into the buckets which hold
events or changes, so an old state that stays valid for years costs nothing where nobody asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.runtime import micros

MINUTE_US = 60_000_000


def known_at(
    events: DataFrame,
    changes: DataFrame,
    event_entity: str,
    event_time: str,
    change_entity: str,
    valid_from: str,
    change_id: str,
    known_from: str | None = None,
    attributes: list[str] | None = None,
    event_columns: list[str] | None = None,
    bucket_us: int = 5 * MINUTE_US,
    how: str = "inner",
) -> DataFrame:
    """Each event with the change that was valid and known at its time: event_columns, change_id, attributes.

    known_from: None if a change is known as soon as it is valid. A change received more than once counts from its
    first receipt. how: "inner", or "left" to keep events without a change (null attributes). Attribute names that
    clash with event columns get the suffix _known.

    Defined results: events with null entity or time get no change; changes with null entity, valid_from,
    known_from or id take no part; an event at the very time of a change sees it; null attributes are kept as known
    nulls; repeated events stay repeated; of changes equal in id and receipt, that with the greater valid_from
    counts, then the greater attributes; empty tables give no matches.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if bucket_us < 1:
        raise ValueError("bucket_us must be positive")
    event_columns = events.columns if event_columns is None else event_columns
    attributes = [] if attributes is None else attributes
    bucket = lambda at: F.floor(F.col(at) / F.lit(bucket_us))
    asked = events.select(
        F.struct(*(F.col(f"`{c}`") for c in event_columns)).alias("_event"),
        F.col(f"`{event_entity}`").alias("_entity"),
        micros(events, event_time).alias("_at"),
    ).withColumn("_bucket", bucket("_at"))
    known = micros(changes, known_from) if known_from else micros(changes, valid_from)
    raw = changes.select(
        F.col(f"`{change_entity}`").alias("_entity"),
        micros(changes, valid_from).alias("_valid"),
        known.alias("_received"),
        F.col(f"`{change_id}`").alias("_id"),
        F.struct(F.col(f"`{change_id}`"), *(F.col(f"`{c}`") for c in attributes if c != change_id)).alias("_attr"),
    ).dropna(subset=["_entity", "_valid", "_received", "_id"])
    # the first receipt of each change; an id belongs to one entity, so its repeats meet in one small group
    first = (
        raw.groupBy("_entity", "_id")
        .agg(F.min_by(F.struct("_valid", "_attr", "_received"), F.struct("_received", -F.col("_valid"))).alias("_c"))
        .select("_entity", F.greatest("_c._valid", "_c._received").alias("_k"), F.struct("_c._valid", "_id").alias("_rank"), "_c._attr")
        .withColumn("_bucket", bucket("_k"))
    )
    # carried into each bucket that holds events or changes: the maximum of the buckets before it
    best = F.struct("_rank", "_attr")
    spots = (
        first.groupBy("_entity", "_bucket").agg(F.max_by(best, "_rank").alias("_top"))
        .unionByName(asked.dropna(subset=["_entity", "_at"]).select("_entity", "_bucket").distinct(), allowMissingColumns=True)
        .groupBy("_entity", "_bucket")
        .agg(F.max_by("_top", "_top._rank").alias("_top"))
    )
    before = Window.partitionBy("_entity").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spots.select("_entity", "_bucket", F.max_by("_top", "_top._rank").over(before).alias("_c"))
        .where("_c IS NOT NULL")
        .select("_entity", (F.col("_bucket") * bucket_us).alias("_k"), "_c._rank", "_c._attr", "_bucket")
    )
    within = Window.partitionBy("_entity", "_bucket").orderBy("_k", "_rank")
    speaks = (
        first.unionByName(carried)
        .withColumn("_max", F.max("_rank").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_rank = _max")
        .withColumn("_to", F.coalesce(F.lead("_k").over(within), (F.col("_bucket") + 1) * bucket_us))
        .where("_k < _to")
        .select("_entity", "_bucket", "_k", "_to", "_attr")
    )
    taken = set(event_columns)
    names = [change_id, *(c for c in attributes if c != change_id)]
    matched = (
        asked.alias("e").join(
            speaks.alias("s"),
            (F.col("e._entity") == F.col("s._entity"))
            & (F.col("e._bucket") == F.col("s._bucket"))
            & (F.col("s._k") <= F.col("e._at"))
            & (F.col("e._at") < F.col("s._to")),
            how,
        )
    )
    return matched.select(
        "_event.*", *(F.col(f"_attr.`{c}`").alias(f"{c}_known" if c in taken else c) for c in names)
    )
