"""One feature row per entity, kept up to date by a stateful stream.

Two chained states, both checkpointed and both spread by hash over all tasks: the events already seen, so that
repeats count once, and per (entity, event type) the count, latest time and total. The counters are built with
partial aggregation before their shuffle, so an entity with a third of all events is no burden to one task.
After each micro-batch the counters that changed are folded into the entities' full rows, and these are upserted
into a table in the shared folder, of which a batch reads and writes only the buckets its entities are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.runtime import micros, shared_path, time_literal
from lodestream.streaming.files import exists, read_text, stream_table, total_bytes, write_text
from lodestream.streaming.tables import KeyedTable
from lodestream.types import duration_us

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def code(column: Column, missing: str = "NONE") -> Column:
    """A code in upper case with single underscores between its words; missing for null."""
    words = F.regexp_replace(F.upper(column), r"[\s_\-]+", "_")
    return F.coalesce(F.regexp_replace(words, "^_|_$", ""), F.lit(missing))


_FEATURE = "map<string, struct<n: bigint, latest_us: bigint, total: double>>"


class FeatureTable(KeyedTable):
    """Feature rows below a folder: entity string, features map by event type."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, ["entity"], buckets)

    def upsert(self, changed: DataFrame, version: int) -> None:
        """Fold changed counters (entity, event_type, n, latest_us, total) into the table."""
        new = changed.groupBy("entity").agg(
            F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "latest_us", "total")))).cast(_FEATURE).alias("new")
        )
        self.merge(new, version, self._folded)

    @staticmethod
    def _folded(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new.select("entity", F.col("new").alias("features"))
        kept = F.map_filter(F.coalesce("features", F.map_from_arrays(F.array(), F.array()).cast(_FEATURE)), lambda k, v: ~F.map_contains_key("new", k))
        both = F.when(F.col("new").isNull(), F.col("features")).otherwise(F.map_concat(kept, F.col("new")))
        return old.join(new, "entity", "full_outer").select("entity", both.cast(_FEATURE).alias("features"))

    def now(self) -> DataFrame:
        found = self.read()
        return self.spark.createDataFrame([], f"entity string, features {_FEATURE}") if found is None else found


def maintain_features(
    spark: SparkSession,
    path: str,
    entity: str,
    event_type: Column,
    time: str,
    as_of_us: int | None = None,
    total: str | None = None,
    work_dir: str | None = None,
    max_bytes: int = 64 << 30,
    max_files: int | None = None,
    repeats_within: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """entity and features, a map from event type to (n, latest_us, total), of the events in a parquet folder.

    Runs the stream over what has arrived and ends; called again with the same work_dir, it goes on from its
    checkpoint with the files that are new. Only events before as_of_us count; a work_dir is for one as_of_us, and another one
    is refused, since events that were left out would be missing. A micro-batch takes max_bytes at most, and no
    more than half of what there is (or max_files, if given). Every event ever seen is held in state, a key of some 50
    bytes each on disk, unless repeats_within says how long after an event's time a repeat may come: then events are
    forgotten after it, and later ones than that are dropped as late. The table lies in so many buckets, by default one for
    each 256 MiB of events that the first run finds, and at least 8; later runs go on with as many.

    Defined results: rows with null entity or time take no part; a null type is the type NONE; rows equal in entity, type and
    time are one event, of which the first received gives its total; null totals add nothing; no events give an empty table.
    """
    work_dir = work_dir or shared_path(spark, "entity-features")
    if exists(spark, f"{work_dir}/as_of") and read_text(spark, f"{work_dir}/as_of") != str(as_of_us):
        raise ValueError(f"{work_dir} holds features as of {read_text(spark, f'{work_dir}/as_of')}, not {as_of_us}")
    write_text(spark, f"{work_dir}/as_of", str(as_of_us))
    session = spark.newSession()
    for key, value in STATE_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    # The check refuses a second state in update mode because a watermark would not fit both; there is none here.
    session.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    most = min(max_bytes, max(1, total_bytes(spark, path) // 2 + 1))
    limit = {"maxFilesPerTrigger": str(max_files)} if max_files else {"maxBytesPerTrigger": str(most)}
    events = stream_table(session, path, **limit)
    if as_of_us is not None:
        events = events.where(F.col(f"`{time}`") < time_literal(events, time, as_of_us))
    picked = events.select(
        F.col(f"`{entity}`").cast("string").alias("entity"),
        F.coalesce(event_type, F.lit("NONE")).alias("event_type"),
        micros(events, time).alias("at"),
        (F.col(f"`{total}`").cast("double") if total else F.lit(None).cast("double")).alias("amount"),
    ).where("entity IS NOT NULL AND at IS NOT NULL")
    if repeats_within is None:
        once = picked.dropDuplicates(["entity", "event_type", "at"])
    else:
        watermarked = picked.withColumn("_mark", F.timestamp_micros("at")).withWatermark("_mark", f"{duration_us(repeats_within)} microseconds")
        once = watermarked.dropDuplicatesWithinWatermark(["entity", "event_type", "at"])
    counted = once.groupBy("entity", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("latest_us"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    if exists(spark, f"{work_dir}/buckets"):
        buckets = int(read_text(spark, f"{work_dir}/buckets"))
    buckets = buckets or max(8, total_bytes(spark, path) // (256 << 20))
    write_text(spark, f"{work_dir}/buckets", str(buckets))
    features = FeatureTable(spark, f"{work_dir}/features", buckets)
    counted.writeStream.outputMode("update").foreachBatch(features.upsert).option("checkpointLocation", f"{work_dir}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return features.now()


def feature_rows(features: DataFrame) -> DataFrame:
    """One row per entity and event type: entity, event_type, n, latest_us, total."""
    return features.select("entity", F.explode("features").alias("event_type", "f")).select("entity", "event_type", "f.*")


def wide(features: DataFrame, event_types: list[str], as_of_us: int) -> DataFrame:
    """One row per entity with n_, recency_us_ and total_ columns for each of the named event types."""
    columns = []
    for t in event_types:
        f = F.try_element_at("features", F.lit(t))
        columns += [
            F.coalesce(f["n"], F.lit(0)).alias(f"n_{t}"),
            (F.lit(as_of_us) - f["latest_us"]).alias(f"recency_us_{t}"),
            F.coalesce(f["total"], F.lit(0.0)).alias(f"total_{t}"),
        ]
    return features.select("entity", *columns)
