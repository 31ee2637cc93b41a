"""Records of two tables matched by nearest time within an entity, by a stateful streaming join.

Both sides stream into one stateful operator that buffers them per entity. A left row is emitted once the watermark
has passed its tolerance horizon (its time plus the tolerance), when no nearer right row can come any more; right
rows are evicted once no buffered or coming left row can reach them.

Entities are cut into time chunks, and right rows are given to every chunk within the tolerance of them, so an entity
with a third of all rows is many small groups. Chunks are hashed into buckets, and each bucket's buffers are one state value that
is matched with array operations; a state value per entity would spend its time on calls.

A table at rest is replayed in order of event time: it is staged once in time slices, a folder each, and these arrive one
after the other, each as one micro-batch of one query. So disorder in the table costs neither lateness nor rows, rows come out
while later slices still wait, and the state holds one slice and the tolerance. A table of any size has several slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.runtime import micros, shared_path
from lodestream.streaming.entity_features import STATE_CONF
from lodestream.streaming.files import delete, folders, move
from lodestream.streaming.runner import CENTURY_US, END_US

HOUR_US = 3_600_000_000
ALWAYS = np.iinfo(np.int64).max
#: Slices of a replay: at least and at most.
FEWEST, MOST = 4, 256
#: Beyond so many rows the slices are gathered by a shuffle, since every task would write a file for each.
GATHERED = 500_000_000
#: The side of a row that closes a stream.
CLOSING = 2
_PAIRS = "left_id string, right_id string, gap_us bigint"
_STAGED = "entity string, chunk bigint, at bigint, side int, id string"


def match_nearest(left: pd.DataFrame, right: pd.DataFrame, tolerance: int, chunk_us: int) -> np.ndarray:
    """For each left row (entity, chunk, at) the index of its right row, or -1.

    Nearest in time within the group; of equally near rows the earlier, then the lower id. right must be sorted by
    (entity, chunk, at, id).
    """
    if not len(left) or not len(right):
        return np.full(len(left), -1)
    groups = pd.MultiIndex.from_frame(right[["entity", "chunk"]])
    codes, unique = pd.factorize(groups)
    code = unique.get_indexer(pd.MultiIndex.from_frame(left[["entity", "chunk"]]))
    span = chunk_us + 4 * tolerance + 2
    at_right = codes * span + (right["at"].to_numpy() - right["chunk"].to_numpy() * chunk_us + tolerance)
    at_left = code * span + (left["at"].to_numpy() - left["chunk"].to_numpy() * chunk_us + tolerance)
    later = np.searchsorted(at_right, at_left)
    has_later, has_earlier = later < len(right), later > 0
    far = np.iinfo(np.int64).max
    after = np.where(has_later, at_right[np.minimum(later, len(right) - 1)] - at_left, far)
    before_at = at_right[np.maximum(later - 1, 0)]
    before = np.where(has_earlier, at_left - before_at, far)
    earlier = np.searchsorted(at_right, before_at)  # the first of those at the same time has the lowest id
    pick = np.where(before <= after, earlier, later)
    return np.where((code >= 0) & (np.minimum(before, after) <= tolerance), pick, -1)


def _pack(left: pd.DataFrame, right: pd.DataFrame) -> bytes:
    """Buffers of both sides as one compressed Arrow message."""
    both = pd.concat([left.assign(side=0), right.assign(side=1)], ignore_index=True)
    schema = pa.schema([("entity", pa.string()), ("chunk", pa.int64()), ("at", pa.int64()), ("id", pa.string()), ("side", pa.int8())])
    rows = pa.Table.from_pandas(both.sort_values(["side", "entity", "at"]), schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(held: bytes) -> tuple[pd.DataFrame, pd.DataFrame]:
    both = pa.ipc.open_stream(held).read_pandas()
    names = ["entity", "chunk", "at", "id"]
    return both.loc[both["side"] == 0, names], both.loc[both["side"] == 1, names]


def _join(tolerance: int, chunk_us: int, keep_unmatched: bool):
    """The stateful operator. The watermark is a time, a century later than it is (see runner)."""
    names = ["entity", "chunk", "at", "id"]

    def over(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [_unpack(bytes(state.get[0]))] if state.exists else []
        for batch in batches:
            held.append((batch.loc[batch["side"] == 0, names], batch.loc[batch["side"] == 1, names]))
        left = pd.concat([h[0] for h in held], ignore_index=True) if held else pd.DataFrame(columns=names)
        right = pd.concat([h[1] for h in held], ignore_index=True) if held else pd.DataFrame(columns=names)
        now = state.getCurrentWatermarkMs()
        mark = ALWAYS if now * 1000 >= END_US else now * 1000 - CENTURY_US
        ready = (left["at"] < mark - tolerance).to_numpy(bool)
        if ready.any():
            right = right.sort_values(["entity", "chunk", "at", "id"], ignore_index=True)
            out = left[ready]
            pick = match_nearest(out, right, tolerance, chunk_us)
            found = pick >= 0
            ids = right["id"].to_numpy(object)[np.maximum(pick, 0)] if len(right) else np.full(len(out), None, object)
            times = right["at"].to_numpy()[np.maximum(pick, 0)] if len(right) else out["at"].to_numpy()
            result = pd.DataFrame(
                {"left_id": out["id"].to_numpy(), "right_id": np.where(found, ids, None), "gap_us": pd.array(times - out["at"].to_numpy(), "Int64")}
            )
            result.loc[~found, "gap_us"] = pd.NA
            yield result if keep_unmatched else result[found]
            left = left[~ready]
        oldest = min([int(mark), *([int(left["at"].min())] if len(left) else [])])
        right = right[right["at"] >= oldest - tolerance]
        if not len(left) and not len(right):
            if state.exists:
                state.remove()
            return
        state.update((_pack(left, right),))
        wake = int(left["at"].min() if len(left) else right["at"].max()) + tolerance
        state.setTimeoutTimestamp(max(min((wake + CENTURY_US) // 1000 + 2, END_US // 1000), now + 1))

    return over


def join_stream(staged: DataFrame, tolerance_us: int, chunk_us: int, buckets: int, lateness: str = "0 seconds", keep_unmatched: bool = False) -> DataFrame:
    """The streaming join over a stream of staged rows: left_id, right_id, gap_us (right minus left time).

    A row of side CLOSING lets all that waits go.
    """
    mark = F.when(F.col("side") == CLOSING, F.lit(END_US + HOUR_US)).otherwise(F.greatest(F.lit(1), F.least(F.col("at") + CENTURY_US, F.lit(END_US - 1))))
    return (
        staged.withColumn("ts", F.timestamp_micros(mark))
        .withWatermark("ts", lateness)
        .withColumn("bucket", F.pmod(F.xxhash64("entity", "chunk"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(
            _join(tolerance_us, chunk_us, keep_unmatched), _PAIRS, "held binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def side_rows(rows: DataFrame, entity: str, time: str, row_id: str, side: int, tolerance_us: int, chunk_us: int) -> DataFrame:
    """Rows in staged form; right rows (side 1) go to each chunk that a left row within the tolerance can be in."""
    at = micros(rows, time)
    chunk = lambda x: F.floor(x / F.lit(chunk_us))
    chunks = F.array(chunk(at)) if side == 0 else F.sequence(chunk(at - tolerance_us), chunk(at + tolerance_us))
    return rows.select(
        F.col(f"`{entity}`").cast("string").alias("entity"), chunks.alias("_chunks"), at.alias("at"), F.lit(side).alias("side"), F.col(f"`{row_id}`").cast("string").alias("id")
    ).where("entity IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL").select("entity", F.explode("_chunks").alias("chunk"), "at", "side", "id")


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_us: int,
    chunk_us: int = HOUR_US,
    rows_per_slice: int = 50_000_000,
    rows_per_bucket: int = 4_000,
    keep_unmatched: bool = False,
    report: list[int] | None = None,
) -> DataFrame:
    """left_id, right_id and gap_us of each left row and its nearest right row of the same entity.

    At most tolerance_us apart, limit included; of equally near right rows the earlier, then the lower id (as
    text). The result is whole: the tables are replayed in event-time slices of about rows_per_slice rows (at least FEWEST
    and at most MOST slices), so no row is late. Chunks are at least the tolerance long, so a right row is in three at most. report gets
    the number of rows that have come out after each slice. Defined results: rows with null entity, time or id take no part; equal left rows give equal result
    rows once each; left rows without partner give no row, or one with nulls if keep_unmatched; empty tables give an
    empty result (or the unmatched left rows); other columns are ignored, whatever their names.
    """
    if chunk_us < 1 or tolerance_us < 0:
        raise ValueError("chunk_us must be positive and tolerance_us not negative")
    chunk_us = max(chunk_us, tolerance_us)
    spark = left.sparkSession
    session = spark.newSession()
    for key, value in STATE_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the next slice's batch lets go what is ready
    work = shared_path(spark, "nearest")
    both = side_rows(left, entity, left_time, left_id, 0, tolerance_us, chunk_us).unionByName(side_rows(right, entity, right_time, right_id, 1, tolerance_us, chunk_us))
    cuts, n = _cuts([(left, left_time), (right, right_time)], rows_per_slice)
    slice_no = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    sliced = both.withColumn("slice", slice_no)
    if n > GATHERED:
        sliced = sliced.repartition("slice", F.pmod(F.xxhash64("entity", "chunk"), F.lit(-(-n // (MOST * 1_000_000)))))
    sliced.write.partitionBy("slice").option("compression", "zstd").parquet(f"{work}/rows")
    inbox, out = f"{work}/inbox", f"{work}/pairs"
    closing = session.createDataFrame([(None, None, None, CLOSING, None)], _STAGED)
    for k in (1, 2):  # the first ends event time, and in the batch of the second all that waits goes
        closing.write.parquet(f"{work}/closing{k}")
    closing.limit(0).write.parquet(f"{inbox}/none")
    buckets = min(1 << 16, max(32, n // rows_per_bucket // (len(cuts) + 1)))
    stream = session.readStream.schema(_STAGED).option("recursiveFileLookup", "true").parquet(inbox)
    query = (
        join_stream(stream, tolerance_us, chunk_us, buckets, keep_unmatched=keep_unmatched)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", f"{work}/checkpoint")
        .start()
    )
    try:
        slices = sorted(folders(spark, f"{work}/rows"), key=lambda name: int(name.split("=")[1]))
        for came in [*(f"rows/{name}" for name in slices), "closing1", "closing2"]:
            move(spark, f"{work}/{came}", f"{inbox}/{came.split('=')[-1]}")
            query.processAllAvailable()
            if report is not None:
                report.append(spark.read.schema(_PAIRS).parquet(out).count())
    finally:
        query.stop()
    for part in ("rows", "inbox", "checkpoint"):
        delete(spark, f"{work}/{part}")  # the pairs are all that is needed from here
    return spark.read.schema(_PAIRS).parquet(out).distinct()


def _cuts(tables: list[tuple[DataFrame, str]], rows_per_slice: int) -> tuple[list[int], int]:
    """Times between slices of about equal numbers of rows, from a sketch of both tables' times; and the number of rows."""
    at = [rows.select(micros(rows, time).alias("at")) for rows, time in tables]
    parts = ", ".join(str(k / MOST) for k in range(1, MOST))
    found = at[0].unionByName(at[1]).where("at IS NOT NULL").selectExpr(f"percentile_approx(at, array({parts}), 10000) AS cuts", "count(*) AS n").first()
    slices = min(MOST, max(FEWEST, -(-found["n"] // rows_per_slice)))
    return sorted({found["cuts"][k * MOST // slices - 1] for k in range(1, slices)} if found["cuts"] else set()), found["n"]
