"""Activity grouped into sessions, by morphological closing of occupancy bitmaps.

The timeline of an entity is a bitmap with one bit per microsecond, set where the entity was active. Such a
bitmap is far too sparse to hold word by word, so it is held by its runs: half-open intervals of set bits.
Closing it with an element as long as the allowed gap fills every hole that does not end a session:

1. dilation: OR with itself shifted by 1, 2, 4, ... ticks until it has grown by the gap (doubling shifts);
2. the runs of the dilated bitmap are the sessions, each with the gap hanging over its end;
3. the counts of the set bits under each run are joined, and the overhang is trimmed.

Closing is idempotent and monotone, so it may be done in blocks of the timeline first and again over the runs
of the blocks. That keeps any entity, however busy, out of a single task: the first step is partitioned by
(entity, block), and the second sees at most span / gap + blocks runs of an entity, whatever its number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import micros

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def close_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Closing of the bitmaps of several groups at once.

    group, start, end: runs [start, end) sorted by group and start, not nested. Returns the index of the first
    run of each closed run, and the closed runs' ends. Holes of fewer than gap bits are filled, so two events
    at most gap ticks apart share a run.
    """
    first = np.arange(len(start))
    grown = 1
    while True:
        keep = np.ones(len(start), bool)
        if len(start) > 1:
            keep[1:] = (group[1:] != group[:-1]) | (start[1:] > end[:-1])
            if not keep.all():
                last = np.append(np.flatnonzero(keep)[1:] - 1, len(start) - 1)
                group, start, end, first = group[keep], start[keep], end[last], first[keep]
        if grown >= gap:
            return first, end - (grown - 1)
        shift = min(grown, gap - grown)
        end = end + shift
        grown += shift


_RUNS = "entity_kind string, entity_id string, start_us bigint, end_us bigint, n_events bigint"


def _closing(gap: int, keys: int):
    """Over Arrow batches sorted by the first keys columns and start_us; the rest are start_us, end_us, n_events."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch.columns, names=batch.schema.names)  # all fields nullable
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            change = np.zeros(rows.num_rows, bool)
            change[0] = True
            for k in range(keys):
                column = rows.column(k)
                change[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy()
            start, end, n = (rows.column(k).to_numpy() for k in range(keys, keys + 3))
            first, closed = close_runs(np.cumsum(change), start, end + 1, gap)
            total = np.add.reduceat(n, first)
            out = rows.take(pa.array(first))
            out = pa.table(
                [*(out.column(k) for k in range(keys)), pa.array(start[first]), pa.array(closed - 1), pa.array(total)],
                names=rows.column_names,
            )
            held = out.slice(out.num_rows - 1).combine_chunks()  # may go on in the next batch
            yield from out.slice(0, out.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return over


def sessionize(
    events: DataFrame,
    entities: dict[str, Column],
    time: str,
    distinct: list[str] | None = None,
    gap_us: int = 30 * MINUTE_US,
    block_us: int = DAY_US,
) -> DataFrame:
    """Sessions of each entity: entity_kind, entity_id, start_us, end_us, duration_us, n_events.

    entities: for each kind, the column that holds its entity. distinct: columns which, with entity and time,
    make an event; rows equal in them count once. A session ends when more than gap_us pass without an event;
    an event exactly gap_us after the last belongs to the same session. Defined results: rows with null entity
    or time take no part; nulls in distinct columns are equal to each other; events at the same time are
    counted apart if they differ in distinct; an empty input gives an empty result; other columns are ignored,
    whatever their names. The result does not depend on block_us.
    """
    if gap_us < 1 or block_us < 1:
        raise ValueError("gap_us and block_us must be positive")
    distinct = distinct or []
    kinds = [
        F.struct(F.lit(kind).alias("entity_kind"), column.cast("string").alias("entity_id"))
        for kind, column in entities.items()
    ]
    views = (
        events.select(
            F.explode(F.array(*kinds)).alias("_who"),
            micros(events, time).alias("_at"),
            *(F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(distinct)),
        )
        .where("_who.entity_id IS NOT NULL AND _at IS NOT NULL")
        .select(
            "_who.entity_kind",
            "_who.entity_id",
            F.floor(F.col("_at") / F.lit(block_us)).alias("_block"),
            F.col("_at").alias("start_us"),
            *(f"_d{i}" for i in range(len(distinct))),
        )
        .repartition("entity_kind", "entity_id", "_block")
    )
    if distinct:
        views = views.distinct()  # within the partitions at hand: no further shuffle
    runs = (
        views.groupBy("entity_kind", "entity_id", "_block", "start_us")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("entity_kind", "entity_id", "_block", "start_us", F.col("start_us").alias("end_us"), "n_events")
        .sortWithinPartitions("entity_kind", "entity_id", "_block", "start_us")
        .mapInArrow(_closing(gap_us, 3), "entity_kind string, entity_id string, _block bigint, start_us bigint, end_us bigint, n_events bigint")
        .drop("_block")
    )
    return (
        runs.repartition("entity_kind", "entity_id")
        .sortWithinPartitions("entity_kind", "entity_id", "start_us")
        .mapInArrow(_closing(gap_us, 2), _RUNS)
        .select("entity_kind", "entity_id", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
    )
