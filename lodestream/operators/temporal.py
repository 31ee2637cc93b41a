"""Time primitives: validity intervals, as-of joins, joins of histories, changelogs, and the first, latest and distinct
rows. Times are compared in microseconds; ties are settled by the order columns that callers name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.runtime import micros

DAY_US = 86_400_000_000
VALID_TO = "_valid_to"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _meet(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls equal to each other; right's other columns are added to left's."""
    names = {c: f"_j{i}" for i, c in enumerate(columns)}
    renamed = right.select(*(_q(c).alias(names.get(c, c)) for c in right.columns))
    same = reduce(lambda a, b: a & b, [_q(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(renamed, same, how).drop(*names.values())


def next_time(df: DataFrame, keys: list[str], at: str, into: str, bucket_us: int = DAY_US) -> DataFrame:
    """df with the next time of its key's rows in the column into (microseconds; null for the last).

    Rows are ordered within time buckets of a key, and buckets among themselves, of which a key has at most
    span / bucket_us: no key is ordered as a whole.
    """
    rows = df.withColumn("_nb", F.floor(_q(at) / F.lit(bucket_us)))
    buckets = Window.partitionBy(*map(_q, keys)).orderBy("_nb")
    firsts = rows.groupBy(*map(_q, keys), "_nb").agg(F.min(_q(at)).alias("_first")).withColumn("_later", F.lead("_first").over(buckets))
    later = firsts.where("_later IS NOT NULL").drop("_first")
    within = Window.partitionBy(*map(_q, keys), "_nb").orderBy(_q(at))
    ahead = rows.withColumn(into, F.lead(_q(at)).over(within))
    met = _meet(ahead, later, [*keys, "_nb"], "left")
    return met.select(*map(_q, df.columns), F.coalesce(_q(into), F.col("_later")).alias(into))


def validity(df: DataFrame, keys: list[str], ts: str, order: list[str] | None = None, bucket_us: int = DAY_US) -> DataFrame:
    """An upsert history: each row with _valid_to, the time of its key's next row (null while it is current).

    Of rows of one key at the same time the last by order stays; rows without time don't.
    """
    at_once = Window.partitionBy(*map(_q, keys), _q(ts)).orderBy(*(_q(c).desc() for c in order or [ts]))
    rows = df.where(_q(ts).isNotNull()).withColumn("_rn", F.row_number().over(at_once)).where("_rn = 1").drop("_rn").withColumn("_at_us", micros(df, ts))
    made = next_time(rows, keys, "_at_us", "_next_us", bucket_us)
    kind = df.schema[ts].dataType
    return made.withColumn(VALID_TO, F.timestamp_micros("_next_us").cast(kind)).drop("_at_us", "_next_us")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    fields: dict[str, str],
    low_us: int | None = None,
    high_us: int = 0,
    how: str = "left",
    order: list[str] | None = None,
    bucket_us: int = DAY_US,
    found: str | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time plus high_us.

    fields: right column to output name. Right rows more than low_us before the left time don't count (both bounds
    are inclusive; None is forever). how: "inner" drops left rows without a right row. found: name of a column that
    tells whether there was one. Left rows with null keys or time match nothing.

    Time is cut into buckets, so no key is ordered as a whole: the latest right row of each bucket is carried to the
    key's later buckets over one row per (key, bucket), and rows meet within their bucket in one sort, right side first.
    """
    order = order or []
    keys = [f"_k{i}" for i in range(len(on))]
    picked = F.struct(*(_q(c).alias(f"v{i}") for i, c in enumerate(fields)), micros(right, right_ts).alias("at"))
    rights = right.select(
        *(_q(r).alias(k) for (_, r), k in zip(on, keys, strict=True)),
        micros(right, right_ts).alias("_t"),
        F.struct(micros(right, right_ts).alias("at"), *(_q(c).alias(f"o{i}") for i, c in enumerate(order))).alias("_o"),
        picked.alias("_r"),
    ).dropna(subset=["_t", *keys])
    rights = rights.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    lefts = left.select(
        *(_q(le).alias(k) for (le, _), k in zip(on, keys, strict=True)), (micros(left, left_ts) + F.lit(high_us)).alias("_t"), F.struct(*map(_q, left.columns)).alias("_l")
    )
    # rows that can match nothing are spread over buckets of their own, whatever their number
    able = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_t").isNotNull())
    lefts = lefts.withColumn("_b", F.when(able, F.floor(F.col("_t") / F.lit(bucket_us))).otherwise(F.xxhash64(*(F.col(f"_l.`{f.name}`") for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)))))
    spots = (
        rights.groupBy(*keys, "_b").agg(F.max(F.struct("_o", "_r")).alias("_top"))
        .unionByName(lefts.select(*keys, "_b").dropna().distinct(), allowMissingColumns=True)
        .groupBy(*keys, "_b")
        .agg(F.max("_top").alias("_top"))
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spots.select(*keys, "_b", F.last("_top", ignorenulls=True).over(before).alias("_c"))
        .where("_c IS NOT NULL")
        .select(*keys, "_b", F.col("_c._o.at").alias("_t"), F.col("_c._o").alias("_o"), F.col("_c._r").alias("_r"))
    )
    both = rights.select(*keys, "_b", "_t", "_o", "_r").unionByName(carried).unionByName(lefts.select(*keys, "_b", "_t", "_l"), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_l").isNotNull(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_m", F.last("_r", ignorenulls=True).over(within)).where("_l IS NOT NULL")
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_t").isNotNull())
    if low_us is not None:
        complete = complete & (F.col("_m.at") >= F.col("_t") - F.lit(high_us) - F.lit(low_us))
    met = met.withColumn("_m", F.when(complete, F.col("_m")))
    if how == "inner":
        met = met.where("_m IS NOT NULL")
    extra = [F.col("_m").isNotNull().alias(found)] if found else []
    return met.select("_l.*", *(F.col(f"_m.v{i}").alias(name) for i, name in enumerate(fields.values())), *extra)


FAR = 2**62


def history_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    fields: dict[str, str],
    how: str = "left",
    overlapping: bool = False,
    bucket_us: int = DAY_US,
) -> DataFrame:
    """Join of two histories (with _valid_to): a row for each common part of their intervals, from ts to _valid_to.

    Half-open intervals; parts of no length don't count. how "left" also gives the parts of left intervals in which
    no right row is valid, with nulls. Right rows join on all their keys, and a key's intervals don't overlap.

    A common part begins where the later of its two intervals does. So each row needs the last row of the other side
    before it and the next right row after it, and never all intervals of its key. These are found in one order of both
    sides within time buckets; what reaches into a bucket from others is carried over one row per (key, bucket).
    """
    if overlapping:
        return _overlap_join(left, right, on, left_ts, right_ts, fields, how)
    keys = [f"_k{i}" for i in range(len(on))]
    lefts = left.select(
        *(_q(le).alias(k) for (le, _), k in zip(on, keys, strict=True)),
        micros(left, left_ts).alias("_t"),
        F.struct(F.struct(*(_q(c) for c in left.columns if c not in (left_ts, VALID_TO))).alias("v"), F.coalesce(micros(left, VALID_TO), F.lit(FAR)).alias("to")).alias("_l"),
    ).where("_t < _l.to")
    rights = right.select(
        *(_q(r).alias(k) for (_, r), k in zip(on, keys, strict=True)),
        micros(right, right_ts).alias("_t"),
        F.struct(F.struct(*(_q(c).alias(f"v{i}") for i, c in enumerate(fields))).alias("v"), F.coalesce(micros(right, VALID_TO), F.lit(FAR)).alias("to")).alias("_r"),
    ).where("_t < _r.to")
    rows = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    is_right = F.col("_r").isNotNull()
    spots = rows.groupBy(*keys, "_b").agg(
        F.max_by("_l", F.when(~is_right, F.col("_t"))).alias("_pl"), F.max_by("_r", F.when(is_right, F.col("_t"))).alias("_pr"), F.min(F.when(is_right, F.col("_t"))).alias("_nx")
    )
    buckets = Window.partitionBy(*keys).orderBy("_b")
    before, behind = buckets.rowsBetween(Window.unboundedPreceding, -1), buckets.rowsBetween(1, Window.unboundedFollowing)
    around = spots.select(
        *keys, "_b", F.last("_pl", ignorenulls=True).over(before).alias("_pl"), F.last("_pr", ignorenulls=True).over(before).alias("_pr"), F.first("_nx", ignorenulls=True).over(behind).alias("_nx")
    )
    # at one time right rows come first: a left row sees the right row of its time, a right row only earlier left rows
    within = Window.partitionBy(*keys, "_b").orderBy("_t", ~is_right)
    past, ahead = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(1, Window.unboundedFollowing)
    seen = rows.select(
        *keys, "_b", "_t", "_l", "_r",
        F.last("_l", ignorenulls=True).over(past).alias("_wl"),
        F.last("_r", ignorenulls=True).over(past).alias("_wr"),
        F.first(F.when(is_right, F.col("_t")), ignorenulls=True).over(ahead).alias("_wn"),
    )
    met = _meet(seen, around, [*keys, "_b"]).select(
        "_t",
        F.coalesce("_l", "_wl", "_pl").alias("_l"),
        F.coalesce("_r", "_wr", "_pr").alias("_r"),
        F.coalesce("_wn", "_nx", F.lit(FAR)).alias("_n"),
    )
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_l.to") > F.col("_t")) & (F.col("_r.to") > F.col("_t"))
    end = F.least("_l.to", "_r.to")
    hit = F.when(both, F.struct(F.col("_t").alias("s"), end.alias("e"), F.col("_r.v").alias("r")))
    parts = F.array(hit)
    if how == "left":
        # where no right row is valid: after the common part, or from the left row's start, until the next right row
        start = F.when(both, end).otherwise(F.col("_t"))
        stop = F.least("_l.to", "_n")
        lonely = F.col("_l").isNotNull() & (F.col("_l.to") > F.col("_t")) & (start < stop)
        gap = F.when(lonely, F.struct(start.alias("s"), stop.alias("e"), F.lit(None).cast(rights.schema["_r"].dataType["v"].dataType).alias("r")))
        parts = F.array(hit, gap)
    out = met.select("_l", F.explode(parts).alias("_x")).where("_x IS NOT NULL")
    return out.select(
        "_l.v.*",
        F.timestamp_micros("_x.s").alias(left_ts),
        *(F.col(f"_x.r.v{i}").alias(name) for i, name in enumerate(fields.values())),
        F.when(F.col("_x.e") < FAR, F.timestamp_micros("_x.e")).alias(VALID_TO),
    )


#: Time blocks of _overlap_join: days, and four times as long at each level, up to all of time.
LEVELS = 12
RADIX = 4
LAST_US = 253_402_300_800_000_000  # the year 10000


def _blocks(low: Column, high: Column) -> Column:
    """The blocks (level, no) that exactly cover the days from low to high: at most 2 * (RADIX - 1) per level."""
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(none)

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        up_low = F.when(level < LEVELS - 1, F.ceil(low / RADIX)).otherwise(F.lit(1))
        up_high = F.when(level < LEVELS - 1, F.floor((high + 1) / RADIX) - 1).otherwise(F.lit(0))
        numbers = F.when(up_low <= up_high, F.concat(run(low, up_low * RADIX - 1), run((up_high + 1) * RADIX, high))).otherwise(run(low, high))
        made = F.transform(numbers, lambda b: F.struct(level.alias("level"), b.alias("no")))
        return F.struct(
            F.when(up_low <= up_high, up_low).otherwise(F.lit(1)).cast("bigint").alias("low"),
            F.when(up_low <= up_high, up_high).otherwise(F.lit(0)).cast("bigint").alias("high"),
            F.concat(state["made"], made).alias("made"),
        )

    start = F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), F.array().cast("array<struct<level: int, no: bigint>>").alias("made"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda state: state["made"])


def _overlap_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_ts: str, right_ts: str, fields: dict[str, str], how: str) -> DataFrame:
    """history_join for left rows of one key that are valid at once.

    A common part begins with the left row, where the right row valid at that time is found as of it, or with a right row
    that begins while the left one is valid. For the latter, each left interval is cut into few blocks of days of growing
    length, and a right row's beginning lies in one block of each length: an equi-join on (key, block), in which only
    rows that belong together meet, and in which a crowded key is many groups. A right row brings along the gap
    up to its key's next, so nothing is ordered per left row.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    lefts = left.select(
        *(_q(le).alias(k) for (le, _), k in zip(on, keys, strict=True)),
        F.struct(*(_q(c) for c in left.columns if c not in (left_ts, VALID_TO))).alias("_l"),
        micros(left, left_ts).alias("_from"),
        F.coalesce(micros(left, VALID_TO), F.lit(FAR)).alias("_to"),
    ).where("_from < _to")
    rights = right.select(
        *(_q(r).alias(k) for (_, r), k in zip(on, keys, strict=True)),
        F.struct(*(_q(c).alias(f"v{i}") for i, c in enumerate(fields))).alias("_r"),
        micros(right, right_ts).alias("_rfrom"),
        F.coalesce(micros(right, VALID_TO), F.lit(FAR)).alias("_rto"),
    ).where("_rfrom < _rto")
    rights = next_time(rights, keys, "_rfrom", "_next").withColumn("_next", F.coalesce("_next", F.lit(FAR)))
    # before a key's first right row stands one that is valid for no time
    none = F.lit(None).cast(rights.schema["_r"].dataType)
    ahead = rights.groupBy(*keys).agg(F.min("_rfrom").alias("_next")).select(*keys, none.alias("_r"), F.lit(-FAR).alias("_rfrom"), F.lit(-FAR).alias("_rto"), "_next")
    entry = {"_r": "_r", "_rto": "_rto", "_next": "_next"}
    begun = asof_join(lefts, rights.unionByName(ahead), [(k, k) for k in keys], "_from", "_rfrom", entry, found="_any").withColumn("_s", F.col("_from"))
    day = lambda c: F.floor(c / F.lit(DAY_US))
    cut = lefts.withColumn("_block", F.explode(_blocks(day(F.col("_from")), day(F.least(F.col("_to"), F.lit(LAST_US)) - 1)))).select(*keys, "_l", "_from", "_to", "_block.level", "_block.no")
    spots = F.array(*(F.struct(F.lit(level).alias("level"), F.floor(day(F.col("_rfrom")) / RADIX**level).alias("no")) for level in range(LEVELS)))
    spread = rights.withColumn("_block", F.explode(spots)).select(*keys, "_r", "_rfrom", "_rto", "_next", "_block.level", "_block.no")
    later = cut.join(spread, [*keys, "level", "no"]).where("_from < _rfrom AND _rfrom < _to").withColumns({"_s": F.col("_rfrom"), "_any": F.lit(True)})
    columns = ["_l", "_to", "_s", "_r", "_rto", "_next", "_any"]
    met = begun.select(*columns).unionByName(later.select(*columns))
    end = F.least("_to", "_rto")
    both = F.col("_any") & (F.col("_rto") > F.col("_s"))
    parts = [F.when(both, F.struct(F.col("_s").alias("s"), end.alias("e"), F.col("_r").alias("r")))]
    if how == "left":
        start = F.when(both, end).otherwise(F.col("_s"))
        stop = F.least("_to", F.coalesce("_next", F.lit(FAR)))
        parts.append(F.when(start < stop, F.struct(start.alias("s"), stop.alias("e"), none.alias("r"))))
    out = met.select("_l", F.explode(F.array(*parts)).alias("_x")).where("_x IS NOT NULL")
    return out.select(
        "_l.*",
        F.timestamp_micros("_x.s").alias(left_ts),
        *(F.col(f"_x.r.v{i}").alias(name) for i, name in enumerate(fields.values())),
        F.when(F.col("_x.e") < FAR, F.timestamp_micros("_x.e")).alias(VALID_TO),
    )


def changelog(df: DataFrame, ts: str, delete: str | None = None, insert: str | None = None) -> DataFrame:
    """A history as a stream of its changes: every row at its time, and again at the end of its validity.

    The column delete (or insert) tells which is which.
    """
    if (delete is None) == (insert is None):
        raise ValueError("give one of delete and insert")
    name, gone = (delete, True) if delete else (insert, False)
    moments = F.array(F.struct(_q(ts).alias("at"), F.lit(not gone).alias("flag")), F.struct(_q(VALID_TO).alias("at"), F.lit(gone).alias("flag")))
    columns = [c for c in df.columns if c not in (ts, VALID_TO)]
    return (
        df.select(*map(_q, columns), F.explode(moments).alias("_m"))
        .where("_m.at IS NOT NULL")
        .select(*map(_q, columns), F.col("_m.at").alias(ts), F.col("_m.flag").alias(name))
    )


def first_rows(df: DataFrame, keys: list[str], ts: str, order: list[str] | None = None) -> DataFrame:
    """The earliest row of each key; aggregated before the shuffle, so busy keys cost no more than others."""
    columns = [c for c in df.columns if c not in keys]
    rank = F.struct(_q(ts), *map(_q, order or []))
    return df.groupBy(*map(_q, keys)).agg(F.min_by(F.struct(*map(_q, columns)), rank).alias("_f")).select(*map(_q, keys), "_f.*").select(*map(_q, df.columns))


def number_sessions(df: DataFrame, by: list[str], at: str, gap_us: int, inclusive: bool, into: str, order: list[str] | None = None, bucket_us: int = DAY_US) -> DataFrame:
    """df with the start of its session per by in the column into; at is in microseconds and not null.

    A session begins when more than gap_us have passed since the row before (inclusive: at least gap_us). Starts are
    found within time buckets, and carried over one row per (by, bucket), so no value of by is ordered as a whole.
    """
    wide = lambda passed: passed >= F.lit(gap_us) if inclusive else passed > F.lit(gap_us)
    rows = df.withColumn("_b", F.floor(_q(at) / F.lit(bucket_us)))
    within = Window.partitionBy(*map(_q, by), "_b").orderBy(_q(at), *map(_q, order or []))
    over = Window.partitionBy(*map(_q, by)).orderBy("_b")
    flagged = rows.withColumn("_start", F.when(wide(_q(at) - F.lag(_q(at)).over(within)), _q(at)))
    buckets = flagged.groupBy(*map(_q, by), "_b").agg(F.min(_q(at)).alias("_first"), F.max(_q(at)).alias("_end"), F.max("_start").alias("_last"))
    # whether a bucket's first row begins a session, and the last start of the buckets before
    met = buckets.withColumn("_before", F.lag("_end").over(over))
    fresh = F.col("_before").isNull() | wide(F.col("_first") - F.col("_before"))
    met = met.withColumn("_open", F.when(fresh, F.col("_first"))).withColumn("_last", F.coalesce("_last", "_open"))
    carried = F.coalesce("_open", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    met = met.select(*map(_q, by), "_b", carried.alias("_carried"))
    started = flagged.withColumn("_start", F.last("_start", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return _meet(started, met, [*by, "_b"]).select(*map(_q, df.columns), F.coalesce("_start", "_carried").alias(into))


def dedup(
    df: DataFrame, by: list[str], ts: str, window_us: int | None = None, gap_us: int | None = None, order: list[str] | None = None, bucket_us: int = DAY_US
) -> DataFrame:
    """The last row of those equal in by and time; or in by within a tumbling window, or within a session.

    A new session begins when at least gap_us have passed since the last row of the same by.
    """
    rank = F.struct(_q(ts), *map(_q, order or []))
    everything = F.struct(*map(_q, df.columns))
    if gap_us is not None:
        source = number_sessions(df.withColumn("_at", micros(df, ts)).where("_at IS NOT NULL"), by, "_at", gap_us, True, "_no", order, bucket_us)
    else:
        source = df.withColumn("_no", micros(df, ts) if window_us is None else F.floor(micros(df, ts) / F.lit(window_us)))
    return source.groupBy(*map(_q, by), "_no").agg(F.max_by(everything, rank).alias("_last")).select("_last.*")


def explode_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns' lists side by side, an element of each per row; an empty or null list gives one row of null.

    Lists of one row must be of one length.
    """
    if not columns:
        raise ValueError("explode needs a column")
    sizes = [F.greatest(F.size(_q(c)), F.lit(0)) for c in columns]
    uneven = reduce(lambda a, b: a | b, [s != sizes[0] for s in sizes[1:]], F.lit(False))
    zipped = F.arrays_zip(*(F.coalesce(_q(c), F.array()).alias(f"e{i}") for i, c in enumerate(columns)))
    checked = F.when(uneven, F.raise_error(F.lit(f"lists of unequal length in {columns}")).cast(df.select(zipped.alias("z")).schema["z"].dataType)).otherwise(zipped)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*map(_q, rest), F.explode_outer(checked).alias("_e")).select(
        *(F.col(f"_e.e{columns.index(c)}").alias(c) if c in columns else _q(c) for c in df.columns)
    )


SAMPLE_BITS = 60


def hash_sample(df: DataFrame, rate: float, using: list[str]) -> DataFrame:
    """Rows whose hash of the columns falls below the rate: the same rows for the same values, everywhere.

    The hash is the first 60 bits of the MD5 of the columns' texts (null as an empty one after a mark), so any engine can
    draw the same sample, and rates have steps of 2**-60.
    """
    if not 0 <= rate <= 1:
        raise ValueError("a rate is between 0 and 1")
    text = F.concat_ws("\x1f", *(F.coalesce(_q(c).cast("string"), F.lit("\x00")) for c in using))
    drawn = F.conv(F.substring(F.md5(text), 1, SAMPLE_BITS // 4), 16, 10).cast("bigint")
    return df.where(drawn < F.lit(round(rate * 2**SAMPLE_BITS)))
