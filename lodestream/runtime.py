"""Session, tables, time and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings this engine relies on; everything else is left to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "lodestream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SESSION_CONF; conf wins over it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SESSION_CONF | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (local mode)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodestream-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


_made: list[str] = []
_exit_hook: list[bool] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; clean() deletes what was written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    if not _exit_hook:
        _exit_hook.append(True)
        atexit.register(_clean_at_exit, spark)
    return path


def clean(spark: SparkSession, since: int = 0) -> None:
    """Delete what this program has written below the shared folder, from its since-th path on. Frames made from it can't
    be read any more."""
    for path in _made[since:]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    del _made[since:]


def _clean_at_exit(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # the JVM is gone already
        pass


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[None]:
    """What is staged within it lives as long as it: results must be written or collected before its end. What is staged
    outside of any lifetime is deleted when the program ends."""
    since = len(_made)
    try:
        yield
    finally:
        clean(spark, since)


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written once as parquet below the shared folder and read back."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp column with or without zone, whatever the session's zone."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(f"`{column}`"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(f"`{column}`")).cast("bigint") * F.lit(86_400_000_000)
    return F.col(f"`{column}`").cast("bigint")


def time_literal(df: DataFrame, column: str, us: int) -> Column:
    """A time as a literal of a timestamp column's own type, so that comparisons with it reach the file scan."""
    at = datetime(1970, 1, 1) + timedelta(microseconds=us)
    text = at.isoformat(sep=" ", timespec="microseconds")
    return F.expr(f"TIMESTAMP_NTZ '{text}'" if isinstance(df.schema[column].dataType, T.TimestampNTZType) else f"TIMESTAMP '{text}Z'")


def utc(df: DataFrame) -> DataFrame:
    """Zone-less timestamp columns taken as UTC instants."""
    return df.select(
        *(
            F.timestamp_micros(micros(df, f.name)).alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows_per_salt: int = 20_000) -> DataFrame:
    """Inner join in which keys crowded on the left are spread over as many salts as they have blocks of rows.

    The right side is cut down to the keys that occur on the left, and repeated per salt. The list of crowded keys
    has at most rows / rows_per_salt entries.
    """
    counts = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("_salts"))
    spread = left.join(counts.where("_salts > 1"), keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))
    )
    repeated = right.join(counts, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return spread.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"]).drop("_salt")
