"""Tables by key below a folder, kept up to date batch by batch.

Rows lie in buckets by the hash of their keys. Batch n writes the buckets that its keys fall into, below version=n, and a list
of the version each bucket is of; other buckets are neither read nor written. A batch that is replayed after a failure
starts from the list of batch n - 1 and writes the same again. Files that neither of the last two lists names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.streaming.files import delete, exists, folders, read_text, write_text

BUCKET = "key_bucket"


class KeyedTable:
    """A table by keys in buckets; schema is that of its rows, known from the first batch on."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int"))

    def listed(self, version: int) -> dict[str, int]:
        """Bucket to version, as of a version; empty before the first."""
        name = f"{self.path}/list-{version}.json"
        return json.loads(read_text(self.spark, name))["buckets"] if version >= 0 and exists(self.spark, name) else {}

    def last(self) -> int | None:
        name = f"{self.path}/last.json"
        return json.loads(read_text(self.spark, name))["version"] if exists(self.spark, name) else None

    def schema(self) -> T.StructType | None:
        name = f"{self.path}/schema.json"
        return T.StructType.fromJson(json.loads(read_text(self.spark, name))) if exists(self.spark, name) else None

    def rows(self, version: int, only: set[int] | None = None, session: SparkSession | None = None) -> DataFrame | None:
        """The rows as of a version, of some buckets only if they are named; None before the first."""
        session, kind = session or self.spark, self.schema()
        if kind is None:
            return None
        found = [f"{self.path}/version={v}/{BUCKET}={b}" for b, v in self.listed(version).items() if only is None or int(b) in only]
        return session.read.schema(kind).parquet(*found) if found else session.createDataFrame([], kind)

    def read(self) -> DataFrame | None:
        last = self.last()
        return None if last is None else self.rows(last)

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Make version from version - 1: combine(old rows of the batch's buckets, batch) gives these buckets' new rows."""
        session = batch.sparkSession
        before = self.listed(version - 1)
        touched: set[int] | None = None
        if before:  # else all that is there is in the batch
            batch = batch.persist()
            touched = {r[0] for r in self.bucket(batch).select(BUCKET).distinct().collect()}  # at most as many as there are buckets
        try:
            rows = combine(self.rows(version - 1, touched, session) if before else None, batch)
            if self.schema() is None:
                write_text(self.spark, f"{self.path}/schema.json", T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]).json())
            self.bucket(rows).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/version={version}")
        finally:
            if touched is not None:
                batch.unpersist()
        written = {name.split("=")[1]: version for name in folders(self.spark, f"{self.path}/version={version}")}
        touched = touched or set()
        after = {b: v for b, v in before.items() if int(b) not in touched} | written
        write_text(self.spark, f"{self.path}/list-{version}.json", json.dumps({"buckets": after}))
        write_text(self.spark, f"{self.path}/last.json", json.dumps({"version": version}))
        for b, v in self.listed(version - 2).items():
            if before.get(b) != v and after.get(b) != v:
                delete(self.spark, f"{self.path}/version={v}/{BUCKET}={b}")
        delete(self.spark, f"{self.path}/list-{version - 2}.json")
