"""Parquet tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_table(spark: SparkSession, path: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A stream over a parquet table that is a folder of files or a single file."""
    schema = schema or spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern
    return spark.readStream.schema(schema).options(**options).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a folder, without hidden ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return [s.getPath().getName() for s in found if s.isDirectory() and s.getPath().getName()[0] not in "_."]


def move(spark: SparkSession, path: str, to: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(hadoop(path), hadoop(to))


def read_text(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def total_bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength())
