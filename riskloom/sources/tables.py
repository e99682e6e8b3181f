"""Append-only tables, result sinks and the feature cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.corpus import content_key


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order and type; absent ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(df: DataFrame, path: str, schema: T.StructType, partition_by: str | None = None) -> None:
    """Append rows; ids come with the rows, the table hands none out."""
    writer = conform(df, schema).write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def with_content_id(df: DataFrame, *columns: str, out: str = "id") -> DataFrame:
    """64-bit id from the row's content: a row stored twice by a retry has one id."""
    return df.withColumn(out, F.xxhash64(content_key(*columns)))


def append_metrics(metrics: DataFrame, path: str, run: dict[str, str]) -> None:
    """Training summary: metrics of a run, with its settings as columns, appended."""
    tagged = metrics.select(*[F.lit(v).alias(k) for k, v in run.items()], "*")
    tagged.write.mode("append").parquet(path)


def write_partitioned_by_day(df: DataFrame, path: str, time: str = "timestamp") -> None:
    """Date-partitioned table, so that retention and trailing windows prune whole days."""
    df.withColumn("day", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def table_digest(df: DataFrame, *columns: str) -> str:
    """Digest of a table's content, whatever its row order."""
    row = F.xxhash64(*[F.col(c) for c in columns])
    high, low = F.shiftright(row, 32), row.bitwiseAND(F.lit(0xFFFFFFFF))
    got = df.agg(
        F.count("*").alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low"), F.bit_xor(row).alias("x")).first()
    return f"{got['n']}-{(got['high'] or 0) & 0xFFFFFFFFFFFF:x}-{(got['low'] or 0) & 0xFFFFFFFFFFFF:x}-{(got['x'] or 0) & (2**64 - 1):x}"


def feature_cache(df: DataFrame, build, path: str, name: str, *content: str) -> DataFrame:
    """Features computed once per (name, content): a stored table keyed by the content's digest."""
    spark = df.sparkSession
    at = f"{path.rstrip('/')}/{name}/{table_digest(df, *content)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(at + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build(df).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
