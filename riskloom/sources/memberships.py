"""Split memberships as stored bitmaps: many small rows instead of one document of ids.

A row holds 32,768 neighbouring ids of one split as bits.  Writing combines bits on the map side; picking rows looks a bit
up in the row's own bitmap, so ids are never listed again.  Ids are whole numbers from 0 on; others are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: bits of a bitmap in Spark's bitmap functions.
BITS = 32_768


def _slot(row_id: Column) -> Column:
    return F.when(row_id >= 0, row_id + 1).otherwise(F.raise_error(F.lit("memberships hold ids from 0 on")).cast("long"))


def _bucket(row_id: Column) -> Column:
    return F.bitmap_bucket_number(_slot(row_id))


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(1 << k) for k in range(8)]), (place % 8).cast("int")) > 0


def bitmaps(members: DataFrame, split: str = "split", row_id: str = "row_id") -> DataFrame:
    """``split, bucket, bits, n`` from ``split, row_id``; an id given twice is one bit."""
    ids = F.col(row_id)
    packed = members.where(ids.isNotNull()).groupBy(F.col(split).alias("split"), _bucket(ids).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_slot(ids))).alias("bits"))
    return packed.withColumn("n", F.bitmap_count("bits"))


def write_memberships(members: DataFrame, path: str, split: str = "split", row_id: str = "row_id") -> None:
    bitmaps(members, split, row_id).write.mode("overwrite").partitionBy("split").parquet(path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket long, bits binary, n long, split string").parquet(path)


def split_sizes(stored: DataFrame) -> DataFrame:
    """Rows per split, from the stored counts alone."""
    return stored.groupBy("split").agg(F.sum("n").alias("n_rows"))


def listed(stored: DataFrame) -> DataFrame:
    """``split, row_id`` again."""
    place = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda p: _has(F.col("bits"), p))
    return stored.select("split", "bucket", F.explode(place).alias("p")).select(
        "split", ((F.col("bucket") - 1) * BITS + F.col("p")).alias("row_id"))


def pick(df: DataFrame, stored: DataFrame, split: str, key: str) -> DataFrame:
    """The rows of ``df`` whose key is a member of ``split``.

    The bitmaps are joined on the bucket: 4 kB for 32,768 ids, an eighth of a byte each.
    """
    part = stored.where(F.col("split") == split).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    joined = df.where(F.col(key) >= 0).join(part, _bucket(F.col(key)) == F.col("_bucket"))
    return joined.where(_has(F.col("_bits"), F.bitmap_bit_position(_slot(F.col(key))))).select(*df.columns)
