"""Balance: joins with a few heavy keys, inputs with too few splits, size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 256
SALTS = 64
#: Bytes of text in one task of word-level work; its word rows take about ten times as much.
TASK_BYTES = 8 << 20


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS) -> DataFrame:
    """The ``limit`` most frequent keys.

    Counting is combined on the map side and the cut is a distributed top-k, so
    the result has at most ``limit`` rows and every key left out holds less than
    ``1/limit`` of the rows.
    """
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), key).limit(limit).select(key)
    )


def salted_join(
    big: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "inner",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` to ``dim`` (unique on ``key``) with the hot keys of ``big`` spread out.

    ``spread_by`` must be a stable column of ``big`` (an id), so that a task that
    is run again salts its rows the same way.  Only the rows of ``dim`` whose key
    is hot are copied, at most ``HOT_KEYS * salts`` rows.
    """
    hot = (hot if hot is not None else hot_keys(big, key)).select(F.col(key).alias("_hot"))
    flag = F.broadcast(hot)  # at most HOT_KEYS rows by construction
    left = (
        big.join(flag, big[key] == flag["_hot"], "left")
        .withColumn("_salt", F.when(F.col("_hot").isNull(), 0)
                    .otherwise(F.pmod(F.xxhash64(spread_by), F.lit(salts))).cast("long"))
        .drop("_hot")
    )
    right = (
        dim.join(flag, dim[key] == flag["_hot"], "left")
        .withColumn("_salt", F.explode(
            F.when(F.col("_hot").isNull(), F.array(F.lit(0).cast("long")))
            .otherwise(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
        .drop("_hot")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a stored table has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread by ``key`` when the input comes in fewer splits than there are cores.

    A table of one or two files would keep all text work in one or two tasks.  An
    input with enough splits, and any stream, is left as it is.  Meant for scans:
    counting the partitions of a plan with a shuffle would run it.
    """
    if df.isStreaming or df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(key)


def parts_of(df: DataFrame, column: str, task_bytes: int | None = None) -> int:
    """Tasks for word-level work with about ``task_bytes`` of text each; reads ``column`` once more."""
    held = df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return held // (task_bytes or TASK_BYTES) + 1


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows partitioned by ``key`` into ``parts``, which are not merged again; into the session's number where there are
    fewer parts than cores."""
    few = parts < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df.repartition(parts, key)
