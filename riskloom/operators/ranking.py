"""Global ranks, quantile cuts and running totals without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_HEX = 4  # 65,536 hash buckets per stratum


def seeded_hash(key: str | Column, seed: int) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), column.cast("string")))


def hash_thresholds(
    df: DataFrame, stratum: str, key: str, seed: int, cuts: dict[str, tuple[int, int]]
) -> DataFrame:
    """For every stratum and cut ``(a, b)``: the hash of its ``floor(n*a/b)``-th row in hash order.

    Two reads of two columns.  The first counts rows per hash prefix; running
    totals of those counts tell which prefix holds each cut.  The second ranks
    only the rows of these few prefixes.  Nothing is sorted per stratum, so a
    stratum may hold any share of the rows.  Columns: ``stratum, cut, last_hash,
    last_key`` (null where a cut takes no row).
    """
    hashed = df.select(F.col(stratum), F.col(key), seeded_hash(key, seed).alias("_h"))
    hashed = hashed.withColumn("_p", F.substring("_h", 1, PREFIX_HEX))

    per_prefix = hashed.groupBy(stratum, "_p").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    sized = per_prefix.withColumn("_upto", F.sum("_c").over(upto)).withColumn(
        "_n", F.sum("_c").over(Window.partitionBy(stratum))
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut"), F.expr(f"(_n * {a}) div {b}").alias("want"))
        for name, (a, b) in cuts.items()
    ])).alias("_w")
    holder = (
        sized.select(stratum, "_p", "_c", "_upto", wanted)
        .where((F.col("_w.want") <= F.col("_upto")) & (F.col("_w.want") > F.col("_upto") - F.col("_c")))
        .select(stratum, "_p", F.col("_w.cut").alias("cut"), (F.col("_w.want") - F.col("_upto") + F.col("_c")).alias("_r"))
    )
    # at most one row per stratum and cut: small enough to prune the second read by prefix
    near = hashed.join(F.broadcast(holder.select(stratum, "_p").distinct()), [stratum, "_p"], "left_semi")
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key)))
    return ranked.join(
        F.broadcast(holder), [stratum, "_p"]
    ).where(F.col("_rank") == F.col("_r")).select(
        stratum, "cut", F.col("_h").alias("last_hash"), F.col(key).alias("last_key")
    )


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    values: Sequence[str],
    blocks: Sequence[Column] = (),
) -> DataFrame:
    """Add ``<value>_upto``: the running total of each value within ``group`` in ``order``.

    ``blocks`` are coarse-to-fine bucket expressions that never decrease in
    ``order``.  Totals per block are summed first (combined on the map side), the
    running totals of the blocks become offsets, and rows are ordered only inside
    a finest block, so one large group is spread over many tasks.
    """
    group = list(group)
    names = [f"_b{i}" for i in range(len(blocks))]
    for name, expression in zip(names, blocks):
        df = df.withColumn(name, expression)
    return _prefix(df, group, list(order), list(values), names).drop(*names)


def _prefix(df: DataFrame, group: list[str], order: list[Column], values: list[str], names: list[str]) -> DataFrame:
    keys = group + names
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not names:
        return df.select("*", *[F.sum(v).over(within).alias(f"{v}_upto") for v in values])
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    totals = _prefix(totals, group, [F.col(names[-1])], values, names[:-1])
    offsets = totals.select(*keys, *[(F.col(f"{v}_upto") - F.col(v)).alias(f"_before_{v}") for v in values])
    return (
        df.join(offsets, keys)
        .select("*", *[
            (F.col(f"_before_{v}") + F.sum(v).over(within)).alias(f"{v}_upto") for v in values])
        .drop(*[f"_before_{v}" for v in values])
    )


def unit_blocks(score: Column, bits: tuple[int, ...] = (12, 24)) -> list[Column]:
    """Coarse-to-fine buckets of a score in [0, 1]; scores outside share the end buckets."""
    clipped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return [F.floor(clipped * float(1 << b)) for b in bits]
