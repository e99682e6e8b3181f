"""Stratified splits, samples, oversampling and the union of training sets.

Membership depends only on the seed, the row's key and its class, so a split is
the same on any cluster and after any re-run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import rates
from riskloom.operators.ranking import hash_thresholds, seeded_hash

# Shares of the published splits, as (name, parts), and the seed.
SPLIT_80_10_10 = (("train", 8), ("val", 1), ("test", 1))
SPLIT_90_5_5 = (("train", 18), ("val", 1), ("test", 1))
SPLIT_70_15_15 = (("train", 14), ("val", 3), ("test", 3))
SPLIT_90_10 = (("train", 9), ("eval", 1))
SEED = 42


def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str = "class",
    parts: Sequence[tuple[str, int]] = SPLIT_80_10_10,
    strata: Sequence = ("non-suicide", "suicide"),
    seed: int = SEED,
    out: str = "split",
) -> DataFrame:
    """Label every row with its part; within a class the parts are cut in hash order.

    ``strata`` declares the classes.  The cut points are then at most
    ``len(strata) * len(parts)`` values, and the rows themselves are labelled in
    place: the corpus is neither sorted nor shuffled.  ``key`` must be unique.
    """
    total = sum(size for _, size in parts)
    names = [name for name, _ in parts]
    sums = [sum(size for _, size in parts[: i + 1]) for i in range(len(parts) - 1)]
    cuts = {name: (upto, total) for name, upto in zip(names, sums)}

    declared = df.where(F.col(stratum).isin(*strata))
    limits = hash_thresholds(declared, stratum, key, seed, cuts).groupBy(stratum).agg(*[
        F.max(F.when(F.col("cut") == name, F.struct("last_hash", "last_key"))).alias(f"_to_{i}")
        for i, name in enumerate(names[:-1])
    ])
    # one row per declared class
    tagged = df.join(F.broadcast(limits), stratum, "left")
    tagged = tagged.withColumn("_mine", F.struct(seeded_hash(key, seed).alias("last_hash"), F.col(key).alias("last_key")))
    label = F.when(
        ~F.coalesce(F.col(stratum).isin(*strata), F.lit(False)),
        F.raise_error(F.lit(f"{stratum} outside the declared classes {list(strata)}")).cast("string"),
    )
    for i, name in enumerate(names[:-1]):
        label = label.when(F.col("_mine") <= F.col(f"_to_{i}"), F.lit(name))
    tagged = tagged.withColumn(out, label.otherwise(F.lit(names[-1])))
    return tagged.select(*df.columns, out)


def fraction_sample(df: DataFrame, key: str, fraction: float = 0.1, seed: int = SEED) -> DataFrame:
    """Repeatable sample: rows whose seeded hash falls below ``fraction``; a plain filter."""
    limit = format(round(fraction * 16**8), "09x")
    prefix = F.concat(F.lit("0"), F.substring(seeded_hash(key, seed), 1, 8))
    return df.where(prefix < F.lit(limit))


def fixed_sample(df: DataFrame, key: str, size: int, seed: int = SEED) -> DataFrame:
    """``min(size, rows)`` rows, the first in hash order; planned as a top-k, not a sort."""
    return df.orderBy(seeded_hash(key, seed), key).limit(size)


def share_report(df: DataFrame, split: str = "split", label: str = "class") -> DataFrame:
    """Rows per split and class with the share of the whole and of the split."""
    cells = df.groupBy(split, label).agg(F.count("*").alias("n_rows"))
    in_split = F.sum("n_rows").over(Window.partitionBy(split))
    whole = cells.agg(F.sum("n_rows")).scalar()
    return cells.withColumn("_in", in_split).select(
        split, label, "n_rows",
        rates.percent(F.col("_in"), whole).alias("split_share"),
        rates.percent(F.col("n_rows"), F.col("_in")).alias("class_share"),
    )


def stratification_gap(df: DataFrame, split: str = "split", label: str = "class") -> DataFrame:
    """Per class: the largest difference between its share in a split and overall."""
    cells = df.groupBy(split, label).agg(F.count("*").alias("n"))
    whole = cells.agg(F.sum("n")).scalar()
    sized = (
        cells.withColumn("split_n", F.sum("n").over(Window.partitionBy(split)))
        .withColumn("class_n", F.sum("n").over(Window.partitionBy(label)))
    )
    gap = F.abs(F.col("n") / F.col("split_n") - F.col("class_n") / whole)
    return sized.groupBy(label).agg(
        F.round(F.max(gap), 6).alias("max_gap"), F.max("class_n").alias("n_rows"))


def oversample(df: DataFrame, times: int = 5) -> DataFrame:
    """Every row ``times`` times; replicate after projecting to the columns you need."""
    if times <= 1:
        return df
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def combine(original: DataFrame, feedback: DataFrame, times: int = 5) -> DataFrame:
    """Original rows and oversampled feedback rows, duplicates kept, incomplete rows dropped."""
    columns = ["text", "class"]
    extra = oversample(feedback.select(*columns), times)
    return original.select(*columns).unionByName(extra).na.drop("any")
