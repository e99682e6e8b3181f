"""Ensembles and error review over the long prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.evaluation import confidence_of
from riskloom.operators.ranking import seeded_hash

HIGH_CONFIDENCE = 0.9


def soft_vote(df: DataFrame, key: str = "key") -> DataFrame:
    """Mean probability of all models per row; positive above one half."""
    voted = df.groupBy(key).agg(
        F.avg("prob").alias("prob"), F.max("truth").alias("truth"), F.count("*").alias("n_models"))
    return voted.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def weighted_vote(df: DataFrame, weights: DataFrame, key: str = "key") -> DataFrame:
    """Mean probability weighted per model, e.g. by validation F1; one weight per model."""
    joined = df.join(F.broadcast(weights.select("model", "weight")), "model")  # one row per model
    total = F.sum("weight")
    voted = joined.groupBy(key).agg(
        F.when(total > 0, F.sum(F.col("prob") * F.col("weight")) / total).otherwise(0.0).alias("prob"),
        F.max("truth").alias("truth"),
    )
    return voted.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def error_rows(df: DataFrame) -> DataFrame:
    """Wrong rows with their bucket: FN or FP, at high or low confidence."""
    conf = confidence_of(F.col("pred"), F.col("prob"))
    kind = F.when(F.col("truth") == 1, "FN").otherwise("FP")
    level = F.when(conf >= HIGH_CONFIDENCE, "high").otherwise("low")
    return df.where(F.col("pred") != F.col("truth")).withColumn("bucket", F.concat_ws("_", kind, level))


def error_buckets(df: DataFrame) -> DataFrame:
    return error_rows(df).groupBy("model", "bucket").agg(F.count("*").alias("n_rows"))


def review_sample(errors: DataFrame, size: int = 50, seed: int = 42, key: str = "key") -> DataFrame:
    """``size`` rows per model and bucket in hash order.

    The rank filter is pushed below the shuffle as a per-task group limit, so a
    large bucket sends at most ``size`` rows per task.
    """
    order = Window.partitionBy("model", "bucket").orderBy(seeded_hash(key, seed), key)
    return errors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
