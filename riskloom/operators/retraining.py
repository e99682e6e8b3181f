"""Training set of a retraining cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels
from riskloom.operators import feedback, splits


def tagged(original: DataFrame, reviewed: DataFrame, original_key: str = "doc_id", feedback_key: str = "feedback_id") -> DataFrame:
    """Original and feedback rows as ``key, origin, text, class``, complete rows only."""
    left = original.select(
        F.concat(F.lit("o"), F.col(original_key).cast("string")).alias("key"), F.lit("original").alias("origin"), "text", "class")
    right = reviewed.select(
        F.concat(F.lit("f"), F.col(feedback_key).cast("string")).alias("key"), F.lit("feedback").alias("origin"), "text", "class")
    return left.unionByName(right).na.drop("any")


def corrected_texts(reviews: DataFrame, predictions: DataFrame, feedback_type: str = "correction") -> DataFrame:
    """``text, class`` of reviewed predictions, with the reviewer's class; reviews without a prediction fall away."""
    rows = feedback.for_retraining(reviews, predictions, feedback_type)
    return rows.select("text", labels.label_of(F.col("correct_class")).alias("class"))


def training_set(
    rows: DataFrame, times: int = 5, split_first: bool = True,
    parts: Sequence[tuple[str, int]] = splits.SPLIT_90_10, seed: int = splits.SEED,
) -> DataFrame:
    """Split and oversample tagged rows; ``split`` is train or eval.

    ``split_first`` replicates only the feedback rows of the train part.  The
    other order replicates before the split, so copies of one text can land on
    both sides; it is kept for comparison with earlier results.
    """
    if not split_first:
        copies = F.when(F.col("origin") == "feedback", F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))
        multiplied = rows.withColumn("copy", F.explode(copies)).withColumn(
            "key", F.concat_ws("#", "key", F.col("copy").cast("string")))
        return splits.stratified_split(multiplied, "key", parts=parts, seed=seed)
    return replicated(weighed_set(rows, times, parts, seed))


def weighed_set(
    rows: DataFrame, times: int = 5, parts: Sequence[tuple[str, int]] = splits.SPLIT_90_10, seed: int = splits.SEED,
) -> DataFrame:
    """Split tagged rows, each once, with the ``copies`` that ``training_set`` makes of it after the split."""
    split = splits.stratified_split(rows, "key", parts=parts, seed=seed)
    more = (F.col("origin") == "feedback") & (F.col("split") == "train")
    return split.withColumn("copies", F.when(more, F.lit(times)).otherwise(F.lit(1)))


def replicated(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say, with ``copy``, the number of the copy, in its key too."""
    copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.withColumn("copy", copy).withColumn(
        "key", F.concat_ws("#", "key", F.col("copy").cast("string"))).drop("copies")
