"""Comparison of models that scored the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluation import confidence_of

MEASURES = ("accuracy", "precision", "recall", "f1", "fnr")


def side_by_side(df: DataFrame, models: Sequence[str], key: str = "key") -> DataFrame:
    """One row per key: each model's prediction and confidence, and whether they differ.

    ``models`` is given, so no pass is spent on finding the pivot values.
    """
    with_conf = df.select(key, "model", "pred", confidence_of(F.col("pred"), F.col("prob")).alias("conf"))
    wide = with_conf.groupBy(key).pivot("model", list(models)).agg(
        F.max("pred").alias("pred"), F.max("conf").alias("conf"))
    preds = [F.col(f"{m}_pred") for m in models]
    return wide.withColumn("models_disagree", F.coalesce(F.greatest(*preds) != F.least(*preds), F.lit(False)))


def disagreements(wide: DataFrame) -> DataFrame:
    return wide.where("models_disagree")


def over_base(table: DataFrame, base: str) -> DataFrame:
    """Difference to the base model in points (x100) for every other model."""
    reference = table.where(F.col("model") == base).select(F.struct(*MEASURES)).scalar()
    return table.where(F.col("model") != base).select(
        "model",
        *[F.round((F.col(m) - reference[m]) * 100, 6).alias(f"{m}_points") for m in MEASURES],
    )


def best_models(table: DataFrame) -> DataFrame:
    """Best model per criterion; the smaller name wins a tie."""
    def best(criterion: str, order) -> "F.Column":
        chosen = F.min_by(F.struct("model", order[1].alias("value")), F.struct(order[0], F.col("model")))
        return F.struct(F.lit(criterion).alias("criterion"), chosen["model"].alias("model"), chosen["value"].alias("value"))

    return table.agg(
        best("accuracy", (-F.col("accuracy"), F.col("accuracy"))).alias("a"),
        best("f1", (-F.col("f1"), F.col("f1"))).alias("b"),
        best("fnr", (F.col("fnr"), F.col("fnr"))).alias("c"),
    ).select(F.inline(F.array("a", "b", "c")))
