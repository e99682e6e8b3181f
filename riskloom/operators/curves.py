"""ROC and precision-recall curves and the choice of a decision threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rates
from riskloom.operators.evaluation import score_counts
from riskloom.operators.ranking import prefix_sums, unit_blocks


def curve(df: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob", truth: str = "truth") -> DataFrame:
    """One point per distinct score, taken as the threshold ``score >= threshold``."""
    counts = score_counts(df, by, prob, truth)
    blocks = unit_blocks(F.lit(1.0) - F.col("score"))
    points = prefix_sums(counts, by, [F.desc("score")], ["pos", "neg"], blocks)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tp, fp = F.col("pos_upto"), F.col("neg_upto")
    return points.join(totals, list(by)).select(
        *by, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        rates.ratio(tp, F.col("p")).alias("tpr"), rates.ratio(fp, F.col("n")).alias("fpr"),
        rates.ratio(tp, tp + fp).alias("precision"), rates.ratio(F.col("p") - tp, F.col("p")).alias("fnr"),
    )


def binned_curve(df: DataFrame, by: Sequence[str] = ("model",), bins: int = 1000) -> DataFrame:
    """The same curve on ``bins`` equal score steps; the floor of each step is its threshold."""
    step = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)) / float(bins)
    return curve(df.withColumn("prob", step), by)


def best_threshold(points: DataFrame, by: Sequence[str] = ("model",), max_fnr: float = 0.05) -> DataFrame:
    """The threshold with the best F1 among those within the FNR limit.

    Where none keeps the limit the best F1 overall is reported and ``within_limit``
    is false.  The higher threshold wins a tie.
    """
    f1 = rates.f_score(F.col("precision"), F.col("tpr"))
    scored = points.withColumn("f1", f1).withColumn("within_limit", F.col("fnr") <= max_fnr)
    return scored.groupBy(*by).agg(
        F.max(F.struct("within_limit", "f1", "threshold", "fnr", "fpr")).alias("b")
    ).select(*by, "b.threshold", "b.f1", "b.fnr", "b.fpr", "b.within_limit")
