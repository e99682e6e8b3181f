"""Evaluation of predictions: confusion counts, metric set, reports, AUC, confidence.

Predictions are a long table ``model, key, pred, prob, truth``; every operator
groups by ``by`` and reads the table once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rates
from riskloom.operators.ranking import prefix_sums, unit_blocks

CELLS = ("tn", "fp", "fn", "tp")

# Names and meanings of the four cells, confidence cuts, targets.
CELL_TEXT = {
    "tn": ("True Negatives (TN)", "Correctly identified non-suicide"),
    "fp": ("False Positives (FP)", "Non-suicide flagged as suicide"),
    "fn": ("False Negatives (FN)", "MISSED suicide cases"),
    "tp": ("True Positives (TP)", "Correctly identified suicide"),
}
CLASS_NAMES = ("non-suicide", "suicide")
HIGH_CONFIDENCE, LOW_CONFIDENCE = 0.9, 0.6
MAX_FNR, MIN_F1 = 0.05, 0.90


def confusion(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred", truth: str = "truth") -> DataFrame:
    """``tn, fp, fn, tp`` per group; zeros when a class is absent."""
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    precision, recall = rates.ratio(tp, tp + fp), rates.ratio(tp, tp + fn)
    return {
        "accuracy": rates.ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": rates.f_score(precision, recall),
        "fnr": rates.ratio(fn, fn + tp),
        "fpr": rates.ratio(fp, fp + tn),
        "tpr": recall,
        "tnr": rates.ratio(tn, tn + fp),
    }


def metrics(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The full metric set from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    return counts.select(
        *by,
        *[value.alias(name) for name, value in _rates().items()],
        tp.alias("true_positives"), tn.alias("true_negatives"),
        fp.alias("false_positives"), fn.alias("false_negatives"),
        (tn + fp + fn + tp).alias("total_samples"),
        (tp + fn).alias("positive_samples"), (tn + fp).alias("negative_samples"),
    )


def evaluate(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return metrics(confusion(df, by), by)


def sensitivity_specificity(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    r = _rates()
    return counts.select(*by, r["tpr"].alias("sensitivity"), r["tnr"].alias("specificity"))


def confusion_table(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Four rows per group: cell, count and what it means."""
    rows = [
        F.struct(F.lit(name).alias("cell"), F.col(cell).alias("n_rows"), F.lit(meaning).alias("meaning"))
        for cell, (name, meaning) in CELL_TEXT.items()
    ]
    return counts.select(*by, F.inline(F.array(*rows)))


def classification_report(
    counts: DataFrame, by: Sequence[str] = ("model",), names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """Per class, then accuracy, macro and weighted average; all from four counts."""
    tn, fp, fn, tp = (F.col(c) for c in CELLS)

    def one_class(hit: Column, false_hit: Column, missed: Column) -> dict[str, Column]:
        p, r = rates.ratio(hit, hit + false_hit), rates.ratio(hit, hit + missed)
        return {"precision": p, "recall": r, "f1": rates.f_score(p, r), "support": hit + missed}

    neg, pos = one_class(tn, fn, fp), one_class(tp, fp, fn)
    total = tn + fp + fn + tp
    accuracy = rates.ratio(tn + tp, total)

    def macro(m: str) -> Column:
        return (neg[m] + pos[m]) / 2.0

    def weighted(m: str) -> Column:
        return rates.ratio(neg[m] * neg["support"] + pos[m] * pos["support"], total)

    def line(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support"))

    measures = ("precision", "recall", "f1")
    return counts.select(*by, F.inline(F.array(
        line(names[0], *[neg[m] for m in measures], neg["support"]),
        line(names[1], *[pos[m] for m in measures], pos["support"]),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *[macro(m) for m in measures], total),
        line("weighted avg", *[weighted(m) for m in measures], total),
    )))


def score_counts(df: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob", truth: str = "truth") -> DataFrame:
    """Positives and negatives per distinct score: what every ranking metric needs."""
    return df.groupBy(*by, F.col(prob).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def roc_auc(df: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob", truth: str = "truth") -> DataFrame:
    """Exact area under the ROC curve by mid-ranks, 0 when a class is absent.

    Equal scores are merged first; the order of the distinct scores is built
    from score blocks, never in a single task.
    """
    ranked = prefix_sums(
        score_counts(df, by, prob, truth), by, [F.col("score")], ["neg"], unit_blocks(F.col("score")))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = F.col("neg_upto").cast("double") - neg
    summed = ranked.groupBy(*by).agg(
        F.sum(pos * (below + neg / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return summed.select(*by, rates.ratio(F.col("u"), pairs).alias("auc_roc"))


def confidence_of(pred: Column, prob: Column) -> Column:
    """Probability of the predicted class."""
    return F.when(pred == 1, prob).otherwise(F.lit(1.0) - prob)


def confidence_report(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean confidence and the shares strictly above 0.9 and strictly below 0.6."""
    c, n = F.col("_c"), F.count("*")
    return df.withColumn("_c", confidence_of(F.col("pred"), F.col("prob"))).groupBy(*by).agg(
        n.alias("n_rows"),
        F.round(F.avg(c), 6).alias("mean_confidence"),
        rates.percent(F.count_if(c > HIGH_CONFIDENCE), n).alias("pct_high"),
        rates.percent(F.count_if(c < LOW_CONFIDENCE), n).alias("pct_low"),
    )


def with_targets(table: DataFrame, max_fnr: float = MAX_FNR, min_f1: float = MIN_F1) -> DataFrame:
    return (
        table.withColumn("fnr_ok", F.col("fnr") < max_fnr)
        .withColumn("f1_ok", F.col("f1") > min_f1)
        .withColumn("meets_target", F.col("fnr_ok") & F.col("f1_ok"))
    )


def failure_count(df: DataFrame, by: Sequence[str] = ("model",), pred: str = "pred", default: int = 0) -> DataFrame:
    """Rows whose prediction failed, and the positives after the default is filled in."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(pred).isNull()).alias("n_failed"),
        F.sum(F.coalesce(pred, F.lit(default))).cast("long").alias("n_positive"),
    )
