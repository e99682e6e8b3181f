"""One retraining cycle: corrections to a new model, its metrics and its log rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels as lb
from riskloom.functions import lexicon as lx
from riskloom.operators import corpus, features, feedback, models, retraining, skew
from riskloom.session import materialize


@dataclass
class Cycle:
    text_model: PipelineModel
    classifier: object
    training_set: DataFrame
    metrics: DataFrame
    log: DataFrame


def run(
    original: DataFrame,
    reviewed: DataFrame,
    model_name: str,
    min_samples: int = feedback.MIN_CORRECTIONS,
    oversample: int = 5,
    split_first: bool = True,
    corrections_only: bool = True,
    stop_words: list[str] | None = None,
) -> Cycle:
    """Retrain from ``original`` (``doc_id, text, class``) and stored feedback rows.

    Fails when there are fewer than ``min_samples`` rows to learn from or a label
    is unknown.  The training set is written before training, so the model, the
    metrics and the log speak of the same rows.  Copies made after the split are
    stored as a count: texts are cut once, and a row weighs as many as it stands for.
    """
    chosen = reviewed.where(~F.col("is_correct")) if corrections_only else reviewed
    usable = feedback.require_feedback(chosen, min_samples)
    extra = usable.select(
        F.col("id").alias("feedback_id"), "text", lx.binary_label(F.col("teacher_correction")).alias("class"))
    tagged = retraining.tagged(original, extra)
    rows = retraining.weighed_set(tagged, oversample) if split_first else retraining.training_set(
        tagged, oversample, False).withColumn("copies", F.lit(1))
    labelled = corpus.map_labels_strict(rows, mapping=lb.LABEL_TO_CLASS).select("key", "origin", "text", "label", "split", "copies")
    stored = materialize(labelled, "training-set")
    trained_on = retraining.replicated(stored).drop("copy") if split_first else stored.drop("copies")

    words = stop_words if stop_words is not None else features.default_stop_words()
    text_model, table = models.featurize(skew.spread(stored, "key"), words, copies="copies")
    classifier = models.logistic(table.where(F.col("split") == "train").drop("split"), copies="copies")
    scored = models.predictions(classifier, table, model_name, key="key")
    scored = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    metrics = materialize(models.by_split(scored), "metrics")
    summary = metrics.where(F.col("split") == "eval").first()
    config = {"oversample": oversample, "min_samples": min_samples, "split_first": split_first}
    log = feedback.retraining_log(
        extra, model_name, json.dumps(config), json.dumps(summary.asDict()) if summary else None)
    return Cycle(text_model, classifier, trained_on, metrics, log)
