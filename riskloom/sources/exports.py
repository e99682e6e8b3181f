"""Exports of feedback and evaluation results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import lexicon as lx
from riskloom.functions import text

# Fixed value: names under which correction batches may be fetched.
EXPORT_NAME = r"^corrections_\d+samples_\d+_\d+\.csv$"


def _newest(feedback: DataFrame, status: str | None, is_correct: bool | None) -> DataFrame:
    if status:
        feedback = feedback.where(F.col("status") == status)
    if is_correct is not None:
        feedback = feedback.where(F.col("is_correct") == is_correct)
    return feedback.orderBy(F.desc("created_at"), F.desc("id"))


def csv_rows(feedback: DataFrame, status: str | None = None, is_correct: bool | None = None) -> DataFrame:
    """The nine export columns, newest first, missing notes as empty text."""
    return _newest(feedback, status, is_correct).select(
        "id", "text", "original_prediction", "original_score", "teacher_correction", "is_correct",
        F.coalesce("teacher_notes", F.lit("")).alias("teacher_notes"),
        text.iso_timestamp(F.col("created_at")).alias("created_at"), "status")


def jsonl_rows(feedback: DataFrame, status: str | None = None, is_correct: bool | None = None) -> DataFrame:
    """One object per row with nested ``metadata``, newest first."""
    return _newest(feedback, status, is_correct).select(
        "text", F.col("teacher_correction").alias("label"), "original_prediction", "is_correct",
        F.struct(
            "id", "original_score", "teacher_notes",
            text.iso_timestamp(F.col("created_at")).alias("created_at")).alias("metadata"))


def training_rows(feedback: DataFrame, corrections_only: bool = False) -> DataFrame:
    """Texts with their binary class and where they came from."""
    chosen = feedback.where(~F.col("is_correct")) if corrections_only else feedback
    return chosen.select(
        "text", lx.binary_label(F.col("teacher_correction")).alias("class"), "original_prediction",
        "teacher_correction", "is_correct", text.iso_timestamp(F.col("created_at")).alias("created_at"),
        F.col("id").alias("feedback_id"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled so that multi-line texts read back unchanged."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_feedback(feedback: DataFrame, path: str, format: str = "csv", status: str | None = None,
                    is_correct: bool | None = None) -> None:
    if format == "csv":
        write_csv(csv_rows(feedback, status, is_correct), path)
    elif format == "jsonl":
        write_jsonl(jsonl_rows(feedback, status, is_correct), path)
    else:
        raise ValueError("format must be 'csv' or 'jsonl'")


def export_training(feedback: DataFrame, path: str, corrections_only: bool = False) -> tuple[str, str]:
    """Full export and its ``_simple`` twin with text and class only."""
    rows = training_rows(feedback, corrections_only).persist()
    try:
        write_csv(rows, path)
        simple = re.sub(r"(\.[^./]*)?$", lambda m: "_simple" + (m.group(0) or ""), path, count=1)
        write_csv(rows.select("text", "class"), simple)
    finally:
        rows.unpersist()
    return path, simple


def correction_rows(feedback: DataFrame) -> DataFrame:
    return _newest(feedback, None, False).select(
        "text", lx.binary_label(F.col("teacher_correction")).alias("class"))


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("n_rows"))


def batch_name(count: int, stamp: str) -> str:
    """``stamp`` is ``yyyyMMdd_HHmmss``."""
    return f"corrections_{count}samples_{stamp}.csv"


def export_corrections(feedback: DataFrame, root: str, count: int, stamp: str) -> str:
    """A correction batch and its sidecar of class counts; the same inputs give the same path."""
    name = batch_name(count, stamp)
    path = f"{root.rstrip('/')}/{name}"
    write_csv(correction_rows(feedback), path)
    spark = feedback.sparkSession
    sidecar = class_counts(spark.read.option("header", True).option("multiLine", True).option(
        "escape", '"').schema("text string, class string").csv(path)).withColumn("file", F.lit(name))
    sidecar.coalesce(1).write.mode("overwrite").json(path[: -len(".csv")] + "_metadata")  # one row per class
    return path


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Data files below ``path``: name, folder, size and time, newest first; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(path).select("path", "length", "modificationTime")
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
    ).orderBy(F.desc("modified_at"), "filename")


def list_exports(spark: SparkSession, root: str) -> DataFrame:
    """Correction batches: name, size and time, newest first."""
    parts = list_files(spark, root).where(F.rlike("folder", F.lit(EXPORT_NAME)))
    return parts.groupBy(F.col("folder").alias("filename")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.max("modified_at").alias("created_at"),
    ).orderBy(F.desc("created_at"), "filename")


def read_export(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One correction batch; names outside the pattern are refused."""
    if not re.match(EXPORT_NAME, name):
        raise ValueError(f"invalid export name {name!r}")
    return spark.read.schema("text string, class string").option("header", True).option(
        "multiLine", True).option("escape", '"').csv(f"{root.rstrip('/')}/{name}")


def results_document(metrics: DataFrame, model_type: str, seed: int, config: dict) -> DataFrame:
    """Nested result document per model from metrics by ``(model, split)`` with splits val and test."""
    fields = {
        "eval_accuracy": "accuracy", "eval_precision": "precision", "eval_recall": "recall", "eval_f1": "f1",
        "eval_fnr": "fnr", "eval_fpr": "fpr", "eval_true_positives": "true_positives",
        "eval_true_negatives": "true_negatives", "eval_false_positives": "false_positives",
        "eval_false_negatives": "false_negatives"}
    body = F.struct(*[F.col(source).alias(target) for target, source in fields.items()])
    part = lambda name: F.max(F.when(F.col("split") == name, body)).alias(f"{name}_results")
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()]).alias("training_config")
    return metrics.groupBy(F.col("model").alias("model_name")).agg(part("val"), part("test")).select(
        F.lit(model_type).alias("model_type"), "model_name", F.lit(seed).cast("long").alias("seed"),
        "val_results", "test_results", settings)
