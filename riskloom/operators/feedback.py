"""Reviewer feedback: joins, statistics, listings, readiness and life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import lexicon as lx
from riskloom.functions import rates, text
from riskloom.operators.skew import salted_join

# Reply texts, status names and the readiness threshold.
THANKS_CORRECTION = "Thank you for your feedback! This will help improve the model."
THANKS_CONFIRMATION = "Thank you for confirming the prediction!"
PENDING, REVIEWED, INCORPORATED = "pending", "reviewed", "incorporated"
MIN_CORRECTIONS = 50
IDS_PER_LOG_ROW = 10_000
BROADCAST_ROWS = 10_000


# --- reviews joined to predictions -------------------------------------------------------------

def reviewed_predictions(reviews: DataFrame, predictions: DataFrame, feedback_type: str | None = None) -> DataFrame:
    """Reviews with their prediction (``p_`` columns); reviews without one fall away.

    A prediction that drew a large share of all reviews is salted.
    """
    chosen = reviews if feedback_type is None else reviews.where(F.col("feedback_type") == feedback_type)
    return salted_join(chosen, _prediction_columns(predictions), "prediction_id", F.col("id"))


def _prediction_columns(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.col("id").alias("prediction_id"), F.col("text").alias("p_text"),
        F.col("predicted_class").alias("p_class"), F.col("predicted_label").alias("p_label"),
        F.col("confidence").alias("p_confidence"),
    )


def _newest_reviewed(reviews: DataFrame, predictions: DataFrame, feedback_type: str | None, limit: int) -> DataFrame:
    """The newest ``limit`` reviews that have a prediction, with its text.

    Ids meet first and the cut is made among them; only then are texts looked
    up, where they are stored, by the rows that were left.
    """
    chosen = reviews if feedback_type is None else reviews.where(F.col("feedback_type") == feedback_type)
    known = salted_join(chosen, predictions.select(F.col("id").alias("prediction_id")), "prediction_id", F.col("id"))
    newest = known.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    if limit <= BROADCAST_ROWS:
        newest = F.broadcast(newest)  # at most BROADCAST_ROWS rows by construction
    return _prediction_columns(predictions).join(newest, "prediction_id").orderBy(F.desc("timestamp"), F.desc("id"))


def for_retraining(
    reviews: DataFrame, predictions: DataFrame, feedback_type: str | None = None, limit: int | None = None
) -> DataFrame:
    """Texts with their corrected class, newest first."""
    if limit is None:
        rows = reviewed_predictions(reviews, predictions, feedback_type).orderBy(F.desc("timestamp"), F.desc("id"))
    else:
        rows = _newest_reviewed(reviews, predictions, feedback_type, limit)
    return rows.select(
        F.col("p_text").alias("text"), "correct_class", "correct_label", "feedback_type", "teacher_notes",
        "timestamp", F.col("id").alias("feedback_id"), "prediction_id")


def recent(reviews: DataFrame, predictions: DataFrame, limit: int = 50) -> DataFrame:
    rows = _newest_reviewed(reviews, predictions, None, limit)
    return rows.select(
        "id", "prediction_id", "correct_class", "correct_label", "feedback_type", "teacher_notes", "email",
        "timestamp", F.col("p_class").alias("predicted_class"), F.col("p_label").alias("predicted_label"),
        F.col("p_confidence").alias("confidence"), F.col("p_text").alias("text"))


def agreement(reviews: DataFrame, predictions: DataFrame) -> DataFrame:
    """Corrections and confirmations; reviews are counted per prediction before the join."""
    counted = reviews.groupBy("prediction_id", "correct_class").agg(F.count("*").alias("n"))
    joined = counted.join(
        predictions.select(F.col("id").alias("prediction_id"), "predicted_class"), "prediction_id")
    differs = F.col("predicted_class") != F.col("correct_class")
    zero = F.lit(0)
    return joined.agg(
        F.coalesce(F.sum(F.when(differs, F.col("n"))), zero).alias("corrections"),
        F.coalesce(F.sum(F.when(~differs, F.col("n"))), zero).alias("confirmations"),
    )


def count_by_type(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("feedback_type").agg(F.count("*").alias("n_rows"))


def collection_stats(reviews: DataFrame, predictions: DataFrame, retrainings: DataFrame) -> DataFrame:
    """One row: totals, agreement, retraining events and reviews per hundred predictions."""
    n_predictions = predictions.agg(F.count("*")).scalar()
    n_retrainings = retrainings.agg(F.count("*")).scalar()
    by_type = count_by_type(reviews).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("feedback_type", "n_rows"))),
        lambda e: F.concat_ws("=", e["feedback_type"], e["n_rows"].cast("string"))), ", ")).scalar()
    total = reviews.agg(F.count("*")).scalar()
    return agreement(reviews, predictions).select(
        n_predictions.alias("total_predictions"), total.alias("total_feedback"),
        by_type.alias("feedback_by_type"), "corrections", "confirmations",
        n_retrainings.alias("retraining_events"),
        rates.percent(total, n_predictions).alias("feedback_rate"),
    )


# --- submissions ---------------------------------------------------------------------------------

def submission_problem() -> Column:
    """Why a submission is refused, null when it is accepted."""
    required = ("text", "original_prediction", "original_score", "original_confidence", "teacher_correction")
    problem = F.lit(None).cast("string")
    checks = [(F.col(c).isNull(), f"missing {c}") for c in required]
    checks += [
        (~F.col(c).between(0.0, 1.0), f"{c} outside 0..1") for c in ("original_score", "original_confidence")]
    checks += [
        (~F.col(c).isin(*lx.RISK_LEVELS), f"unknown {c}") for c in ("original_prediction", "teacher_correction")]
    for bad, reason in reversed(checks):
        problem = F.when(bad, reason).otherwise(problem)
    return problem


def validate(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("problem", submission_problem())


def accepted(submissions: DataFrame) -> DataFrame:
    return submissions.where(submission_problem().isNull())


def quarantined(submissions: DataFrame) -> DataFrame:
    return validate(submissions).where(F.col("problem").isNotNull())


def with_agreement(submissions: DataFrame) -> DataFrame:
    """Add ``is_correct`` and the reply shown to the reviewer."""
    same = F.col("original_prediction") == F.col("teacher_correction")
    return submissions.withColumn("is_correct", same).withColumn(
        "message", F.when(same, THANKS_CONFIRMATION).otherwise(THANKS_CORRECTION))


# --- statistics ----------------------------------------------------------------------------------

def _filtered(feedback: DataFrame, status: str | None, is_correct: bool | None) -> DataFrame:
    if status:
        feedback = feedback.where(F.col("status") == status)
    if is_correct is not None:
        feedback = feedback.where(F.col("is_correct") == is_correct)
    return feedback


def listing(
    feedback: DataFrame, skip: int = 0, limit: int = 100, status: str | None = None, is_correct: bool | None = None
) -> DataFrame:
    """A page, newest first, with the number of rows before paging as ``total``."""
    chosen = _filtered(feedback, status, is_correct)
    total = chosen.agg(F.count("*")).scalar()
    page = chosen.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)
    return page.withColumn("total", total)


def listing_after(
    feedback: DataFrame, created_at, last_id: int, limit: int = 100,
    status: str | None = None, is_correct: bool | None = None,
) -> DataFrame:
    """The page after a given row: keyset paging, whose cost does not grow with depth."""
    chosen = _filtered(feedback, status, is_correct)
    older = (F.col("created_at") < F.lit(created_at)) | (
        (F.col("created_at") == F.lit(created_at)) & (F.col("id") < last_id))
    return chosen.where(older).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def _totals() -> list[Column]:
    n, good = F.count("*"), F.count_if(F.col("is_correct"))
    return [
        n.alias("total_feedback"), good.alias("correct_predictions"),
        F.count_if(~F.col("is_correct")).alias("incorrect_predictions"),
        rates.percent(good, n).alias("accuracy_rate"),
    ]


def _risk_counts() -> list[Column]:
    out = []
    for level in lx.RISK_LEVELS:
        mine = F.col("original_prediction") == level
        out.append(F.count_if(mine & F.col("is_correct")).alias(f"{level.lower()}_correct"))
        out.append(F.count_if(mine & ~F.col("is_correct")).alias(f"{level.lower()}_incorrect"))
    return out


def accuracy_stats(feedback: DataFrame) -> DataFrame:
    """Totals and accuracy, one pass."""
    return feedback.agg(*_totals())


def risk_breakdown(feedback: DataFrame) -> DataFrame:
    """Correct, incorrect, total and accuracy per risk level; levels without rows stay, as zeros.

    Six conditional counts in one pass, then the one result row is turned into three.
    """
    lines = []
    for level in lx.RISK_LEVELS:
        good, bad = F.col(f"{level.lower()}_correct"), F.col(f"{level.lower()}_incorrect")
        lines.append(F.struct(
            F.lit(level).alias("risk_level"), good.alias("correct"), bad.alias("incorrect"),
            (good + bad).alias("total"), rates.percent(good, good + bad).alias("accuracy")))
    return feedback.agg(*_risk_counts()).select(F.inline(F.array(*lines)))


def daily_snapshot(feedback: DataFrame) -> DataFrame:
    """Statistics row per day, plus totals up to that day."""
    per_day = feedback.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(
        *_totals(), *_risk_counts())
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    good, n = F.sum("correct_predictions").over(upto), F.sum("total_feedback").over(upto)
    return per_day.select(
        "*", n.alias("cumulative_feedback"), F.sum("incorrect_predictions").over(upto).alias("cumulative_incorrect"),
        rates.percent(good, n).alias("cumulative_accuracy"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Totals as of the newest stored snapshot row."""
    newest = F.max_by(
        F.struct("cumulative_feedback", "cumulative_incorrect", "cumulative_accuracy"), "date").alias("s")
    return snapshots.agg(newest).select(
        F.col("s.cumulative_feedback").alias("total_feedback"),
        F.col("s.cumulative_incorrect").alias("incorrect_predictions"),
        F.col("s.cumulative_accuracy").alias("accuracy_rate"))


def export_stats(feedback: DataFrame) -> DataFrame:
    """Rows per correctness, per binary class and per corrected level, in one pass."""
    rows = feedback.select(
        F.when(F.col("is_correct"), "correct").otherwise("incorrect").alias("agreement"),
        lx.binary_label(F.col("teacher_correction")).alias("class"),
        F.col("teacher_correction").alias("risk"),
    )
    grouped = rows.groupingSets([["agreement"], ["class"], ["risk"], []], "agreement", "class", "risk").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n_rows"))
    section = (
        F.when(F.col("_g") == 3, "agreement").when(F.col("_g") == 5, "class")
        .when(F.col("_g") == 6, "risk").otherwise("total"))
    return grouped.select(
        section.alias("section"), F.coalesce("agreement", "class", "risk", F.lit("all")).alias("name"), "n_rows")


def readiness(feedback: DataFrame, min_samples: int = MIN_CORRECTIONS) -> DataFrame:
    """Whether there are enough corrections to retrain."""
    return readiness_of(accuracy_stats(feedback), min_samples)


def readiness_of(stats: DataFrame, min_samples: int = MIN_CORRECTIONS) -> DataFrame:
    """The same from rows that already hold the statistics, such as stored snapshots."""
    wrong = F.col("incorrect_predictions")
    return stats.select(
        (wrong >= min_samples).alias("ready"), "total_feedback", "incorrect_predictions", "accuracy_rate",
        F.greatest(F.lit(0).cast("long"), F.lit(min_samples) - wrong).alias("samples_needed"),
        F.lit(min_samples).cast("long").alias("min_samples"),
        F.when(wrong >= min_samples, "Ready to Retrain!").otherwise("Collecting Feedback").alias("state"),
    )


def require_feedback(rows: DataFrame, min_samples: int = MIN_CORRECTIONS) -> DataFrame:
    """``rows``, or an error when fewer than ``min_samples`` are there; reads no more than needed."""
    found = rows.limit(min_samples).count()
    if found < min_samples:
        raise ValueError(f"insufficient feedback data: {found} samples (minimum: {min_samples})")
    return rows


def dashboard_rows(feedback: DataFrame, limit: int = 100) -> DataFrame:
    page = feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return page.select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        text.preview(F.col("text")).alias("preview"), "original_prediction", "teacher_correction",
        F.when(F.col("is_correct"), "Correct").otherwise("Incorrect").alias("badge"),
        F.concat(F.floor(F.col("original_score") * 100 + 0.5).cast("string"), F.lit("%")).alias("score"),
    )


def error_pattern(feedback: DataFrame) -> DataFrame:
    """Predicted level against corrected level, one column per corrected level."""
    return feedback.groupBy("original_prediction").agg(
        *[F.count_if(F.col("teacher_correction") == level).alias(f"to_{level.lower()}") for level in lx.RISK_LEVELS],
        rates.percent(F.count_if(~F.col("is_correct")), F.count("*")).alias("error_rate"),
    )


def contact_counts(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("submission_type", "status").agg(F.count("*").alias("n_rows"))


# --- retraining log and life cycle --------------------------------------------------------------

def retraining_log(
    used: DataFrame, model_name: str, config_json: str, metrics_json: str | None = None,
    status: str = "completed", ids_per_row: int = IDS_PER_LOG_ROW,
) -> DataFrame:
    """Log rows of one retraining: distinct feedback ids as a JSON array, count, settings.

    Ids are split by range into parts, so that no row ever holds more than
    ``ids_per_row`` of them; the parts of a run add up to the whole list.
    """
    parts = used.select("feedback_id").distinct().groupBy(
        F.floor(F.col("feedback_id") / ids_per_row).cast("long").alias("part")
    ).agg(F.sort_array(F.collect_list("feedback_id")).alias("_ids"))
    return parts.select(
        "part", F.to_json("_ids").alias("feedback_ids"), F.size("_ids").cast("long").alias("num_samples"),
        F.lit(model_name).alias("model_name"), F.lit(config_json).alias("training_config"),
        F.lit(metrics_json).cast("string").alias("performance_metrics"), F.lit(status).alias("status"),
    )


def logged_ids(log: DataFrame) -> DataFrame:
    """The feedback ids of log rows, one per row."""
    ids = F.from_json("feedback_ids", "array<bigint>")
    return log.where(F.col("status") == "completed").select(F.explode(ids).alias("id")).distinct()


def advance(feedback: DataFrame, used_ids: DataFrame, reviewed_ids: DataFrame | None = None) -> DataFrame:
    """Move rows on: used for training -> incorporated, reviewed -> reviewed, others as they are."""
    marks = used_ids.select("id", F.lit(2).alias("_m"))
    if reviewed_ids is not None:
        marks = marks.unionByName(reviewed_ids.select("id", F.lit(1).alias("_m")))
    marks = marks.groupBy("id").agg(F.max("_m").alias("_m"))
    joined = feedback.join(marks, "id", "left")
    return joined.select(
        *[c for c in feedback.columns if c not in ("status", "used_for_training")],
        F.when(F.col("_m") == 2, INCORPORATED).when(F.col("_m") == 1, REVIEWED).otherwise(F.col("status")).alias("status"),
        (F.coalesce(F.col("_m") == 2, F.lit(False)) | F.coalesce("used_for_training", F.lit(False))).alias("used_for_training"),
    )


# --- documents -----------------------------------------------------------------------------------

def feedback_document(feedback: DataFrame) -> DataFrame:
    """``id`` and the row as a JSON document with ISO timestamps; nulls are written."""
    iso = lambda c: text.iso_timestamp(F.col(c)).alias(c)
    body = F.struct(
        "id", "text", "original_prediction", "original_score", "original_confidence", "teacher_correction",
        "teacher_notes", "teacher_id", "is_correct", iso("created_at"), iso("reviewed_at"), "status",
        "used_for_training")
    return feedback.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def stats_document(snapshot: DataFrame) -> DataFrame:
    """Snapshot row as JSON with the counts per level nested."""
    breakdown = F.struct(*[
        F.struct(
            F.col(f"{lv.lower()}_correct").alias("correct"), F.col(f"{lv.lower()}_incorrect").alias("incorrect"),
        ).alias(lv.lower())
        for lv in lx.RISK_LEVELS
    ]).alias("class_breakdown")
    body = F.struct(
        "date", "total_feedback", "correct_predictions", "incorrect_predictions", "accuracy_rate", breakdown)
    return snapshot.select("date", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
