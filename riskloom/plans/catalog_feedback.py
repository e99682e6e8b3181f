"""Feedback queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import lexicon as lx
from riskloom.functions import text as tx
from riskloom.operators import feedback as fb
from riskloom.plans.catalog import Catalog
from riskloom.plans.oracle_views import pct
from riskloom.plans.testbed import Testbed

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
MIN_SAMPLES = 50


def _iso(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, tx.iso_timestamp(F.col(c)))
    return df


BREAKDOWN_SQL = f"""
    SELECT r.risk_level, count(*) FILTER (WHERE f.is_correct) AS correct,
           count(*) FILTER (WHERE NOT f.is_correct) AS incorrect, count(f.id) AS total,
           {pct('count(*) FILTER (WHERE f.is_correct)', 'count(f.id)')} AS accuracy
    FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) r(risk_level)
    LEFT JOIN feedback f ON f.original_prediction = r.risk_level GROUP BY r.risk_level"""

TOTALS_SQL = f"""count(*) AS total_feedback, count(*) FILTER (WHERE is_correct) AS correct_predictions,
    count(*) FILTER (WHERE NOT is_correct) AS incorrect_predictions,
    {pct('count(*) FILTER (WHERE is_correct)', 'count(*)')} AS accuracy_rate"""

LEVEL_COUNTS_SQL = ", ".join(
    f"count(*) FILTER (WHERE original_prediction = '{lv}' AND {'' if good else 'NOT '}is_correct) "
    f"AS {lv.lower()}_{'correct' if good else 'incorrect'}"
    for lv in lx.RISK_LEVELS for good in (True, False))

SNAPSHOT_SQL = f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS date, {TOTALS_SQL}, {LEVEL_COUNTS_SQL} FROM feedback GROUP BY 1"""

READY_SQL = """
    SELECT incorrect_predictions >= 50 AS ready, total_feedback, incorrect_predictions, accuracy_rate,
           greatest(0, 50 - incorrect_predictions) AS samples_needed, CAST(50 AS BIGINT) AS min_samples,
           CASE WHEN incorrect_predictions >= 50 THEN 'Ready to Retrain!' ELSE 'Collecting Feedback' END AS state
    FROM ({0})"""


def _for_retraining(bed: Testbed) -> DataFrame:
    return _iso(fb.for_retraining(bed.reviews, bed.predictions, "correction"), "timestamp")


def _recent(bed: Testbed) -> DataFrame:
    return _iso(fb.recent(bed.reviews, bed.predictions), "timestamp")


def _submissions(bed: Testbed) -> DataFrame:
    """Feedback with some rows spoilt, as they may arrive from outside."""
    k = F.col("id")
    return bed.feedback.select(
        "id", F.when(k % 17 == 0, None).otherwise(F.col("text")).alias("text"),
        F.when(k % 19 == 0, "SEVERE").otherwise(F.col("original_prediction")).alias("original_prediction"),
        F.when(k % 23 == 0, F.col("original_score") + 1).otherwise(F.col("original_score")).alias("original_score"),
        F.when(k % 29 == 0, F.col("original_confidence") - 1).otherwise(F.col("original_confidence"))
        .alias("original_confidence"),
        "teacher_correction")


def _validate(bed: Testbed) -> DataFrame:
    return fb.validate(_submissions(bed)).select("id", "problem")


def _agreement(bed: Testbed) -> DataFrame:
    return fb.with_agreement(bed.feedback.drop("is_correct")).select("id", "is_correct", "message")


def _listing(bed: Testbed) -> DataFrame:
    page = fb.listing(bed.feedback, skip=20, limit=100, status="pending", is_correct=True)
    return _iso(page.select("id", "text", "original_prediction", "teacher_correction", "created_at", "total"), "created_at")


def _log(bed: Testbed) -> DataFrame:
    used = bed.corrections.select(F.col("id").alias("feedback_id"))
    return fb.retraining_log(used, "linear-feedback", '{"oversample":3}', ids_per_row=100)


def _lifecycle(bed: Testbed) -> DataFrame:
    reviewed = bed.feedback.where(F.col("teacher_notes").isNotNull()).select("id")
    moved = fb.advance(bed.feedback, fb.logged_ids(_log(bed)), reviewed)
    return moved.select("id", "status", "used_for_training")


def _documents(bed: Testbed) -> DataFrame:
    return fb.feedback_document(bed.feedback)


def register(c: Catalog) -> None:
    c.add("j01_feedback_for_retraining", _for_retraining, f"""
        SELECT p.text, f.correct_class, f.correct_label, f.feedback_type, f.teacher_notes,
               {ISO.format('f.ts')} AS timestamp, f.id AS feedback_id, p.id AS prediction_id
        FROM reviews f JOIN predictions p ON f.prediction_id = p.id WHERE f.feedback_type = 'correction'""")
    c.add("j02_recent_feedback", _recent, f"""
        SELECT f.id, f.prediction_id, f.correct_class, f.correct_label, f.feedback_type, f.teacher_notes, f.email,
               {ISO.format('f.ts')} AS timestamp, p.predicted_class, p.predicted_label, p.confidence, p.text
        FROM reviews f JOIN predictions p ON f.prediction_id = p.id ORDER BY f.ts DESC, f.id DESC LIMIT 50""")
    c.add("j03_agreement", lambda b: fb.agreement(b.reviews, b.predictions), """
        SELECT count(*) FILTER (WHERE p.predicted_class <> f.correct_class) AS corrections,
               count(*) FILTER (WHERE p.predicted_class = f.correct_class) AS confirmations
        FROM reviews f JOIN predictions p ON f.prediction_id = p.id""")
    c.add("f01_validate_submission", _validate, """
        SELECT id, CASE WHEN id % 17 = 0 THEN 'missing text' WHEN id % 23 = 0 THEN 'original_score outside 0..1'
                        WHEN id % 29 = 0 THEN 'original_confidence outside 0..1'
                        WHEN id % 19 = 0 THEN 'unknown original_prediction' END AS problem FROM feedback""")
    c.add("f02_agreement_reply", _agreement, f"""
        SELECT id, is_correct, CASE WHEN is_correct THEN '{fb.THANKS_CONFIRMATION}' ELSE '{fb.THANKS_CORRECTION}' END
          AS message FROM feedback""")
    c.add("f03_listing_page", _listing, f"""
        SELECT id, text, original_prediction, teacher_correction, {ISO.format('created_at')} AS created_at,
               count(*) OVER () AS total
        FROM feedback WHERE status = 'pending' AND is_correct ORDER BY feedback.created_at DESC, id DESC
        LIMIT 100 OFFSET 20""")
    c.add("f04_accuracy_stats", lambda b: fb.accuracy_stats(b.feedback), f"SELECT {TOTALS_SQL} FROM feedback")
    c.add("f05_risk_breakdown", lambda b: fb.risk_breakdown(b.feedback), BREAKDOWN_SQL)
    c.add("f06_collection_stats",
          lambda b: fb.collection_stats(b.reviews, b.predictions, b.retraining_history), f"""
        SELECT p.n AS total_predictions, r.n AS total_feedback, t.by_type AS feedback_by_type, a.corrections,
               a.confirmations, h.n AS retraining_events, {pct('r.n', 'p.n')} AS feedback_rate
        FROM (SELECT count(*) AS n FROM predictions) p, (SELECT count(*) AS n FROM reviews) r,
             (SELECT count(*) AS n FROM retraining_history) h,
             (SELECT string_agg(feedback_type || '=' || n, ', ' ORDER BY feedback_type) AS by_type
              FROM (SELECT feedback_type, count(*) AS n FROM reviews GROUP BY 1)) t,
             (SELECT count(*) FILTER (WHERE p.predicted_class <> f.correct_class) AS corrections,
                     count(*) FILTER (WHERE p.predicted_class = f.correct_class) AS confirmations
              FROM reviews f JOIN predictions p ON f.prediction_id = p.id) a""")
    c.add("f07_count_by_type", lambda b: fb.count_by_type(b.reviews),
          "SELECT feedback_type, count(*) AS n_rows FROM reviews GROUP BY 1")
    c.add("f08_binary_class", lambda b: b.feedback.select(
        "id", lx.binary_label(F.col("teacher_correction")).alias("class"),
        lx.binary_class(F.col("teacher_correction")).alias("label")), """
        SELECT id, CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 'suicide' ELSE 'non-suicide' END AS class,
               CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END AS label FROM feedback""")
    c.add("f09_export_stats", lambda b: fb.export_stats(b.feedback), """
        SELECT 'agreement' AS section, CASE WHEN is_correct THEN 'correct' ELSE 'incorrect' END AS name,
               count(*) AS n_rows FROM feedback GROUP BY 2
        UNION ALL SELECT 'class', CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 'suicide'
               ELSE 'non-suicide' END, count(*) FROM feedback GROUP BY 2
        UNION ALL SELECT 'risk', teacher_correction, count(*) FROM feedback GROUP BY 2
        UNION ALL SELECT 'total', 'all', count(*) FROM feedback""")
    c.add("f10_readiness", lambda b: fb.readiness(b.feedback, MIN_SAMPLES),
          READY_SQL.format(f"SELECT {TOTALS_SQL} FROM feedback"))
    c.add("f11_dashboard_rows", lambda b: fb.dashboard_rows(b.feedback), """
        SELECT id, strftime(created_at, '%Y-%m-%d') AS day, substring(text, 1, 100) || '...' AS preview,
               original_prediction, teacher_correction,
               CASE WHEN is_correct THEN 'Correct' ELSE 'Incorrect' END AS badge,
               CAST(floor(original_score * 100 + 0.5) AS BIGINT) || '%' AS score
        FROM feedback ORDER BY created_at DESC, id DESC LIMIT 100""")
    c.add("f12_retraining_log", _log, """
        SELECT id // 100 AS part, '[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) || ']' AS feedback_ids,
               count(*) AS num_samples, 'linear-feedback' AS model_name, '{"oversample":3}' AS training_config,
               CAST(NULL AS VARCHAR) AS performance_metrics, 'completed' AS status
        FROM corrections GROUP BY 1""")
    c.add("f13_daily_snapshot", lambda b: fb.daily_snapshot(b.feedback), f"""
        SELECT *, CAST(sum(total_feedback) OVER w AS BIGINT) AS cumulative_feedback,
               CAST(sum(incorrect_predictions) OVER w AS BIGINT) AS cumulative_incorrect,
               round(sum(correct_predictions) OVER w / sum(total_feedback) OVER w * 100, 2) AS cumulative_accuracy
        FROM ({SNAPSHOT_SQL}) WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    c.add("f14_life_cycle", _lifecycle, """
        SELECT f.id, CASE WHEN c.id IS NOT NULL THEN 'incorporated' WHEN f.teacher_notes IS NOT NULL THEN 'reviewed'
                          ELSE f.status END AS status, c.id IS NOT NULL AS used_for_training
        FROM feedback f LEFT JOIN corrections c ON f.id = c.id""")
    c.add("f15_contact_counts", lambda b: fb.contact_counts(b.contacts),
          "SELECT submission_type, status, count(*) AS n_rows FROM contacts GROUP BY 1, 2")
    c.add("f16_feedback_document", _documents, f"""
        SELECT id, CAST(to_json(struct_pack(id := id, "text" := text, original_prediction := original_prediction,
               original_score := original_score, original_confidence := original_confidence,
               teacher_correction := teacher_correction, teacher_notes := teacher_notes, teacher_id := teacher_id,
               is_correct := is_correct, created_at := {ISO.format('created_at')},
               reviewed_at := CAST(NULL AS VARCHAR), status := status, used_for_training := used_for_training)) AS VARCHAR)
               AS document FROM feedback""")
    c.add("f16_stats_document", lambda b: fb.stats_document(fb.daily_snapshot(b.feedback)), f"""
        SELECT date, CAST(to_json(struct_pack(date := date, total_feedback := total_feedback,
               correct_predictions := correct_predictions, incorrect_predictions := incorrect_predictions,
               accuracy_rate := accuracy_rate, class_breakdown := struct_pack(
                 low := struct_pack(correct := low_correct, incorrect := low_incorrect),
                 medium := struct_pack(correct := medium_correct, incorrect := medium_incorrect),
                 high := struct_pack(correct := high_correct, incorrect := high_incorrect)))) AS VARCHAR) AS document
        FROM ({SNAPSHOT_SQL})""")
    c.add("d16_error_pattern", lambda b: fb.error_pattern(b.feedback), f"""
        SELECT original_prediction, count(*) FILTER (WHERE teacher_correction = 'LOW') AS to_low,
               count(*) FILTER (WHERE teacher_correction = 'MEDIUM') AS to_medium,
               count(*) FILTER (WHERE teacher_correction = 'HIGH') AS to_high,
               {pct('count(*) FILTER (WHERE NOT is_correct)', 'count(*)')} AS error_rate
        FROM feedback GROUP BY 1""")
