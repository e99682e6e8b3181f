import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import feedback as fb
from riskloom.operators import skew

COLUMNS = "id long, text string, original_prediction string, teacher_correction string, status string, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def feedback(spark):
    levels = ("LOW", "MEDIUM", "HIGH")
    rows = [(i, f"t{i}", levels[i % 2], levels[(i // 2) % 3], "pending", f"2024-01-{1 + i // 40:02d} 10:00:00") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, original_prediction string, teacher_correction string, status string, at string")
    return fb.with_agreement(df.withColumn("created_at", F.col("at").cast("timestamp_ntz")).drop("at")).withColumn(
        "used_for_training", F.lit(False))


def test_breakdown_keeps_levels_without_rows(feedback):
    got = {r["risk_level"]: r for r in fb.risk_breakdown(feedback).collect()}
    assert set(got) == {"LOW", "MEDIUM", "HIGH"}
    assert (got["HIGH"]["total"], got["HIGH"]["accuracy"]) == (0, 0.0)
    assert got["LOW"]["total"] == 60


def test_statistics_of_nothing_are_zero(spark, feedback):
    empty = feedback.where("id < 0")
    assert tuple(fb.accuracy_stats(empty).first()) == (0, 0, 0, 0.0)
    assert fb.readiness(empty).first()["samples_needed"] == 50
    none = spark.createDataFrame([], "prediction_id long, correct_class int, id long, predicted_class int")
    assert tuple(fb.agreement(none, none).first()) == (0, 0)


def test_documented_accuracy(spark):
    rows = [(i, "LOW", i < 140) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, original_prediction string, is_correct boolean")
    row = fb.accuracy_stats(df).first()
    assert (row["correct_predictions"], row["incorrect_predictions"], row["accuracy_rate"]) == (140, 10, 93.33)


def test_readiness_threshold(spark):
    rows = [(i, "LOW", False) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, original_prediction string, is_correct boolean")
    assert fb.readiness(df).first()["ready"] and fb.readiness(df).first()["samples_needed"] == 0
    less = fb.readiness(df.where("id > 0")).first()
    assert not less["ready"] and less["samples_needed"] == 1
    assert fb.require_feedback(df, 50).count() == 50
    with pytest.raises(ValueError, match="minimum: 51"):
        fb.require_feedback(df, 51)


def test_paging_by_offset_and_by_key_agree(feedback):
    page = [r["id"] for r in fb.listing(feedback, skip=0, limit=25).collect()]
    following = [r["id"] for r in fb.listing(feedback, skip=25, limit=25).collect()]
    last = feedback.where(F.col("id") == page[-1]).first()
    keyed = [r["id"] for r in fb.listing_after(feedback, last["created_at"], last["id"], 25).collect()]
    assert keyed == following and not set(page) & set(following)
    assert fb.listing(feedback, limit=1).first()["total"] == 120


@pytest.mark.parametrize("row, problem", [
    (("t", "LOW", 0.1, 0.9, "HIGH"), None), ((None, "LOW", 0.1, 0.9, "HIGH"), "missing text"),
    (("t", "LOW", 1.1, 0.9, "HIGH"), "original_score outside 0..1"),
    (("t", "LOW", 0.0, -0.1, "HIGH"), "original_confidence outside 0..1"),
    (("t", "low", 1.0, 1.0, "HIGH"), "unknown original_prediction"),
    (("t", "LOW", 1.0, None, "HIGH"), "missing original_confidence")])
def test_validation(spark, row, problem):
    df = spark.createDataFrame([row], (
        "text string, original_prediction string, original_score double, original_confidence double, teacher_correction string"))
    assert fb.validate(df).first()["problem"] == problem
    assert fb.accepted(df).count() + fb.quarantined(df).count() == 1


def test_medium_to_high_is_a_correction(spark):
    df = spark.createDataFrame([("MEDIUM", "HIGH"), ("LOW", "LOW")], "original_prediction string, teacher_correction string")
    got = [(r["is_correct"], r["message"]) for r in fb.with_agreement(df).collect()]
    assert got == [(False, fb.THANKS_CORRECTION), (True, fb.THANKS_CONFIRMATION)]


def test_log_parts_add_up_and_move_rows_on(spark, feedback):
    used = feedback.where("not is_correct").select(F.col("id").alias("feedback_id"))
    log = fb.retraining_log(used.unionByName(used), "m", "{}", ids_per_row=7)
    parts = log.collect()
    assert max(r["num_samples"] for r in parts) <= 7
    ids = sorted(i for r in parts for i in json.loads(r["feedback_ids"]))
    assert ids == sorted(r["feedback_id"] for r in used.collect())
    reviewed = spark.createDataFrame([(0,), (1,)], "id long")
    moved = {r["id"]: (r["status"], r["used_for_training"]) for r in fb.advance(feedback, fb.logged_ids(log), reviewed).collect()}
    assert len(moved) == 120
    for r in feedback.collect():
        expected = ("incorporated", True) if not r["is_correct"] else (("reviewed" if r["id"] < 2 else "pending"), False)
        assert moved[r["id"]] == expected


def test_snapshot_accumulates(feedback):
    days = fb.daily_snapshot(feedback).orderBy("date").collect()
    assert [d["total_feedback"] for d in days] == [40, 40, 40]
    assert [d["cumulative_feedback"] for d in days] == [40, 80, 120]
    newest = fb.latest_snapshot(fb.daily_snapshot(feedback)).first()
    assert newest["total_feedback"] == 120 and newest["incorrect_predictions"] == feedback.where("not is_correct").count()


def test_documents_are_json_with_nulls(feedback):
    wide = feedback.withColumn("teacher_notes", F.lit(None).cast("string")).withColumn("teacher_id", F.lit("t")).withColumn(
        "original_score", F.lit(0.5)).withColumn("original_confidence", F.lit(0.5)).withColumn(
        "reviewed_at", F.lit(None).cast("timestamp_ntz"))
    document = json.loads(fb.feedback_document(wide).where("id = 0").first()["document"])
    assert document["created_at"] == "2024-01-01T10:00:00" and document["reviewed_at"] is None and document["teacher_notes"] is None
    stats = json.loads(fb.stats_document(fb.daily_snapshot(feedback)).orderBy("date").first()["document"])
    assert set(stats["class_breakdown"]) == {"low", "medium", "high"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join_when_one_key_is_hot(spark, how):
    big = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 40, i) for i in range(900)] + [(900, None, 0)], "id long, k long, v long")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(30)], "k long, name string")
    plain = {(r["id"], r["name"]) for r in big.join(dim, "k", how).collect()}
    for hot in (None, skew.hot_keys(big, "k", 3)):
        salted = skew.salted_join(big, dim, "k", F.col("id"), how, hot=hot, salts=8)
        assert {(r["id"], r["name"]) for r in salted.collect()} == plain
        assert salted.count() == big.join(dim, "k", how).count()
    assert skew.hot_keys(big, "k", 1).first()["k"] == 7


def test_reviews_of_unknown_predictions_fall_away(spark):
    reviews = spark.createDataFrame([(1, 10, 1, "correction"), (2, 99, 0, "unsure")], "id long, prediction_id long, correct_class int, feedback_type string")
    reviews = reviews.selectExpr("*", "'Suicidal' correct_label", "null teacher_notes", "null email", "timestamp_ntz'2024-01-01' timestamp")
    predictions = spark.createDataFrame([(10, "t", 0, "Not Suicidal", 0.9)], "id long, text string, predicted_class int, predicted_label string, confidence double")
    assert [r["feedback_id"] for r in fb.for_retraining(reviews, predictions).collect()] == [1]
    assert fb.for_retraining(reviews, predictions, "unsure").count() == 0
    assert fb.recent(reviews, predictions, 5).count() == 1
    assert tuple(fb.agreement(reviews, predictions).first()) == (1, 0)
