import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import comparison, curves, ensembles, evaluation, significance

COUNTS = "model string, tn long, fp long, fn long, tp long"


def table(spark, rows):
    return spark.createDataFrame(rows, "model string, key long, pred int, prob double, truth int")


@pytest.fixture(scope="module")
def random_predictions(spark):
    draw = random.Random(5)
    rows = []
    for model in ("a", "b", "c"):
        for key in range(400):
            truth = int(draw.random() < 0.3)
            prob = round(min(1.0, max(0.0, draw.gauss(0.65 if truth else 0.35, 0.2))), 2)
            rows.append((model, key, int(prob > 0.5), prob, truth))
    truth_of = {}
    fixed = [(m, k, p, q, truth_of.setdefault(k, t)) for m, k, p, q, t in rows]
    return fixed, table(spark, fixed).repartition(5)


@pytest.mark.parametrize("counts, expected", [
    ((11401, 203, 271, 11333), dict(
        accuracy=0.9795760082730093, precision=0.9824029126213593, recall=0.9766459841433989,
        f1=0.9795159896283492, fnr=0.02335401585660117, fpr=0.017493967597380214)),
    ((11385, 219, 265, 11338), dict(
        accuracy=0.9791442237256001, precision=0.9810504456173748, recall=0.977161079031285,
        f1=0.9791018998272885, fnr=0.02283892096871499, fpr=0.018872802481902793)),
])
def test_published_counts_give_the_published_rates(spark, counts, expected):
    row = evaluation.metrics(spark.createDataFrame([("m", *counts)], COUNTS)).first()
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-12)
    assert row["total_samples"] == sum(counts)


@pytest.mark.parametrize("rows", [[("m", 1, 0, 0.1, 0)], [("m", 1, 1, 0.9, 1)], [("m", 1, 1, 0.9, 0)]])
def test_one_class_gives_zeros_not_errors(spark, rows):
    df = table(spark, rows)
    row = evaluation.evaluate(df).first()
    assert all(0.0 <= row[c] <= 1.0 for c in ("accuracy", "precision", "recall", "f1", "fnr", "fpr", "tpr", "tnr"))
    assert evaluation.roc_auc(df).first()["auc_roc"] == 0.0
    assert evaluation.classification_report(evaluation.confusion(df)).count() == 5


def _auc(rows):
    pos = [p for *_, p, t in rows if t == 1]
    neg = [p for *_, p, t in rows if t == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_equals_all_pairs(random_predictions):
    rows, df = random_predictions
    got = {r["model"]: r["auc_roc"] for r in evaluation.roc_auc(df).collect()}
    for model in "abc":
        assert got[model] == pytest.approx(_auc([r for r in rows if r[0] == model]))


def test_auc_with_one_score_holding_most_rows(spark):
    rows = [("m", i, 1, 0.5, i % 2) for i in range(300)] + [("m", 900, 0, 0.2, 0), ("m", 901, 1, 0.99999, 1)]
    assert evaluation.roc_auc(table(spark, rows)).first()["auc_roc"] == pytest.approx(_auc(rows))


def test_curve_and_threshold(random_predictions):
    rows, df = random_predictions
    points = {(r["model"], r["threshold"]): r for r in curves.curve(df).collect()}
    for (model, threshold), r in points.items():
        mine = [x for x in rows if x[0] == model]
        tp = sum(x[3] >= threshold and x[4] == 1 for x in mine)
        fp = sum(x[3] >= threshold and x[4] == 0 for x in mine)
        assert (r["tp"], r["fp"]) == (tp, fp)
    best = {r["model"]: r for r in curves.best_threshold(curves.curve(df), max_fnr=0.2).collect()}
    for model, r in best.items():
        allowed = [p for (m, _), p in points.items() if m == model and p["fnr"] <= 0.2]
        f1 = lambda p: 2 * p["precision"] * p["tpr"] / (p["precision"] + p["tpr"])
        assert r["within_limit"] and r["f1"] == pytest.approx(max(map(f1, allowed)))


def test_report_against_hand_counts(spark):
    rows = {r["label"]: r for r in evaluation.classification_report(
        spark.createDataFrame([("m", 50, 10, 5, 35)], COUNTS)).collect()}
    assert rows["suicide"]["precision"] == pytest.approx(35 / 45) and rows["suicide"]["support"] == 40
    assert rows["non-suicide"]["recall"] == pytest.approx(50 / 60)
    assert rows["macro avg"]["recall"] == pytest.approx((50 / 60 + 35 / 40) / 2)
    assert rows["weighted avg"]["recall"] == pytest.approx(0.85) and rows["accuracy"]["f1"] == pytest.approx(0.85)


def test_confidence_bounds_are_strict(spark):
    df = table(spark, [("m", 1, 1, 0.9, 1), ("m", 2, 1, 0.91, 1), ("m", 3, 1, 0.6, 1), ("m", 4, 0, 0.41, 0)])
    row = evaluation.confidence_report(df).first()
    assert (row["pct_high"], row["pct_low"]) == (25.0, 25.0)


def test_side_by_side_and_best(random_predictions):
    rows, df = random_predictions
    wide = {r["key"]: r for r in comparison.side_by_side(df, ("a", "b", "c")).collect()}
    preds = {}
    for m, k, p, *_ in rows:
        preds.setdefault(k, {})[m] = p
    for k, r in wide.items():
        assert {m: r[f"{m}_pred"] for m in "abc"} == preds[k]
        assert r["models_disagree"] == (len(set(preds[k].values())) > 1)
    metrics = {r["model"]: r for r in evaluation.evaluate(df).collect()}
    best = {r["criterion"]: r["model"] for r in comparison.best_models(evaluation.evaluate(df)).collect()}
    assert best["fnr"] == min(metrics, key=lambda m: (metrics[m]["fnr"], m))
    assert best["f1"] == min(metrics, key=lambda m: (-metrics[m]["f1"], m))


def test_mcnemar(spark, random_predictions):
    rows, df = random_predictions
    right = {(m, k): p == t for m, k, p, _, t in rows}
    b = sum(right["a", k] and not right["b", k] for k in range(400))
    c = sum(not right["a", k] and right["b", k] for k in range(400))
    row = significance.mcnemar(df, "a", "b").first()
    assert (row["only_best_right"], row["only_baseline_right"]) == (b, c)
    assert row["chi_square"] == pytest.approx((abs(b - c) - 1) ** 2 / (b + c))
    same = significance.mcnemar(df, "a", "a").first()
    assert same["chi_square"] == 0.0 and not same["significant"]
    p = spark.createDataFrame([(3.841458820694124,)], "x double").select(significance.chi2_p_value("x").alias("p")).first()["p"]
    assert p == pytest.approx(0.05, abs=1e-9)


def test_wilson(spark):
    rows = {r["measure"]: r for r in significance.rate_intervals(
        spark.createDataFrame([("m", 0, 0, 2, 8)], COUNTS)).collect()}
    z, n, p = significance.Z_95, 10, 0.2
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert rows["fnr"]["low"] == pytest.approx(centre - half, abs=1e-6)
    assert rows["fnr"]["high"] == pytest.approx(centre + half, abs=1e-6)
    assert (rows["fpr"]["low"], rows["fpr"]["high"]) == (0.0, 0.0)


def test_bootstrap_is_repeatable_and_centred(random_predictions):
    _, df = random_predictions
    first = sorted(map(tuple, significance.bootstrap_f1(df, 50).collect()))
    again = sorted(map(tuple, significance.bootstrap_f1(df.repartition(3), 50).collect()))
    assert first == again
    f1 = {r["model"]: r["f1"] for r in evaluation.evaluate(df).collect()}
    for r in significance.bootstrap_interval(significance.bootstrap_f1(df, 100)).collect():
        assert r["f1_low"] <= f1[r["model"]] <= r["f1_high"]


def test_votes_and_buckets(random_predictions):
    rows, df = random_predictions
    got = {r["key"]: r["prob"] for r in ensembles.soft_vote(df).collect()}
    assert got[3] == pytest.approx(sum(q for _, k, _, q, _ in rows if k == 3) / 3, abs=1e-6)
    errors = ensembles.error_rows(df)
    sample = ensembles.review_sample(errors, 2)
    assert sample.groupBy("model", "bucket").agg(F.count("*").alias("n")).where("n > 2").count() == 0
    assert errors.count() == sum(p != t for _, _, p, _, t in rows)


def test_failed_predictions_count_as_negative(spark):
    df = table(spark, [("m", 1, None, None, 1), ("m", 2, 1, 0.9, 1)])
    assert tuple(evaluation.failure_count(df).first()) == ("m", 2, 1, 1)


def test_poisson_draws_from_counts(spark):
    """Mean and variance of many draws, on both sides of the switch, and repeatable."""
    from riskloom.operators import significance as sg

    for mean in (0, 1, 7, 390, 410, 1_000_000):
        rows = spark.range(4000).select(sg.poisson_draw(F.lit(mean), F.md5(F.concat(F.lit("x"), "id"))).alias("k"))
        got = rows.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v"), F.min("k").alias("low")).first()
        assert abs(got["m"] - mean) <= 4 * (mean / 4000) ** 0.5 and got["low"] >= 0
        assert abs(got["v"] - mean) <= 0.12 * mean


def test_cell_bootstrap_needs_no_rows(spark):
    from riskloom.operators import significance as sg

    counts = spark.createDataFrame([("a", 40, 60, 900), ("b", 0, 0, 0)], "model string, fp long, fn long, tp long")
    by = {r["model"]: r for r in sg.bootstrap_interval(sg.cell_bootstrap_f1(counts, 400)).collect()}
    assert by["b"]["f1_high"] == 0 and by["a"]["f1_low"] < 1800 / 1900 < by["a"]["f1_high"] and by["a"]["n_replicates"] == 400
    assert 0.01 < by["a"]["f1_high"] - by["a"]["f1_low"] < 0.04
