"""Evaluation, comparison, significance and ensemble queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rates
from riskloom.operators import comparison, curves, ensembles, evaluation, significance, splits
from riskloom.plans.catalog import Catalog
from riskloom.plans.oracle_views import pct, ratio
from riskloom.plans.testbed import MODELS, Testbed

METRIC_SQL = """
    SELECT model, accuracy, "precision", recall, f1, fnr, fpr, recall AS tpr, tnr, tp AS true_positives,
           tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tn + fp + fn + tp AS total_samples,
           tp + fn AS positive_samples, tn + fp AS negative_samples FROM {0}"""

CONF_SQL = "CASE WHEN pred = 1 THEN prob ELSE 1.0e0 - prob END"

WIDE_SQL = "SELECT *, greatest({0}) <> least({0}) AS models_disagree FROM (SELECT key, {1} FROM model_predictions GROUP BY key)".format(
    ", ".join(f"{m}_pred" for m in MODELS),
    ", ".join(
        f"max(pred) FILTER (WHERE model = '{m}') AS {m}_pred, max({CONF_SQL}) FILTER (WHERE model = '{m}') AS {m}_conf"
        for m in MODELS))

CURVE_SQL = """
    SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
           CASE WHEN p > 0 THEN tp / p ELSE 0 END AS tpr, CASE WHEN n > 0 THEN fp / n ELSE 0 END AS fpr,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision",
           CASE WHEN p > 0 THEN (p - tp) / p ELSE 0 END AS fnr
    FROM (SELECT model, threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
                 sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
          FROM (SELECT model, prob AS threshold, count(*) FILTER (WHERE truth = 1) AS pos,
                       count(*) FILTER (WHERE truth = 0) AS neg FROM model_predictions GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

BUCKET_SQL = f"""
    SELECT *, CASE WHEN truth = 1 THEN 'FN' ELSE 'FP' END || '_' ||
              CASE WHEN {CONF_SQL} >= 0.9 THEN 'high' ELSE 'low' END AS bucket
    FROM model_predictions WHERE pred <> truth"""


def _confusion(bed: Testbed) -> DataFrame:
    return evaluation.confusion(bed.model_predictions)


def _split_predictions(bed: Testbed) -> DataFrame:
    """Predictions with the 80/10/10 split of their rows."""
    split = splits.stratified_split(bed.corpus_classes, "doc_id").select(F.col("doc_id").alias("key"), "split")
    return bed.model_predictions.join(split, "key")


def _wide(bed: Testbed) -> DataFrame:
    return comparison.side_by_side(bed.model_predictions, MODELS)


def _table(bed: Testbed) -> DataFrame:
    return evaluation.evaluate(bed.model_predictions)


def _auc(bed: Testbed) -> DataFrame:
    return evaluation.roc_auc(bed.model_predictions).withColumn("auc_roc", F.round("auc_roc", 9))


def _auc_linear(bed: Testbed) -> DataFrame:
    """Many distinct scores: the linear scorer against the truth."""
    joined = bed.linear_scores.join(bed.truth, "doc_id").withColumns({"model": F.lit("linear"), "prob": F.round("prob", 12)})
    return evaluation.roc_auc(joined).withColumn("auc_roc", F.round("auc_roc", 9))


def _training_times(bed: Testbed) -> DataFrame:
    """Seconds per kind of event, in the place of seconds per trained model."""
    seconds = bed.table("events").groupBy(F.col("event_type").alias("model")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cs"))
    return seconds.select(
        "model", F.round(F.col("cs") / 100.0 / 3600.0, 6).alias("hours"),
        rates.duration_text(F.col("cs") / 100.0).alias("duration"))


def _votes(bed: Testbed) -> DataFrame:
    return ensembles.soft_vote(bed.model_predictions).withColumn("prob", F.round("prob", 6))


def _weighted(bed: Testbed) -> DataFrame:
    """Weights are the models' F1 on a fifth of the rows; the other rows are voted on."""
    rows = bed.model_predictions
    weights = evaluation.evaluate(rows.where(F.col("key") % 5 == 0), ["model"]).select("model", F.round("f1", 6).alias("weight"))
    return ensembles.weighted_vote(rows.where(F.col("key") % 5 != 0), weights).withColumn("prob", F.round("prob", 6))


def _cell_bootstrap(bed: Testbed) -> DataFrame:
    """Intervals from confusion counts alone, held against those of the version that draws a weight for every row.

    Both are random: means have to lie within a quarter of the interval's width, ends within half of it.
    """
    rows = significance.bootstrap_interval(significance.bootstrap_f1(bed.model_predictions))
    cells = significance.bootstrap_interval(significance.cell_bootstrap_f1(evaluation.confusion(bed.model_predictions)))
    width = F.col("r.f1_high") - F.col("r.f1_low")
    near = lambda c, share: F.abs(F.col(f"c.{c}") - F.col(f"r.{c}")) <= share * width + 0.01
    return cells.alias("c").join(rows.alias("r"), F.col("c.model") == F.col("r.model")).select(
        "c.model", "c.n_replicates", (near("f1_mean", 0.25) & near("f1_low", 0.5) & near("f1_high", 0.5)).alias("agrees"))


def _review(bed: Testbed) -> DataFrame:
    missed = ensembles.error_rows(bed.model_predictions).where(F.col("truth") == 1)
    return ensembles.review_sample(missed, 50).select("model", "bucket", "rank", "key")


def _threshold(bed: Testbed) -> DataFrame:
    return curves.best_threshold(curves.curve(bed.model_predictions), max_fnr=0.5)


def _mcnemar_p(bed: Testbed) -> DataFrame:
    """The same test with its p-value, which SQL has no function for."""
    return significance.mcnemar(bed.model_predictions, "m_full", "m_high").select(
        "chi_square", F.round(significance.chi2_p_value("chi_square"), 9).alias("p_value"))


def _gap(bed: Testbed) -> DataFrame:
    return splits.stratification_gap(splits.stratified_split(bed.corpus_classes, "doc_id"))


SPLIT_SQL = """
    SELECT doc_id, class, CASE WHEN r * {den} <= n * {a} THEN '{pa}' {mid} ELSE '{pz}' END AS split
    FROM (SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || doc_id), doc_id) AS r,
                 count(*) OVER (PARTITION BY class) AS n FROM corpus)"""


def split_sql(parts) -> str:
    total, upto, whens = sum(n for _, n in parts), 0, []
    for name, n in parts[:-1]:
        upto += n
        whens.append((upto, name))
    mid = " ".join(f"WHEN r * {total} <= n * {u} THEN '{name}'" for u, name in whens[1:])
    return SPLIT_SQL.format(den=total, a=whens[0][0], pa=whens[0][1], mid=mid, pz=parts[-1][0])


def register(c: Catalog) -> None:
    c.add("e01_confusion", _confusion, "SELECT model, tn, fp, fn, tp FROM cells")
    c.add("e02_metric_set", _table, METRIC_SQL.format("metrics"))
    c.add("e03_confusion_table", lambda b: evaluation.confusion_table(_confusion(b)), "\n UNION ALL ".join(
        f"SELECT model, '{name}' AS cell, {cell} AS n_rows, '{meaning}' AS meaning FROM cells"
        for cell, (name, meaning) in evaluation.CELL_TEXT.items()))
    c.add("e04_classification_report", lambda b: evaluation.classification_report(_confusion(b)).select(
        "model", "label", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"),
        F.round("f1", 9).alias("f1"), "support"), f"""
        SELECT model, label, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1, support FROM (
          SELECT model, 'non-suicide' AS label, p0 AS p, r0 AS r, f0 AS f, n0 AS support FROM reported
          UNION ALL SELECT model, 'suicide', p1, r1, f1, n1 FROM reported
          UNION ALL SELECT model, 'accuracy', acc, acc, acc, n0 + n1 FROM reported
          UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM reported
          UNION ALL SELECT model, 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
                    (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM reported)""".replace("reported", f"""(
            SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
                   CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM (
            SELECT model, {ratio('tn', 'tn + fn')} AS p0, {ratio('tn', 'tn + fp')} AS r0,
                   {ratio('tp', 'tp + fp')} AS p1, {ratio('tp', 'tp + fn')} AS r1, tn + fp AS n0, tp + fn AS n1,
                   {ratio('tp + tn', 'tp + tn + fp + fn')} AS acc FROM cells))"""))
    c.add("e05_sensitivity_specificity", lambda b: evaluation.sensitivity_specificity(_confusion(b)),
          "SELECT model, recall AS sensitivity, tnr AS specificity FROM metrics")
    auc_sql = """
        SELECT model, round(CASE WHEN p * n > 0 THEN (s - p * (p + 1) / 2) / (p * n) ELSE 0 END, 9) AS auc_roc FROM (
          SELECT model, sum(CASE WHEN truth = 1 THEN mid ELSE 0 END) AS s,
                 CAST(count(*) FILTER (WHERE truth = 1) AS DOUBLE) AS p,
                 CAST(count(*) FILTER (WHERE truth = 0) AS DOUBLE) AS n
          FROM (SELECT model, truth, rank() OVER (PARTITION BY model ORDER BY prob)
                       + (count(*) OVER (PARTITION BY model, prob) - 1) / 2 AS mid FROM ({0})) GROUP BY model)"""
    c.add("e06_roc_auc", _auc, auc_sql.format("SELECT * FROM model_predictions"))
    c.add("e06_roc_auc_linear", _auc_linear, auc_sql.format(
        "SELECT 'linear' AS model, round(s.prob, 12) AS prob, t.truth FROM linear_scores s JOIN truth_rows t ON s.doc_id = t.doc_id"))
    c.add("e07_confidence", lambda b: evaluation.confidence_report(b.model_predictions), f"""
        SELECT model, count(*) AS n_rows, round(avg(c), 6) AS mean_confidence,
               {pct('count(*) FILTER (WHERE c > 0.9)', 'count(*)')} AS pct_high,
               {pct('count(*) FILTER (WHERE c < 0.6)', 'count(*)')} AS pct_low
        FROM (SELECT model, {CONF_SQL} AS c FROM model_predictions) GROUP BY model""")
    c.add("e08_test_split_metrics",
          lambda b: evaluation.evaluate(_split_predictions(b), ["split", "model"]).select(
              "split", "model", "accuracy", "precision", "recall", "f1", "fnr"), f"""
        SELECT split, model, accuracy, "precision", recall,
               CASE WHEN "precision" + recall > 0 THEN 2.0e0 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1, fnr
        FROM (SELECT split, model, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
                     {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall,
                     {ratio('fn', 'fn + tp')} AS fnr
              FROM (SELECT s.split, m.model, count(*) FILTER (WHERE truth = 0 AND pred = 0) AS tn,
                           count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp,
                           count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn,
                           count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp
                    FROM model_predictions m JOIN ({split_sql(splits.SPLIT_80_10_10)}) s ON m.key = s.doc_id
                    GROUP BY 1, 2))""")
    c.add("j04_side_by_side", _wide, WIDE_SQL)
    c.add("e09_disagreements", lambda b: comparison.disagreements(_wide(b)),
          f"SELECT * FROM ({WIDE_SQL}) WHERE models_disagree")
    c.add("e10_model_table", lambda b: _table(b).select(
        "model", "accuracy", "precision", "recall", "f1", "true_positives", "false_positives", "true_negatives",
        "false_negatives", "fnr"), """
        SELECT model, accuracy, "precision", recall, f1, tp AS true_positives, fp AS false_positives,
               tn AS true_negatives, fn AS false_negatives, fnr FROM metrics""")
    points = ", ".join(f'round((m."{x}" - b."{x}") * 100, 6) AS {x}_points' for x in comparison.MEASURES)
    delta = f"SELECT m.model, {points} FROM metrics m, metrics b WHERE b.model = 'm_high' AND m.model <> 'm_high'"
    c.add("e11_over_base", lambda b: comparison.over_base(_table(b), "m_high"), delta)
    c.add("j05_base_model_delta", lambda b: comparison.over_base(_table(b), "m_high").select("model", "f1_points", "fnr_points"),
          f"SELECT model, f1_points, fnr_points FROM ({delta})")
    c.add("e12_best_models", lambda b: comparison.best_models(_table(b)), """
        SELECT * FROM (SELECT 'accuracy' AS criterion, model, accuracy AS value FROM metrics ORDER BY accuracy DESC, model LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'f1', model, f1 FROM metrics ORDER BY f1 DESC, model LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'fnr', model, fnr FROM metrics ORDER BY fnr, model LIMIT 1)""")
    c.add("e13_targets", lambda b: evaluation.with_targets(_table(b)).select(
        "model", "fnr", "f1", "fnr_ok", "f1_ok", "meets_target"), """
        SELECT model, fnr, f1, fnr < 0.05 AS fnr_ok, f1 > 0.9 AS f1_ok, fnr < 0.05 AND f1 > 0.9 AS meets_target FROM metrics""")
    c.add("e14_training_times", _training_times, """
        SELECT model, round(cs / 100.0e0 / 3600.0e0, 6) AS hours,
               CASE WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' WHEN m > 0 THEN m || 'm ' || s || 's' ELSE s || 's' END AS duration
        FROM (SELECT model, cs, cs // 360000 AS h, cs % 360000 // 6000 AS m, cs % 6000 // 100 AS s
              FROM (SELECT event_type AS model, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cs FROM events GROUP BY 1))""")
    c.add("m10_failed_default", lambda b: evaluation.failure_count(
        b.model_predictions.withColumn("pred", F.when(F.col("key") % 13 != 0, F.col("pred")))), """
        SELECT model, count(*) AS n_rows, count(*) FILTER (WHERE key % 13 = 0) AS n_failed,
               CAST(sum(CASE WHEN key % 13 = 0 THEN 0 ELSE pred END) AS BIGINT) AS n_positive
        FROM model_predictions GROUP BY model""")
    c.add("d01_mcnemar", lambda b: significance.mcnemar(b.model_predictions, "m_full", "m_high"), """
        SELECT n_pairs, b AS only_best_right, c AS only_baseline_right,
               CASE WHEN b + c > 0 THEN (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) ELSE 0 END AS chi_square,
               CASE WHEN b + c > 0 THEN (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) ELSE 0 END > 3.841458820694124 AS significant
        FROM (SELECT count(*) AS n_pairs, count(*) FILTER (WHERE x.pred = x.truth AND y.pred <> y.truth) AS b,
                     count(*) FILTER (WHERE x.pred <> x.truth AND y.pred = y.truth) AS c
              FROM model_predictions x JOIN model_predictions y ON x.key = y.key
              WHERE x.model = 'm_full' AND y.model = 'm_high')""")
    c.add("d01_mcnemar_p_value", _mcnemar_p)
    c.add("d02_across_seeds", lambda b: significance.across_seeds(b.runs), """
        SELECT model, count(*) AS n_runs, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std,
               round(avg(fnr), 6) AS fnr_mean, round(stddev_samp(fnr), 6) AS fnr_std FROM runs GROUP BY model""")
    c.add("d03_paired_t", lambda b: significance.paired_t(b.runs, "m_full", "m_high"), """
        SELECT count(*) AS n_pairs, round(avg(d), 6) AS mean_difference,
               round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t_statistic,
               count(*) - 1 AS degrees
        FROM (SELECT x.f1 - y.f1 AS d FROM runs x JOIN runs y ON x.seed = y.seed
              WHERE x.model = 'm_full' AND y.model = 'm_high')""")
    z = significance.Z_95
    c.add("d04_rate_intervals", lambda b: significance.rate_intervals(_confusion(b)), f"""
        SELECT model, measure, round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 6) AS value,
               CASE WHEN n > 0 THEN round((k / n + {z}e0 * {z}e0 / (2 * n)) / (1 + {z}e0 * {z}e0 / n)
                 - {z}e0 * sqrt(k / n * (1 - k / n) / n + {z}e0 * {z}e0 / (4 * n * n)) / (1 + {z}e0 * {z}e0 / n), 6) ELSE 0 END AS low,
               CASE WHEN n > 0 THEN round((k / n + {z}e0 * {z}e0 / (2 * n)) / (1 + {z}e0 * {z}e0 / n)
                 + {z}e0 * sqrt(k / n * (1 - k / n) / n + {z}e0 * {z}e0 / (4 * n * n)) / (1 + {z}e0 * {z}e0 / n), 6) ELSE 0 END AS high
        FROM (SELECT model, 'accuracy' AS measure, CAST(tp + tn AS DOUBLE) AS k, CAST(tp + tn + fp + fn AS DOUBLE) AS n FROM cells
              UNION ALL SELECT model, 'fnr', fn, fn + tp FROM cells
              UNION ALL SELECT model, 'fpr', fp, fp + tn FROM cells)""")
    weight = " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(significance.POISSON_1))
    boot = f"""
        SELECT model, replicate, CASE WHEN 2 * tp + wrong > 0 THEN tp * 2.0e0 / (tp * 2 + wrong) ELSE 0 END AS f1 FROM (
          SELECT model, replicate, sum(CASE WHEN truth = 1 AND pred = 1 THEN w ELSE 0 END) AS tp,
                 sum(CASE WHEN truth <> pred THEN w ELSE 0 END) AS wrong
          FROM (SELECT *, CASE {weight} ELSE {len(significance.POISSON_1)} END AS w FROM (
            SELECT m.*, CAST(r AS INTEGER) AS replicate,
                   CAST(('0x' || substring(md5('42|' || r || '|' || key), 1, 8)) AS BIGINT) / 4294967296.0e0 AS u
            FROM model_predictions m, range(1, 201) g(r) WHERE pred = 1 OR truth = 1)) GROUP BY 1, 2)"""
    c.add("d04_bootstrap_f1", lambda b: significance.bootstrap_f1(b.model_predictions), boot)
    c.add("d04_bootstrap_interval",
          lambda b: significance.bootstrap_interval(significance.bootstrap_f1(b.model_predictions)), f"""
        SELECT model, count(*) AS n_replicates, round(avg(f1), 6) AS f1_mean, round(quantile_cont(f1, 0.025), 6) AS f1_low,
               round(quantile_cont(f1, 0.975), 6) AS f1_high
        FROM ({boot}) GROUP BY model""")
    c.add("d04_cell_bootstrap", _cell_bootstrap, "SELECT DISTINCT model, CAST(200 AS BIGINT) AS n_replicates, true AS agrees FROM model_predictions")
    c.add("d05_soft_vote", _votes, """
        SELECT key, round(prob, 6) AS prob, truth, n_models, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM (
          SELECT key, avg(prob) AS prob, max(truth) AS truth, count(*) AS n_models FROM model_predictions GROUP BY key)""")
    c.add("d06_weighted_vote", _weighted, """
        SELECT key, round(prob, 6) AS prob, truth, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM (
          SELECT key, CASE WHEN sum(w) > 0 THEN sum(prob * w) / sum(w) ELSE 0 END AS prob, max(truth) AS truth
          FROM (SELECT p.*, m.w FROM model_predictions p JOIN (
            SELECT model, round(CASE WHEN tp > 0 THEN 2.0e0 * tp / (2 * tp + wrong) ELSE 0 END, 6) AS w FROM (
              SELECT model, count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE truth <> pred) AS wrong
              FROM model_predictions WHERE key % 5 = 0 GROUP BY model)) m ON p.model = m.model
          WHERE key % 5 <> 0) GROUP BY key)""")
    c.add("d08_error_buckets", lambda b: ensembles.error_buckets(b.model_predictions),
          f"SELECT model, bucket, count(*) AS n_rows FROM ({BUCKET_SQL}) GROUP BY 1, 2")
    c.add("d09_review_sample", _review, f"""
        SELECT model, bucket, CAST(rank AS INTEGER) AS rank, key FROM (
          SELECT *, row_number() OVER (PARTITION BY model, bucket ORDER BY md5('42|' || key), key) AS rank
          FROM ({BUCKET_SQL}) WHERE truth = 1) WHERE rank <= 50""")
    c.add("d10_curve", lambda b: curves.curve(b.model_predictions), CURVE_SQL)
    c.add("d10_binned_curve", lambda b: curves.binned_curve(b.model_predictions, bins=100), CURVE_SQL.replace(
        "prob AS threshold", "least(floor(prob * 100), 99) / 100.0e0 AS threshold"))
    c.add("d11_best_threshold", _threshold, f"""
        SELECT model, threshold, f1, fnr, fpr, within_limit FROM (
          SELECT *, row_number() OVER (PARTITION BY model ORDER BY within_limit DESC, f1 DESC, threshold DESC) AS r FROM (
            SELECT *, fnr <= 0.5 AS within_limit, CASE WHEN "precision" + tpr > 0
                   THEN 2.0e0 * "precision" * tpr / ("precision" + tpr) ELSE 0 END AS f1 FROM ({CURVE_SQL}))) WHERE r = 1""")
    c.add("d15_stratification_gap", _gap, f"""
        SELECT class, round(max(abs(n / split_n - class_n / all_n)), 6) AS max_gap, CAST(max(class_n) AS BIGINT) AS n_rows FROM (
          SELECT class, n, sum(n) OVER (PARTITION BY split) AS split_n, sum(n) OVER (PARTITION BY class) AS class_n,
                 sum(n) OVER () AS all_n
          FROM (SELECT split, class, count(*) AS n FROM ({split_sql(splits.SPLIT_80_10_10)}) GROUP BY 1, 2)) GROUP BY class""")
