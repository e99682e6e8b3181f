"""Export queries: the rows each sink writes, and tables read back after a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import text
from riskloom.operators import corpus, evaluation, features, models, retraining
from riskloom.operators import feedback as fb
from riskloom.plans.catalog import Catalog
from riskloom.plans.catalog_evaluation import split_sql, _split_predictions
from riskloom.plans.catalog_models import _split_corpus
from riskloom.plans.catalog_feedback import ISO, READY_SQL, TOTALS_SQL
from riskloom.plans.oracle_views import ratio, word_count
from riskloom.operators import splits
from riskloom.plans.testbed import Testbed
from riskloom.session import materialize, scratch_path
from riskloom.sources import exports, readers, tables

_CLASS_SQL = "CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 'suicide' ELSE 'non-suicide' END"


def _stored_readiness(bed: Testbed) -> DataFrame:
    """Readiness from the newest row of the stored snapshot table."""
    stored = materialize(fb.daily_snapshot(bed.feedback), "feedback-stats")
    return fb.readiness_of(fb.latest_snapshot(stored))


def _jsonl(bed: Testbed) -> DataFrame:
    return exports.jsonl_rows(bed.feedback).select(
        "text", "label", "original_prediction", "is_correct", F.col("metadata.id").alias("id"),
        F.col("metadata.original_score").alias("original_score"),
        F.col("metadata.teacher_notes").alias("teacher_notes"), F.col("metadata.created_at").alias("created_at"))


def _corpus_csv(bed: Testbed) -> str:
    """The corpus as CSV below the shared folder, found among several places as a reader would."""
    path = scratch_path(bed.spark, "corpus-csv")
    exports.write_csv(bed.corpus.select("text", "class"), path)
    return readers.first_existing(bed.spark, [f"{path}-elsewhere", path])


def _batch(bed: Testbed) -> tuple[str, str]:
    """A correction batch below the shared folder: where, and its name."""
    root = scratch_path(bed.spark, "corrections")
    wrong = bed.feedback.where(~F.col("is_correct")).count()
    return root, exports.export_corrections(bed.feedback, root, wrong, "20240101_000000").rsplit("/", 1)[1]


def _listed(bed: Testbed) -> DataFrame:
    root, name = _batch(bed)
    rows = exports.read_export(bed.spark, root, name).agg(F.count("*").alias("n_rows")).withColumn("filename", F.lit(name))
    return exports.list_exports(bed.spark, root).select("filename").join(rows, "filename")


def _fetched(bed: Testbed) -> DataFrame:
    return exports.read_export(bed.spark, *_batch(bed))


def _appended(bed: Testbed) -> DataFrame:
    """Rows stored in two appends, read back with the declared schema."""
    path = scratch_path(bed.spark, "feedback-rows")
    for correct in (True, False):
        tables.append(bed.feedback.where(F.col("is_correct") == correct), path, schemas.FEEDBACK)
    return tables.read(bed.spark, path, schemas.FEEDBACK).select("id", "text", "status", "is_correct")


def _cached_features(bed: Testbed) -> DataFrame:
    """The second call finds what the first has stored."""
    path = scratch_path(bed.spark, "feature-cache")
    for _ in range(2):
        found = tables.feature_cache(
            bed.corpus, lambda df: df.select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words")), path, "words", "doc_id", "text")
    return found


def _cleaned(bed: Testbed) -> DataFrame:
    return materialize(corpus.relabel(bed.corpus).select("text", "class"), "cleaned")


def _summary(bed: Testbed) -> DataFrame:
    path = scratch_path(bed.spark, "training-summary")
    table = evaluation.evaluate(bed.model_predictions, ["model"]).select("model", F.round("accuracy", 6).alias("accuracy"), F.round("fnr", 6).alias("fnr"))
    for seed in ("42", "123"):
        tables.append_metrics(table, path, {"seed": seed})
    return bed.spark.read.parquet(path)


def _foreign_scorer():
    """Stands for a model that is not Spark's, and that some texts break."""
    def score(texts):
        if texts.str.contains("scum", regex=False).any():
            raise ValueError("text refused")
        return texts.str.len() / (texts.str.len() + 100.0)
    return score


def _foreign(bed: Testbed) -> DataFrame:
    return models.external_scores(bed.documents, _foreign_scorer, "doc_id").withColumn("prob", F.round("prob", 9))


def _results(bed: Testbed) -> DataFrame:
    metrics = evaluation.evaluate(_split_predictions(bed), ["model", "split"])
    document = exports.results_document(metrics, "lexicon", 42, {"max_seq_length": 256})
    return document.select(
        "model_type", "model_name", "seed", F.col("test_results.eval_accuracy").alias("test_accuracy"),
        F.col("test_results.eval_fnr").alias("test_fnr"), F.col("val_results.eval_accuracy").alias("val_accuracy"),
        F.col("val_results.eval_fnr").alias("val_fnr"))


def _malformed(bed: Testbed) -> DataFrame:
    """A corpus of which every fiftieth row has a column too many: what the tolerant reader keeps and what it sets aside."""
    path = scratch_path(bed.spark, "corpus-malformed")
    bad = F.col("doc_id") % 50 == 0
    exports.write_csv(bed.corpus.where(~bad).select("text", "class"), f"{path}/sound")
    exports.write_csv(bed.corpus.where(bad).select("text", "class", F.lit("spare").alias("more")), f"{path}/broken")
    kept = readers.read_corpus_tolerant(bed.spark, f"{path}/*").agg(
        F.count("*").alias("n_kept"), F.count_if(F.col("class") == "suicide").alias("n_suicide"))
    aside = readers.read_quarantine(bed.spark, f"{path}/*").agg(F.count("*")).scalar()
    return kept.withColumn("n_malformed", aside)


def _comparison_csv(bed: Testbed) -> DataFrame:
    """The table of all models, written as CSV and read back."""
    path = scratch_path(bed.spark, "model-comparison")
    table = evaluation.evaluate(bed.model_predictions).select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fnr", "fpr")])
    exports.write_csv(table, path)
    return bed.spark.read.schema(table.schema).option("header", True).csv(path)


def _artefact(bed: Testbed) -> DataFrame:
    """A trained model with its text stages, saved and loaded: it predicts what the one in memory does, from raw texts."""
    rows = _split_corpus(bed)
    text_model, table = models.featurize(rows, features.default_stop_words())
    fitted = models.logistic(table.where(F.col("split") == "train").drop("split"))
    path = scratch_path(bed.spark, "model")
    models.save(text_model, fitted, path)
    loaded = models.load(path).transform(rows).select("doc_id", F.col("prediction").cast("int").alias("again"))
    both = models.predictions(fitted, table, "artefact").join(loaded, F.col("key") == F.col("doc_id"))
    return both.groupBy("split").agg(F.count("*").alias("n_rows"), F.bool_and(F.col("pred") == F.col("again")).alias("same"))


def _combined_training_set(bed: Testbed) -> DataFrame:
    """Corpus and three copies of each text that reviewers corrected, written as CSV and read back."""
    path = scratch_path(bed.spark, "training-set")
    corrected = retraining.corrected_texts(bed.reviews, bed.predictions)
    exports.write_csv(splits.combine(bed.corpus, corrected, 3), path)
    return readers.read_corpus_csv(bed.spark, path)


def register(c: Catalog) -> None:
    c.add("s02_csv_malformed", _malformed, """
        SELECT count(*) FILTER (WHERE doc_id % 50 <> 0) AS n_kept, count(*) FILTER (WHERE doc_id % 50 <> 0 AND class = 'suicide') AS n_suicide,
               count(*) FILTER (WHERE doc_id % 50 = 0) AS n_malformed FROM corpus""")
    c.add("s15_comparison_csv", _comparison_csv, """
        SELECT model, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall,
               round(f1, 6) AS f1, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr FROM metrics""")
    c.add("s16_model_artefact", _artefact, f"""
        SELECT split, count(*) AS n_rows, true AS same FROM ({split_sql(splits.SPLIT_80_10_10)}) GROUP BY split""")
    c.add("s19_combined_training_set", _combined_training_set, """
        SELECT text, class FROM corpus UNION ALL
        SELECT p.text, CASE WHEN r.correct_class = 1 THEN 'suicide' ELSE 'non-suicide' END
        FROM reviews r JOIN predictions p ON r.prediction_id = p.id, range(1, 4) WHERE r.feedback_type = 'correction'""")
    c.add("s06_stored_readiness", _stored_readiness, READY_SQL.format(f"SELECT {TOTALS_SQL} FROM feedback"))
    c.add("s07_csv_rows", lambda b: exports.csv_rows(b.feedback, "reviewed", False), f"""
        SELECT id, text, original_prediction, original_score, teacher_correction, is_correct,
               coalesce(teacher_notes, '') AS teacher_notes, {ISO.format('feedback.created_at')} AS created_at, status
        FROM feedback WHERE status = 'reviewed' AND NOT is_correct""")
    c.add("s08_training_rows", lambda b: exports.training_rows(b.feedback), f"""
        SELECT text, {_CLASS_SQL} AS class, original_prediction, teacher_correction, is_correct,
               {ISO.format('feedback.created_at')} AS created_at, id AS feedback_id FROM feedback""")
    c.add("s09_jsonl_rows", _jsonl, f"""
        SELECT text, teacher_correction AS label, original_prediction, is_correct, id, original_score, teacher_notes,
               {ISO.format('feedback.created_at')} AS created_at FROM feedback""")
    c.add("s10_correction_classes", lambda b: exports.class_counts(exports.correction_rows(b.feedback)),
          f"SELECT {_CLASS_SQL} AS class, count(*) AS n_rows FROM feedback WHERE NOT is_correct GROUP BY 1")
    c.add("s01_csv_scan", lambda b: readers.read_corpus_csv(b.spark, _corpus_csv(b)), "SELECT text, class FROM corpus")
    c.add("s02_csv_tolerant", lambda b: readers.read_corpus_tolerant(b.spark, _corpus_csv(b)), "SELECT text, class FROM corpus")
    c.add("s11_list_exports", _listed, """
        SELECT 'corrections_' || count(*) || 'samples_20240101_000000.csv' AS filename, count(*) AS n_rows
        FROM feedback WHERE NOT is_correct""")
    c.add("s12_fetch_export", _fetched, f"SELECT text, {_CLASS_SQL} AS class FROM feedback WHERE NOT is_correct")
    c.add("s13_append_rows", _appended, "SELECT id, text, status, is_correct FROM feedback")
    c.add("s17_feature_cache", _cached_features, f"SELECT doc_id, CAST({word_count('text')} AS BIGINT) AS n_words FROM corpus")
    c.add("s18_cleaned_corpus", _cleaned, "SELECT text, CASE WHEN class = 'suicide' THEN 1 ELSE 0 END AS class FROM corpus")
    c.add("s20_training_summary", _summary, """
        SELECT seed, model, round(accuracy, 6) AS accuracy, round(fnr, 6) AS fnr FROM metrics, (VALUES ('42'), ('123')) s(seed)""")
    c.add("m09_foreign_scores", _foreign, """
        SELECT doc_id, CASE WHEN contains(text, 'scum') THEN NULL ELSE round(length(text) / (length(text) + 100.0e0), 9) END AS prob
        FROM documents""")
    test = lambda split, m: f"max(CASE WHEN split = '{split}' THEN {m} END)"
    c.add("s14_results_document", _results, f"""
        SELECT 'lexicon' AS model_type, model AS model_name, CAST(42 AS BIGINT) AS seed,
               {test('test', 'acc')} AS test_accuracy, {test('test', 'fnr')} AS test_fnr,
               {test('val', 'acc')} AS val_accuracy, {test('val', 'fnr')} AS val_fnr
        FROM (SELECT model, split, {ratio('count(*) FILTER (WHERE pred = truth)', 'count(*)')} AS acc,
                     {ratio('count(*) FILTER (WHERE truth = 1 AND pred = 0)', 'count(*) FILTER (WHERE truth = 1)')} AS fnr
              FROM model_predictions m JOIN ({split_sql(splits.SPLIT_80_10_10)}) s ON m.key = s.doc_id GROUP BY 1, 2)
        GROUP BY model""")
