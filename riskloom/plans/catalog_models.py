"""Feature and model queries.  Training is eager: Spark ML fits when the query is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels as lb
from riskloom.operators import evaluation, features, models, retraining, skew, splits
from riskloom.plans import retraining_cycle
from riskloom.plans.catalog import Catalog
from riskloom.plans.catalog_evaluation import split_sql
from riskloom.plans.testbed import MODELS, Testbed

SEARCH_DRAWS = 16

# a short list for the queries that SQL checks; the library's default is Spark's English list
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "are", "with")

_features: dict[tuple[str, str], DataFrame] = {}

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

GRAMS_SQL = f"""
    SELECT doc_id, list_concat(k, CASE WHEN len(k) > 1 THEN list_transform(range(1, len(k)),
             lambda i: k[i] || ' ' || k[i + 1]) ELSE CAST([] AS VARCHAR[]) END) AS grams
    FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{features.TOKEN}'),
                 lambda t: t NOT IN ({_STOP_SQL})) AS k FROM documents)"""

VOCABULARY_SQL = f"""
    SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM (
      SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(grams) AS term FROM ({GRAMS_SQL})) GROUP BY 1, 2)
    GROUP BY term HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM documents) * 0.95e0
    ORDER BY n DESC, term LIMIT 10000"""

TFIDF_SQL = f"""
    SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
      SELECT doc_id, term, tf, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1.0e0) AS raw FROM (
        SELECT g.doc_id, g.term, v.df, count(*) AS tf
        FROM (SELECT doc_id, unnest(grams) AS term FROM ({GRAMS_SQL})) g JOIN ({VOCABULARY_SQL}) v ON g.term = v.term
        GROUP BY 1, 2, 3))"""


def _grams(bed: Testbed) -> DataFrame:
    return features.grams(bed.texts, STOP_WORDS)


def _n_docs(bed: Testbed):
    return bed.documents.agg(F.count("*")).scalar()


def _tokens(bed: Testbed) -> DataFrame:
    return _grams(bed).select("doc_id", F.size("grams").cast("long").alias("n_grams"), F.array_join("grams", ",").alias("grams"))


def _vocabulary(bed: Testbed) -> DataFrame:
    return features.vocabulary(_grams(bed), _n_docs(bed))


def _tfidf(bed: Testbed) -> DataFrame:
    """The texts are partitioned by document once, a few MB to a task; vocabulary and weights both read that."""
    texts = skew.dealt(bed.documents, "doc_id", skew.parts_of(bed.documents, "text"))
    grams = features.grams(texts, STOP_WORDS)
    n_docs = _n_docs(bed)
    return features.tfidf(grams, features.vocabulary(grams, n_docs), n_docs, "doc_id")


def _split_corpus(bed: Testbed) -> DataFrame:
    split = splits.stratified_split(bed.corpus_classes, "doc_id").select("doc_id", "split")
    labelled = bed.corpus_classes.withColumn("label", lb.class_of(F.col("class"))).drop("class").join(split, "doc_id")
    return bed.texts.join(labelled, "doc_id")


def _features_of(bed: Testbed) -> DataFrame:
    """Feature table of the labelled corpus, fitted on its train part and stored once per session."""
    at = (bed.spark.sparkContext.applicationId, bed.sf_dir)
    if at not in _features:
        _features[at] = models.featurize(_split_corpus(bed), features.default_stop_words())[1]
    return _features[at]


def _train(bed: Testbed) -> DataFrame:
    return _features_of(bed).where(F.col("split") == "train").drop("split")


def _logistic(bed: Testbed) -> DataFrame:
    table = _features_of(bed)
    fitted = models.logistic(_train(bed))
    return models.predictions(fitted, table, "tfidf_logistic").withColumn("prob", F.round("prob", 6))


def _train_evaluate(bed: Testbed) -> DataFrame:
    return models.by_split(_logistic(bed))


def _both_losses(bed: Testbed) -> DataFrame:
    train, table = _train(bed), _features_of(bed)
    return models.predictions(models.logistic(train), table, "weighted").unionByName(
        models.predictions(models.logistic(train, balanced=False), table, "unweighted"))


def _weighted_loss(bed: Testbed) -> DataFrame:
    """Balanced against unweighted training, all else equal, by split."""
    return models.by_split(_both_losses(bed))


def _best_by_f1(bed: Testbed) -> DataFrame:
    best, _ = models.select_by_f1(_train(bed), (0.0001, 0.001, 0.01))
    return models.by_split(models.predictions(best, _features_of(bed), "best_by_f1"))


def _facts(scored: DataFrame) -> DataFrame:
    """What SQL can say of a trained model's predictions: rows and positives of each part, and that its figures are sound."""
    sound = ["accuracy", "precision", "recall", "f1"]
    counted = scored.groupBy("model", "split").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("truth") == 1).alias("n_positive"),
        F.bool_and(F.col("pred").isin(0, 1)).alias("every_row_decided"))
    rated = models.by_split(scored).select("model", "split", F.forall(F.array(*sound), lambda m: (m >= 0) & (m <= 1)).alias("rates_in_range"))
    return counted.join(rated, ["model", "split"])


def _search_facts(bed: Testbed) -> DataFrame:
    """The random search: every draw was tried, the winner trained to the common cap, and each part was scored whole."""
    best, tried = models.select_by_f1(_train(bed), models.random_penalties(SEARCH_DRAWS))
    most = max(f1 for _, f1, iterations in tried if iterations == models.MAX_ITER)
    last = [p for p, f1, iterations in tried if iterations == models.MAX_ITER and f1 == most]
    return _facts(models.predictions(best, _features_of(bed), "random_search")).withColumns({
        "n_settings": F.lit(len({p for p, *_ in tried})), "winner_is_best": F.lit(best.getRegParam() == min(last))})


def _svm(bed: Testbed) -> DataFrame:
    return models.by_split(models.predictions(models.svm(_train(bed)), _features_of(bed), "tfidf_svm"))


def _search(bed: Testbed) -> DataFrame:
    best, _ = models.select_by_f1(_train(bed), models.random_penalties(SEARCH_DRAWS))
    return models.by_split(models.predictions(best, _features_of(bed), "random_search"))


def _stacked(bed: Testbed) -> DataFrame:
    probs = bed.model_predictions.groupBy("key", "truth").pivot("model", list(MODELS)).agg(F.max("prob"))
    wide = probs.withColumn("fold", (F.col("key") % 2).cast("int"))
    return evaluation.evaluate(models.stack(wide, MODELS))


def _cycle(bed: Testbed) -> DataFrame:
    """The whole cycle on the labelled corpus and all its reviewed rows, behind the default gate; metrics by part."""
    return retraining_cycle.run(bed.corpus, bed.feedback, "retrained", corrections_only=False).metrics


def _cycle_facts(bed: Testbed) -> DataFrame:
    """Rows of the stored training set by part and origin, and whether the log speaks of every reviewed row."""
    cycle = retraining_cycle.run(bed.corpus, bed.feedback, "retrained", corrections_only=False)
    logged = cycle.log.agg(F.sum("num_samples")).scalar() == bed.feedback.where(F.col("text").isNotNull()).agg(F.count("*")).scalar()
    return cycle.training_set.groupBy("split", "origin", "label").agg(F.count("*").alias("n_rows")).withColumn("all_logged", logged)


def _retraining(split_first: bool):
    def job(bed: Testbed) -> DataFrame:
        rows = retraining.tagged(bed.corpus, bed.feedback.where(~F.col("is_correct")).select(
            F.col("id").alias("feedback_id"), "text",
            F.when(F.col("teacher_correction").isin("HIGH", "MEDIUM"), "suicide").otherwise("non-suicide").alias("class")))
        return retraining.training_set(rows, 5, split_first).select("key", "origin", "class", "split")
    return job


_TAGGED_SQL = """
    SELECT 'o' || doc_id AS key, 'original' AS origin, class FROM corpus
    UNION ALL SELECT 'f' || id, 'feedback', CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 'suicide'
      ELSE 'non-suicide' END FROM feedback WHERE NOT is_correct"""

_CUT_SQL = """
    SELECT key, origin, class, CASE WHEN r * 10 <= n * 9 THEN 'train' ELSE 'eval' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || key), key) AS r,
             count(*) OVER (PARTITION BY class) AS n FROM ({0}))"""

_SPLIT_FIRST = f"""
    SELECT key || '#' || CAST(c AS INTEGER) AS key, origin, class, split
    FROM ({_CUT_SQL}), range(1, 6) g(c) WHERE c = 1 OR (origin = 'feedback' AND split = 'train')"""

SPLIT_FIRST_SQL = _SPLIT_FIRST.format(_TAGGED_SQL)

OVERSAMPLE_FIRST_SQL = _CUT_SQL.format(f"""
    SELECT key || '#' || CAST(c AS INTEGER) AS key, origin, class FROM ({_TAGGED_SQL}), range(1, 6) g(c)
    WHERE c = 1 OR origin = 'feedback'""")


def _facts_sql(*names: str) -> str:
    return f"""
        SELECT m.model, split, count(*) AS n_rows, count(*) FILTER (WHERE class = 'suicide') AS n_positive,
               true AS every_row_decided, true AS rates_in_range
        FROM ({split_sql(splits.SPLIT_80_10_10)}), (SELECT unnest([{', '.join(repr(n) for n in names)}]) AS model) m GROUP BY 1, 2"""


def register(c: Catalog) -> None:
    c.add("m01_tokens", _tokens,
          f"SELECT doc_id, len(grams) AS n_grams, array_to_string(grams, ',') AS grams FROM ({GRAMS_SQL})")
    c.add("m02_vocabulary", _vocabulary, VOCABULARY_SQL)
    c.add("m03_tfidf", _tfidf, TFIDF_SQL)
    c.add("m04_logistic_scores", _logistic)
    c.add("m05_train_evaluate", _train_evaluate)
    c.add("m05_retraining_cycle", _cycle)
    c.add("m05_retraining_facts", _cycle_facts, f"""
        SELECT split, origin, CASE class WHEN 'suicide' THEN 1 ELSE 0 END AS label, count(*) AS n_rows, true AS all_logged
        FROM ({_SPLIT_FIRST.format(_TAGGED_SQL.replace(" WHERE NOT is_correct", ""))}) GROUP BY 1, 2, 3""")
    c.add("m07_weighted_loss", _weighted_loss)
    c.add("m07_weighted_loss_facts", lambda b: _facts(_both_losses(b)), _facts_sql("weighted", "unweighted"))
    c.add("m04_logistic_facts", lambda b: _facts(_logistic(b)), _facts_sql("tfidf_logistic"))
    c.add("d14_random_search_facts", _search_facts, f"""
        SELECT *, CAST({SEARCH_DRAWS} AS INTEGER) AS n_settings, true AS winner_is_best FROM ({_facts_sql('random_search')})""")
    c.add("m08_best_by_f1", _best_by_f1)
    c.add("d07_stacking", _stacked)
    c.add("d13_linear_svm", _svm)
    c.add("d14_random_search", _search)
    c.add("k09_training_set_split_first", _retraining(True), SPLIT_FIRST_SQL)
    c.add("k09_training_set_oversample_first", _retraining(False), OVERSAMPLE_FIRST_SQL)
