import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import evaluation, features, models, scoring, splits
from riskloom.plans import retraining_cycle

GOOD = ["sunny day with friends", "great workout and good food", "happy family weekend trip", "new project excites me"]
BAD = ["nothing matters anymore tonight", "cannot take this pain anymore", "everything feels dark and pain", "nobody would miss me tonight"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"{(BAD if i % 3 == 0 else GOOD)[i % 4]} number{i % 7}", int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    cls = F.when(F.col("label") == 1, "suicide").otherwise("non-suicide")
    return splits.stratified_split(df.withColumn("class", cls), "doc_id").drop("class")


@pytest.fixture(scope="module")
def fitted(corpus):
    return models.featurize(corpus, features.default_stop_words())


def test_vocabulary_comes_from_the_train_part_only(spark, corpus, fitted, tmp_path):
    model, table = fitted
    vocabulary = set(model.stages[4].vocabulary)
    assert "pain anymore" in vocabulary and "and" not in vocabulary
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(corpus).select("doc_id", "features")
    assert sorted(map(str, again.collect())) == sorted(map(str, table.select("doc_id", "features").collect()))


def test_logistic_separates_and_is_reported_by_split(fitted):
    _, table = fitted
    fit = models.logistic(table.where("split = 'train'").drop("split"))
    rows = {r["split"]: r for r in models.by_split(models.predictions(fit, table, "m")).collect()}
    assert set(rows) == {"train", "val", "test"} and rows["test"]["f1"] == 1.0


def test_svm_and_selection(fitted):
    _, table = fitted
    train = table.where("split = 'train'").drop("split")
    scored = models.predictions(models.svm(train), table, "svm")
    assert scored.where("prob is not null").count() == 0
    assert evaluation.evaluate(scored).first()["accuracy"] > 0.95
    draws = models.random_penalties(5)
    best, tried = models.select_by_f1(train, draws, parallelism=2)
    assert [p for p, *_ in tried] == draws and {n for *_, n in tried} >= {models.ROUNDS[0], models.MAX_ITER}
    again, same = models.select_by_f1(train.repartition(7), draws, parallelism=1)
    assert again.getRegParam() == best.getRegParam() and [p for p, *_ in same] == draws
    assert evaluation.evaluate(models.predictions(best, table, "b")).first()["accuracy"] > 0.95


def test_stacking_scores_every_row_once(spark):
    rows = [(i, 0.9 if i % 3 == 0 else 0.2, 0.5, int(i % 3 == 0), i % 2) for i in range(120)]
    wide = spark.createDataFrame(rows, "key long, a double, b double, truth int, fold int")
    out = models.stack(wide, ["a", "b"])
    assert out.count() == 120 and out.select("key").distinct().count() == 120
    assert evaluation.evaluate(out).first()["accuracy"] == 1.0


def test_grams_and_tfidf(spark):
    df = spark.createDataFrame([(1, "The Pain of Pain, a b cd"), (2, "pain cd"), (3, "")], "doc_id int, text string")
    grams = features.grams(df, ["the", "of"])
    got = {r["doc_id"]: r["grams"] for r in grams.collect()}
    assert got[1] == ["pain", "pain", "cd", "pain pain", "pain cd"] and got[2] == ["pain", "cd", "pain cd"] and got[3] == []
    vocab = features.vocabulary(grams, 3, min_df=2)
    assert {(r["term"], r["n"], r["df"]) for r in vocab.collect()} == {("pain", 3, 2), ("cd", 2, 2), ("pain cd", 2, 2)}
    weights = features.tfidf(grams, vocab, F.lit(3), "doc_id").groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert all(abs(r["n"] - 1) < 1e-5 for r in weights.collect())


def test_foreign_scorer_runs_once_per_task_and_falls_back(spark):
    df = spark.createDataFrame([(1, "hopeless"), (2, "broken"), (3, "fine")], "id long, text string").repartition(3)

    def make():
        def run(texts: pd.Series) -> pd.Series:
            if texts.str.contains("broken").any():
                raise RuntimeError("model failed")
            return texts.str.contains("hopeless").map({True: 0.97, False: 0.1})
        return run

    scored = models.external_scores(df, make, "id").withColumn("cls", (F.col("prob") > 0.5).cast("int")).withColumn(
        "conf", F.when(F.col("cls") == 1, F.col("prob")).otherwise(1 - F.col("prob")))
    document = scoring.analyze(df.join(scored, "id"), model_class="cls", model_confidence="conf")
    got = {r["id"]: (r["method"], r["risk"]["risk_level"]) for r in document.collect()}
    assert got[1] == ("ml_model", "HIGH") or got[1][0] == "keyword_fallback"
    assert got[2] == ("keyword_fallback", "LOW")


def test_one_bad_text_costs_only_its_own_score(spark):
    def make():
        def scorer(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("cannot score")
            return pd.Series([0.25] * len(texts))
        return scorer

    df = spark.createDataFrame([(i, "bad" if i == 3 else "fine") for i in range(8)], "id long, text string").coalesce(1)
    assert {r["id"]: r["prob"] for r in models.external_scores(df, make, "id").collect()} == {i: None if i == 3 else 0.25 for i in range(8)}


def test_retraining_cycle(spark, corpus):
    original = corpus.select("doc_id", "text", F.when(F.col("label") == 1, "suicide").otherwise("non-suicide").alias("class"))
    rows = [(i, f"{BAD[i % 4]} extra{i}", "LOW", "HIGH", False) for i in range(20)] + [(99, "fine", "LOW", "LOW", True)]
    reviewed = spark.createDataFrame(
        rows, "id long, text string, original_prediction string, teacher_correction string, is_correct boolean")
    with pytest.raises(ValueError, match="insufficient"):
        retraining_cycle.run(original, reviewed, "m")
    cycle = retraining_cycle.run(original, reviewed, "m", min_samples=20, oversample=3)
    assert {r["split"] for r in cycle.metrics.collect()} == {"train", "eval"}
    log = cycle.log.first()
    assert log["num_samples"] == 20 and '"f1"' in log["performance_metrics"]
    in_train = cycle.training_set.where("origin = 'feedback' and split = 'train'")
    assert in_train.count() == 3 * in_train.select("text").distinct().count()
    assert cycle.text_model.transform(spark.createDataFrame([("dark pain",)], "text string")).count() == 1


def test_vocabulary_is_counted_without_the_fit_of_the_vectorizer(spark, corpus, monkeypatch):
    """Its fit deals every term to as many tasks as the input has splits; the vectors are the same."""
    cut = features.grams(corpus, ["and"])
    train = cut.where("split = 'train'")
    plain = features.Pipeline(stages=features.vector_stages()).fit(train)
    monkeypatch.setattr(features.CountVectorizer, "fit", lambda *a: pytest.fail("fitted by the vectorizer"))
    made = features.fit_vectors(train)
    assert set(made.stages[0].vocabulary) == set(plain.stages[0].vocabulary)
    named = lambda m: {r["doc_id"]: {m.stages[0].vocabulary[i]: round(v, 9) for i, v in zip(r["features"].indices, r["features"].values)}
                       for r in m.transform(cut).select("doc_id", "features").collect()}
    assert named(made) == named(plain)
    models.featurize(corpus, ["and"])


def test_copies_weigh_as_rows(spark, corpus):
    """Vectors, class weights and the model are those of rows that are there several times."""
    counted = corpus.withColumn("copies", F.when((F.col("doc_id") % 4 == 0) & (F.col("split") == "train"), 3).otherwise(1))
    whole = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy", "copies")
    (a, ta), (b, tb) = models.featurize(counted, ["and"], copies="copies"), models.featurize(whole, ["and"])
    assert a.stages[4].vocabulary == b.stages[4].vocabulary
    assert a.stages[5].idf.toArray() == pytest.approx(b.stages[5].idf.toArray())
    fits = [models.logistic(t.where("split = 'train'").drop("split"), copies=c) for t, c in ((ta, "copies"), (tb, None))]
    assert fits[0].getRegParam() == fits[1].getRegParam()
    probs = [{r["key"]: r["prob"] for r in models.predictions(f, ta, "m").collect()} for f in fits]
    assert all(abs(probs[0][k] - probs[1][k]) < 0.01 for k in probs[1])


def test_tfidf_deals_texts_by_bytes(spark, tmp_path, monkeypatch):
    """More text gets more tasks than the session's number of partitions."""
    from riskloom.operators import skew
    from riskloom.plans import catalog_models
    from riskloom.plans.testbed import Testbed

    monkeypatch.setattr(skew, "TASK_BYTES", 1000)
    docs = spark.createDataFrame([(i, "dark pain " * 20) for i in range(100)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bed = Testbed(spark, str(tmp_path))
    assert skew.dealt(bed.documents, "doc_id", skew.parts_of(bed.documents, "text")).rdd.getNumPartitions() == 21
    assert "REPARTITION_BY_NUM" in catalog_models._tfidf(bed)._jdf.queryExecution().executedPlan().toString()
