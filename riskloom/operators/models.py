"""Linear classifiers on TF-IDF features: training, selection, stacking, foreign scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import evaluation, features, profile
from riskloom.operators.ranking import seeded_hash
from riskloom.session import materialize


def featurize(corpus: DataFrame, stop_words: Sequence[str], split: str = "split", copies: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit the feature stages on the train part only; features of every part, stored once.

    Texts are cut into grams once and stored, since fitting and transforming read
    them several times.  The returned model holds all stages and takes raw texts.
    A row of the train part counts as often as its column ``copies`` says.
    """
    keep = [c for c in corpus.columns if c != "text"]
    cut = materialize(features.grams(corpus, stop_words).select(*keep, "grams"), "grams")
    fitted = features.fit_vectors(cut.where(F.col(split) == "train"), copies=copies)
    stored = materialize(fitted.transform(cut).select(*keep, "features"), "features")
    return PipelineModel(features.gram_stages(stop_words) + fitted.stages), stored


TOLERANCE, MAX_ITER = 1e-4, 1000


def logistic(train: DataFrame, label: str = "label", max_iter: int = MAX_ITER, c: float = 1.0, balanced: bool = True, copies: str | None = None):
    """Logistic regression, with balanced class weights unless told otherwise; L2 penalty of ``1/(c * rows)``.

    Every iteration is a Spark job, so the tolerance decides the cost; ``max_iter`` is only a cap.
    A row with ``copies`` weighs as that many rows, without being read as often in every iteration.
    """
    n_rows = train.agg(F.sum(copies)).first()[0] or 0 if copies else train.count()
    penalty = 1.0 / max(1.0, c * n_rows)
    if not balanced:
        weighted = train.withColumn("weight", F.col(copies).cast("double")) if copies else train
        return _regression(penalty, max_iter, label, "weight" if copies else None).fit(weighted)
    return _regression(penalty, max_iter, label).fit(profile.with_class_weights(train, label, copies=copies))


def svm(train: DataFrame, label: str = "label", max_iter: int = MAX_ITER, c: float = 1.0):
    weighted = profile.with_class_weights(train, label)
    return LinearSVC(
        featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, tol=TOLERANCE,
        regParam=1.0 / max(1.0, c * train.count()), standardization=False,
    ).fit(weighted)


def save(text_model: PipelineModel, classifier, path: str) -> None:
    """One artefact that takes raw texts: the text stages and the classifier."""
    PipelineModel([*text_model.stages, classifier]).write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predictions(model, rows: DataFrame, name: str, key: str = "doc_id", label: str = "label") -> DataFrame:
    """``model, key, pred, prob, truth`` and the other columns of ``rows``; prob only where the model has one."""
    scored = model.transform(rows)
    prob = vector_to_array("probability")[1] if "probability" in scored.columns else F.lit(None).cast("double")
    extra = [c for c in rows.columns if c not in (key, label, "features")]
    return scored.select(
        F.lit(name).alias("model"), F.col(key).alias("key"), F.col("prediction").cast("int").alias("pred"),
        prob.alias("prob"), F.col(label).cast("int").alias("truth"), *extra)


def by_split(scored: DataFrame) -> DataFrame:
    return evaluation.evaluate(scored, ["model", "split"])


#: Iterations of the rounds of a search; the last is the cap of ``logistic`` itself.
ROUNDS = (10, 30, 100, MAX_ITER)
FOLDS = 5


def fold_of(key: str, seed: int = 42, folds: int = FOLDS) -> Column:
    """A row's fold, from the digest of its key alone: the same whatever the partitions."""
    return F.pmod(F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def select_by_f1(
    train: DataFrame, penalties: Sequence[float], label: str = "label", seed: int = 42, key: str = "doc_id", parallelism: int = 4,
) -> tuple[object, list[tuple[float, float, int]]]:
    """Best of several penalties by F1 of the positive class on a held-out fold, by successive halving.

    Every penalty is fitted with few iterations on the other folds; the better half goes on with more, the last round
    has the iterations and tolerance of ``logistic``.  Class weights come from the fitted rows.  The winner is fitted
    once more on all of ``train``.  Returns it and ``(penalty, F1, iterations)`` of each penalty's last round.
    """
    placed = materialize(train.withColumn("_fold", fold_of(key, seed)), "folds")
    fit, held = placed.where("_fold <> 0").drop("_fold"), placed.where("_fold = 0").drop("_fold")
    weighted = profile.with_class_weights(fit, label)

    def tried(penalty: float, iterations: int) -> tuple[float, float, int]:
        scored = predictions(_regression(penalty, iterations, label).fit(weighted), held, "tried", key, label)
        f1 = evaluation.evaluate(scored).first()
        return penalty, (f1["f1"] if f1 else 0.0), iterations

    left, results = sorted(penalties), {}
    with ThreadPoolExecutor(parallelism) as pool:
        for iterations in ROUNDS:
            found = sorted(pool.map(lambda p: tried(p, iterations), left), key=lambda r: (-r[1], r[0]))
            results |= {r[0]: r for r in found}
            left = [r[0] for r in found[:(len(found) + 1) // 2]]
    best = _regression(left[0], MAX_ITER, label).fit(profile.with_class_weights(train, label))
    return best, [results[p] for p in sorted(penalties)]


def _regression(penalty: float, iterations: int, label: str, weight: str | None = "weight") -> LogisticRegression:
    made = LogisticRegression(featuresCol="features", labelCol=label, maxIter=iterations, tol=TOLERANCE, regParam=penalty, elasticNetParam=0.0, standardization=False)
    return made.setWeightCol(weight) if weight else made


def random_penalties(count: int, seed: int = 42, low: float = 1e-5, high: float = 1e-1) -> list[float]:
    """Log-uniform draws for a random search."""
    import random

    draw = random.Random(seed)
    return sorted(low * (high / low) ** draw.random() for _ in range(count))


def stack(wide: DataFrame, probs: Sequence[str], label: str = "truth", key: str = "key", fold: str = "fold"):
    """Logistic meta-model over base probabilities: fitted on each half, applied to the other.

    ``fold`` is 0 or 1.  Every row is scored by the model that has not seen it.
    """
    assembled = VectorAssembler(inputCols=list(probs), outputCol="features").transform(wide)
    scored = []
    for held_out in (0, 1):
        meta = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=MAX_ITER).fit(
            assembled.where(F.col(fold) != held_out))
        scored.append(meta.transform(assembled.where(F.col(fold) == held_out)).select(
            key, F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("prob"),
            F.col(label).cast("int").alias("truth")))
    return scored[0].unionByName(scored[1]).withColumn("model", F.lit("stacked"))


def _score_one(scorer: Callable[[pd.Series], pd.Series], text: str | None) -> float | None:
    try:
        return float(pd.Series(scorer(pd.Series([text]))).iloc[0])
    except Exception:  # noqa: BLE001 - a text that fails falls back to keywords
        return None


def external_scores(
    df: DataFrame, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]], key: str, column: str = "text",
    key_type: str = "long",
) -> DataFrame:
    """Probabilities from a model that is not Spark's: ``key, prob``, null where scoring failed.

    A batch that the model refuses is scored text by text, so one bad text costs only its own score.

    ``make_scorer`` runs once per task and returns a function from a batch of
    texts to probabilities.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            try:
                prob = scorer(batch[column])
            except Exception:  # noqa: BLE001 - whatever a foreign model raises
                prob = pd.Series([_score_one(scorer, text) for text in batch[column]], dtype="float64")
            yield pd.DataFrame({key: batch[key].values, "prob": pd.Series(prob).values})

    return df.select(key, column).mapInPandas(run, f"{key} {key_type}, prob double")
