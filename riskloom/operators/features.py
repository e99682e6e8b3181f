"""Text features: tokens, vocabulary and TF-IDF, as ML stages and as a relational twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Vectoriser settings.
TOKEN = r"[\p{L}\p{N}_]{2,}"
VOCABULARY, MIN_DF, MAX_DF = 10_000, 2, 0.95


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def gram_stages(stop_words: Sequence[str], column: str = "text") -> list:
    """Lower-case tokens of two or more word characters without stop words, then their pairs."""
    return [
        RegexTokenizer(inputCol=column, outputCol="tokens", pattern=TOKEN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=list(stop_words)),
        NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS grams FROM __THIS__"),
    ]


def grams(df: DataFrame, stop_words: Sequence[str], column: str = "text") -> DataFrame:
    """Add ``grams``: single tokens followed by pairs."""
    out = df
    for stage in gram_stages(stop_words, column):
        out = stage.transform(out)
    return out.drop("tokens", "kept", "pairs")


def vocabulary(
    with_grams: DataFrame, n_docs, size: int = VOCABULARY, min_df: int = MIN_DF, max_df: float = MAX_DF,
    column: str = "grams", copies: str | None = None,
) -> DataFrame:
    """The ``size`` most frequent terms within the document-frequency limits; ``term, n, df``.

    A row counts as often as ``copies`` says.

    A document's grams are exploded twice, all of them and the distinct ones, and
    both counts come from one grouping by term, combined on the map side;
    (document, term) pairs are not shuffled.
    """
    times = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    both = with_grams.select(times.alias("times"), F.inline(F.array(
        F.struct(F.lit(False).alias("once"), F.col(column).alias("g")),
        F.struct(F.lit(True).alias("once"), F.array_distinct(column).alias("g")))))
    per_term = both.select("times", "once", F.explode("g").alias("term")).groupBy("term").agg(
        F.sum(F.when(F.col("once"), 0).otherwise(F.col("times"))).alias("n"),
        F.sum(F.when(F.col("once"), F.col("times")).otherwise(0)).alias("df"))
    return (
        per_term.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_df))
        .orderBy(F.desc("n"), "term").limit(size)
    )


def tfidf(with_grams: DataFrame, vocab: DataFrame, n_docs, key: str, column: str = "grams") -> DataFrame:
    """``key, term, tf, weight``: tf * (ln((1+n)/(1+df)) + 1), scaled to unit length per document.

    Terms outside the vocabulary are dropped inside the scan task, by a broadcast
    of at most ``VOCABULARY`` rows.
    """
    # the outer form keeps Spark from testing the array's size, and so building it again, below the shuffle
    terms = with_grams.select(key, F.explode_outer(column).alias("term")).where(F.col("term").isNotNull())
    known = terms.join(
        F.broadcast(vocab.select("term", "df")), "term")
    counts = known.groupBy(key, "term", "df").agg(F.count("*").alias("tf"))
    raw = counts.select(
        key, "term", "tf", (F.col("tf") * (F.ln((n_docs + 1) / (F.col("df") + 1)) + 1.0)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", F.round(F.col("raw") / norm, 6).alias("weight"))


def vector_stages(size: int = VOCABULARY, min_df: float = MIN_DF, max_df: float = MAX_DF) -> list:
    """From ``grams`` to the unit-length TF-IDF vector ``features``."""
    return [
        CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=size, minDF=min_df, maxDF=max_df),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features", p=2.0),
    ]


def fit_vectors(
    train: DataFrame, size: int = VOCABULARY, min_df: float = MIN_DF, max_df: float = MAX_DF, copies: str | None = None,
) -> PipelineModel:
    """``vector_stages`` fitted on ``grams``, the vocabulary by ``vocabulary``; a row counts as often as ``copies`` says.

    ``CountVectorizer.fit`` keeps the cut texts in memory and deals all terms to as many tasks as the input has splits;
    here only counts combined in the tasks are shuffled, into as many partitions as they need.
    """
    n_docs = train.agg(F.sum(copies) if copies else F.count("*")).first()[0] or 0
    terms = [r["term"] for r in vocabulary(train, F.lit(n_docs), size, min_df, max_df, copies=copies).select("term").collect()]
    if not terms:
        raise ValueError("no term is within the document-frequency limits")
    count, idf, norm = vector_stages(size, min_df, max_df)
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol=count.getInputCol(), outputCol=count.getOutputCol())
    counted = counter.transform(train)
    if copies:
        counted = counted.select(count.getOutputCol(), F.explode(F.sequence(F.lit(1), F.col(copies))).alias("_copy"))
    return PipelineModel([counter, idf.fit(counted), norm])


def pipeline(stop_words: Sequence[str], size: int = VOCABULARY, min_df: float = MIN_DF, max_df: float = MAX_DF) -> Pipeline:
    """All stages from ``text`` to ``features``."""
    return Pipeline(stages=gram_stages(stop_words) + vector_stages(size, min_df, max_df))
