"""Explained analysis: the model's document with word highlights, triggers and problematic sentences.

The words of a text meet their weights once; what follows (sign, min-max, percentile, triggers, sentence means) is one
array program inside the row.  Texts are partitioned by key, once to be cut into words and once to meet the words' weights
again; only rows of distinct rare terms are shuffled, since the weights of frequent ones are broadcast.  Sentences are folded with the best few kept, so
the work is linear in the length of a text.  Keys have to be unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import lexicon as lx
from riskloom.functions import redaction
from riskloom.functions import text as tx
from riskloom.operators import attribution as at
from riskloom.operators import linear, scoring, skew

_BEST = "array<struct<lack:double,no:int>>"


def with_weighed_words(df: DataFrame, weights: DataFrame, key: str, column: str = "text", parts: int | None = None, head_terms: int | None = None) -> DataFrame:
    """Add ``_by_word``: ``(word, pos, weight_micro)`` of every word, sorted; null for a text without words."""
    texts, head = linear.placed(df, weights, key, column, head_terms, parts)
    cut = texts.select(F.col(key).alias("_k"), "_tail", F.posexplode_outer(tx.words(F.lower(column))).alias("pos", "word")).where(
        F.col("pos").isNotNull())
    weighed = linear.with_weight(cut, head, "word")
    rows = F.struct("word", "pos", "weight_micro")
    lists = weighed.groupBy("_k").agg(F.sort_array(F.collect_list(rows)).alias("_by_word"))
    return texts.drop("_tail").join(lists, F.col(key) == F.col("_k"), "left").drop("_k")


def distinct_sum(by_word: Column) -> Column:
    """Sum of the weights of distinct words; equal words stand together."""
    start = F.struct(F.lit(0).cast("long").alias("z"), F.lit("").alias("last"))
    total = F.aggregate(by_word, start, lambda acc, w: F.struct(
        (acc["z"] + F.when(w["word"] == acc["last"], F.lit(0)).otherwise(w["weight_micro"])).alias("z"), w["word"].alias("last")))
    return F.coalesce(total["z"], F.lit(0).cast("long"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def min_max(scores: Column) -> Column:
    """Scores of an array scaled to 0..1; all 1 when they are equal."""
    ends = lambda v: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    scaled = lambda s, e: F.when(e["high"] > e["low"], (s - e["low"]) / (e["high"] - e["low"])).otherwise(F.lit(1.0))
    return bound(scores, lambda v: bound(ends(v), lambda e: F.transform(v, lambda s: scaled(s, e))))


def interpolated(values: Column, share: float) -> Column:
    """Percentile of an array, linear between neighbours."""
    def at_place(v: Column) -> Column:
        place = F.lit(share) * (F.size(v) - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return a + (b - a) * (place - low)

    return bound(F.array_sort(values), at_place)


def best_sentences(counts: Column, normalized: Column, minimum: float = at.PROBLEM_SCORE, limit: int = at.TOP_SENTENCES) -> Column:
    """``(lack, no)`` of the best sentences, best first; ``lack`` is the negative mean score.

    Each sentence takes as many of the next words as it has itself.
    """
    owner = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i, n)))
    words = F.zip_with(normalized, owner, lambda s, o: F.struct(s.alias("score"), o.alias("no")))

    def closed(acc: Column) -> Column:
        mean = F.round(acc["total"] / acc["n"], 9)
        more = F.array_sort(F.concat(acc["best"], F.array(F.struct((-mean).alias("lack"), acc["no"].alias("no")))))
        return F.when((acc["n"] > 0) & (mean >= minimum), F.slice(more, 1, limit)).otherwise(acc["best"])

    def step(acc: Column, w: Column) -> Column:
        there = w["no"].isNotNull() & w["score"].isNotNull()
        same = w["no"] == acc["no"]
        return F.when(~there, acc).otherwise(F.struct(
            w["no"].alias("no"), (F.when(same, acc["total"]).otherwise(F.lit(0.0)) + w["score"]).alias("total"),
            (F.when(same, acc["n"]).otherwise(F.lit(0)) + 1).alias("n"),
            F.when(same, acc["best"]).otherwise(closed(acc)).alias("best")))

    start = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast(_BEST).alias("best"))
    return F.aggregate(words, start, step, closed)


def analyze_explained(df: DataFrame, weights: DataFrame, key: str = "doc_id", column: str = "text", head_terms: int | None = None) -> DataFrame:
    """The analysis document of every text by the linear model, with its explanation.

    ``risk`` has ``highlighted_words`` (text, normalized_score, is_important) and ``problematic_sentences`` (sentence,
    score) beside the fields of ``scoring.analyze``; both are null for a text without words.  Scores are towards the
    predicted class; triggers and sentences are given for the positive class only.
    """
    passed = [c for c in df.columns if c != column]
    clean = redaction.redact(df, column, "_clean").drop(column)
    weighed = with_weighed_words(clean, weights, key, "_clean", skew.parts_of(df, column), head_terms)
    intercept = linear.intercept_of(weights)
    scored = linear.with_probability(weighed.withColumn("_z", distinct_sum(F.col("_by_word")) + intercept), "_z")
    sign = F.when(F.col("pred") == 1, 1.0).otherwise(-1.0)
    ordered = F.array_sort(F.transform("_by_word", lambda w: F.struct(w["pos"], w["word"], (w["weight_micro"] / linear.MICRO).alias("s"))))
    scores = bound(sign, lambda d: F.transform("_words", lambda w: w["s"] * d))
    signed = scored.withColumn("_words", ordered).withColumn("_norm", min_max(scores))
    marked = signed.withColumn("_marked", bound(interpolated(F.col("_norm"), at.IMPORTANT_SHARE), lambda cut: F.zip_with(
        "_words", "_norm", lambda w, s: F.struct(w["word"].alias("text"), s.alias("normalized_score"), (s >= cut).alias("is_important")))))
    important = F.transform(F.filter("_marked", lambda w: w["is_important"]), lambda w: w["text"])
    empty = F.array().cast("array<string>")
    positive = F.col("pred") == 1
    told = marked.withColumn("_triggers", F.when(positive & F.col("_marked").isNotNull(), F.slice(important, 1, at.FIRST_TRIGGERS)).otherwise(empty))
    parts = told.withColumn("_parts", F.when(positive, tx.sentences(F.col("_clean"))))
    best = parts.withColumn("_best", F.when(positive, best_sentences(F.transform("_parts", tx.word_count), F.col("_norm"))))
    sentences = F.transform("_best", lambda b: F.struct(F.element_at(F.col("_parts"), b["no"] + 1).alias("sentence"), (-b["lack"]).alias("score")))
    none = F.array().cast("array<struct<sentence:string,score:double>>")
    risk = scoring.model_risk(F.col("pred"), F.col("confidence"), F.col("_triggers"))
    explained = F.struct(
        *[risk[c].alias(c) for c in scoring.RISK_FIELDS], F.col("_marked").alias("highlighted_words"),
        F.when(F.col("_marked").isNotNull(), F.coalesce(sentences, none)).alias("problematic_sentences"))
    return best.select(
        *passed, F.struct(F.col("email_count").alias("email"), F.col("phone_count").alias("phone")).alias("pii_redacted"),
        explained.alias("risk"), tx.excerpt(F.col("_clean")).alias("sanitized_excerpt"),
        F.lit("ml_model").alias("method"), F.lit("ml_model").alias("process_method"))
