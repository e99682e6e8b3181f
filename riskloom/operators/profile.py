"""Corpus profile: counts, balance, class weights and length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import rates, text


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (classes * n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    whole = counts.agg(F.struct(F.sum("n_rows").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select(label, "n_rows", (whole["n"] / (whole["k"] * F.col("n_rows"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight", copies: str | None = None) -> DataFrame:
    """Weight column for a binary training set; the counts are one scalar subquery.

    A row counts, and weighs, as often as ``copies`` says.
    """
    times = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    of = lambda mask: F.coalesce(F.sum(F.when(mask, times)), F.lit(0))
    counts = df.agg(F.struct(
        of(F.lit(True)).alias("n"), of(F.col(label) == 1).alias("pos"), of(F.col(label) == 0).alias("neg"),
    )).scalar()
    mine = F.when(F.col(label) == 1, counts["pos"]).otherwise(counts["neg"])
    classes = (counts["pos"] > 0).cast("int") + (counts["neg"] > 0).cast("int")
    weight = counts["n"] / (classes * mine)
    return df.withColumn(out, weight * times if copies else weight)


def imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    """Negative to positive ratio and whether it calls for class weights."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    counted = df.agg(neg.alias("n_negative"), pos.alias("n_positive"))
    value = rates.ratio(F.col("n_negative"), F.col("n_positive"))
    return counted.select(
        "n_negative", "n_positive", value.alias("imbalance_ratio"),
        ((value > 2.0) | (value < 0.5)).alias("use_class_weights"),
    )


def _length_aggregates(words, exact: bool):
    middle = F.percentile("n_words", F.lit(0.5)) if exact else F.percentile_approx("n_words", 0.5, 10_000)
    return [
        F.count("*").alias("n_rows"),
        F.sum(words).alias("_sum"),
        middle.cast("double").alias("median_words"),
        F.min(words).cast("long").alias("min_words"),
        F.max(words).cast("long").alias("max_words"),
        F.count_if(words <= 128).alias("_le128"),
        F.count_if(words <= 256).alias("_le256"),
    ]


def _finish(*keys: str):
    n = F.col("n_rows")
    return [
        *keys, n,
        rates.ratio(F.col("_sum"), n).alias("mean_words"), "median_words", "min_words", "max_words",
        rates.percent(F.col("_le128"), n).alias("pct_le_128"),
        rates.percent(F.col("_le256"), n).alias("pct_le_256"),
    ]


def corpus_profile(df: DataFrame, label: str = "class", exact: bool = True) -> DataFrame:
    """Whole-corpus row: totals, class counts, word-count statistics.

    The exact median keeps one counter per distinct word count, not per row.
    """
    counted = df.select(label, text.word_count(F.col("text")).alias("n_words"))
    row = counted.agg(
        *_length_aggregates(F.col("n_words"), exact),
        F.count_if(F.col(label).isNotNull() & F.col("n_words").isNotNull()).alias("clean_rows"),
        F.count_if(F.col(label) == "suicide").alias("n_suicide"),
        F.count_if(F.col(label) == "non-suicide").alias("n_non_suicide"),
    )
    return row.select(*_finish(), "clean_rows", "n_suicide", "n_non_suicide")


def length_by_class(df: DataFrame, label: str = "class", exact: bool = True) -> DataFrame:
    counted = df.select(label, text.word_count(F.col("text")).alias("n_words"))
    return counted.groupBy(label).agg(*_length_aggregates(F.col("n_words"), exact)).select(*_finish(label))
