"""Cleaning, label mapping and de-duplication of a labelled corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels, text

MIN_LENGTH = 10


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which any column (or any of ``columns``) is null."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def map_labels(df: DataFrame, label: str = "class", out: str = "label", mapping: dict[str, int] | None = None) -> DataFrame:
    """Label string to class id; rows with an unknown label are dropped."""
    mapped = df.withColumn(out, labels.class_of(F.col(label), mapping).cast("int"))
    return mapped.where(F.col(out).isNotNull())


def unmapped_labels(df: DataFrame, label: str = "class", mapping: dict[str, int] | None = None) -> DataFrame:
    """Labels that the map does not know, with row counts.  A null label counts as unknown."""
    return (
        df.where(labels.class_of(F.col(label), mapping).isNull())
        .groupBy(F.col(label)).agg(F.count("*").alias("n_rows"))
    )


def map_labels_strict(df: DataFrame, label: str = "class", out: str = "label", mapping: dict[str, int] | None = None) -> DataFrame:
    """Like ``map_labels`` but the job fails on the first unknown label, wherever it is read."""
    known = labels.class_of(F.col(label), mapping)
    message = F.concat(F.lit("unmapped label: "), F.coalesce(F.col(label), F.lit("null")))
    return df.withColumn(out, F.coalesce(known, F.raise_error(message).cast("int")))


def clean(df: DataFrame, columns: Sequence[str] = ("text", "class")) -> DataFrame:
    """Required columns only, complete rows only, known labels only."""
    return map_labels(drop_incomplete(require_columns(df, columns)))


def require_columns(df: DataFrame, columns: Sequence[str] = ("text", "class"), keep: Sequence[str] = ()) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"data must have columns {list(columns)}; missing {missing}")
    return df.select(*columns, *keep)


def longer_than(df: DataFrame, column: str = "text", size: int = MIN_LENGTH) -> DataFrame:
    return df.where(F.length(column) > size)


def length_filter_report(df: DataFrame, column: str = "text", size: int = MIN_LENGTH) -> DataFrame:
    kept = F.count_if(F.length(column) > size)
    return df.agg(
        F.count("*").alias("before_rows"), kept.alias("kept_rows"),
        (F.count("*") - kept).alias("removed_rows"),
    )


def non_blank(df: DataFrame, column: str = "text") -> DataFrame:
    """Trim the column and drop rows that are blank."""
    return df.withColumn(column, text.strip(F.col(column))).where(F.length(column) > 0)


def content_key(*columns: str) -> Column:
    """256-bit key of the row's content; nulls and column borders are kept apart."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def first_copies(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Keep one row per distinct ``column``: the one with the smallest ``key``.

    Only (digest, smallest key) is grouped, combined before the shuffle, so a
    text that is a third of the corpus costs one row per task.  The full rows
    move once, by their own unique key.
    """
    survivors = (
        df.select(F.col(key), F.sha2(F.col(column), 256).alias("_digest"))
        .groupBy("_digest").agg(F.min(key).alias(key)).select(key)
    )
    return df.join(survivors, key, "left_semi")


def duplicate_report(df: DataFrame, column: str = "text") -> DataFrame:
    groups = df.groupBy(F.sha2(F.col(column), 256).alias("_digest")).agg(F.count("*").alias("n"))
    total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return groups.agg(
        total.alias("before_rows"), kept.alias("after_rows"), (total - kept).alias("removed_rows"))


def quality_report(df: DataFrame, columns: Sequence[str], text_column: str = "text") -> DataFrame:
    """Nulls per column, and duplicate texts, in one row."""
    per_text = df.groupBy(F.sha2(F.col(text_column), 256).alias("_digest")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])
    zero = F.lit(0)
    return per_text.agg(
        F.coalesce(F.sum("n"), zero).alias("n_rows"),
        *[F.coalesce(F.sum(f"{c}_nulls"), zero).alias(f"{c}_nulls") for c in columns],
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_rows"),
    )


def pick_rows(df: DataFrame, indices: DataFrame, key: str, index: str = "row_id") -> DataFrame:
    """Rows whose key is in an index list."""
    return df.join(indices.select(F.col(index).alias(key)).distinct(), key, "left_semi")


def truncate(df: DataFrame, max_length: int = 256, column: str = "text") -> DataFrame:
    return df.withColumn(column, text.truncate_words(F.col(column), max_length))


def relabel(df: DataFrame, label: str = "class") -> DataFrame:
    """Write form of a cleaned corpus: the label string replaced by its class id."""
    return map_labels(df, label, "_label").withColumn(label, F.col("_label")).drop("_label")
