"""Word and sentence attribution over a ``(doc, pos, word, score)`` table.

Windows here are per document.  A document is one string value of at most 2 GB,
so a group is bounded by one cell of the text table whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators.ranking import prefix_sums

# Special tokens, continuation mark, cut-offs.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]")
CONTINUATION = "##"
IMPORTANT_SHARE = 0.75
PROBLEM_SCORE = 0.5
TOP_SENTENCES, FIRST_TRIGGERS, TOP_WORDS = 3, 10, 10


def merge_pieces(pieces: DataFrame, key: str = "doc_id", block: int | None = None) -> DataFrame:
    """Sub-word pieces to words: text joined, score the mean of the pieces.

    Columns in: ``key, pos, token, score``; out: ``key, pos, word, score``.
    ``block`` numbers the words in stretches of that many positions, so that the
    pieces of very long documents are spread over several tasks.
    """
    real = pieces.where(~F.col("token").isin(*SPECIAL_TOKENS)).withColumn(
        "_start", (~F.col("token").startswith(CONTINUATION)).cast("long"))
    blocks = [F.floor(F.col("pos") / block)] if block else []
    numbered = prefix_sums(real, [key], [F.col("pos")], ["_start"], blocks)
    part = F.when(F.col("_start") == 1, F.col("token")).otherwise(
        F.substring("token", len(CONTINUATION) + 1, 2**31 - 1))
    words = numbered.select(key, F.col("_start_upto").alias("word_id"), "pos", part.alias("part"), "score").groupBy(
        key, "word_id"
    ).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), ""
        ).alias("word"),
        F.min("pos").alias("pos"),
        F.avg("score").alias("score"),
    )
    return words.where(F.col("word") != "").select(key, "pos", "word", "score")


def normalize(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``normalized_score``: min-max per document, 1 when all scores are equal."""
    doc = Window.partitionBy(key)
    low, high = F.min("score").over(doc), F.max("score").over(doc)
    return words.withColumn("_low", low).withColumn("_high", high).withColumn(
        "normalized_score",
        F.when(F.col("_high") > F.col("_low"), (F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")))
        .otherwise(F.lit(1.0)),
    ).drop("_low", "_high")


def mark_important(normalized: DataFrame, key: str = "doc_id", share: float = IMPORTANT_SHARE) -> DataFrame:
    """Add ``is_important``: at or above the document's interpolated percentile."""
    threshold = F.percentile("normalized_score", F.lit(share)).over(Window.partitionBy(key))
    return normalized.withColumn("_cut", threshold).withColumn(
        "is_important", F.col("normalized_score") >= F.col("_cut")).drop("_cut")


def trigger_words(marked: DataFrame, key: str = "doc_id", limit: int = FIRST_TRIGGERS) -> DataFrame:
    """The first ``limit`` important words in text order, positive class only."""
    order = Window.partitionBy(key).orderBy("pos")
    chosen = marked.where(F.col("is_important") & (F.col("pred") == 1))
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_words(normalized: DataFrame, key: str = "doc_id", limit: int = TOP_WORDS) -> DataFrame:
    """The ``limit`` highest words per document, earlier word first on ties."""
    order = Window.partitionBy(key).orderBy(F.desc("normalized_score"), "pos")
    return normalized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def sentence_rows(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, sentence_no, sentence, n_words`` in text order."""
    return df.select(key, F.posexplode(tx.sentences(F.col(column))).alias("sentence_no", "sentence")).withColumn(
        "n_words", tx.word_count(F.col("sentence")))


def sentence_scores(
    docs: DataFrame, words: DataFrame, key: str = "doc_id", column: str = "text"
) -> DataFrame:
    """Mean normalised score per sentence of positive documents.

    ``docs`` has ``key``, the text and ``pred``.  Each sentence takes as many of
    the document's next words as it has itself; a sentence past the last word
    scores 0.  Words and sentences meet on (document, position), so a long
    document is spread like any other rows.
    """
    positive = docs.where(F.col("pred") == 1)
    sentences = sentence_rows(positive, key, column)
    before = Window.partitionBy(key).orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = sentences.withColumn("_from", F.coalesce(F.sum("n_words").over(before), F.lit(0)).cast("int"))
    slots = placed.where(F.col("n_words") > 0).select(
        key, "sentence_no",
        F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("n_words") - 1)).alias("pos"))
    means = (
        slots.join(words.select(key, "pos", "normalized_score"), [key, "pos"])
        .groupBy(key, "sentence_no")
        .agg(F.round(F.avg("normalized_score"), 9).alias("score"))
    )
    return sentences.join(means, [key, "sentence_no"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0)))


def sentence_means(words: DataFrame, key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``key, sentence_no, score`` from normalised words that know their sentence.

    ``with_text`` adds ``sentences``: the text of the sentence as its first word has it, once for each row of the document.
    """
    told = [F.collect_list("sentence").alias("sentences")] if with_text else []
    return words.where(F.col("sentence_no").isNotNull()).groupBy(key, "sentence_no").agg(
        F.round(F.avg("normalized_score"), 9).alias("score"), *told)


def with_sentence_text(scores: DataFrame, docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Add the sentence's text; meant for the few sentences that were chosen, where words do not carry it."""
    return scores.join(docs.select(key, column), key).withColumn(
        "sentence", F.element_at(tx.sentences(F.col(column)), F.col("sentence_no") + 1)).drop(column)


def problematic_sentences(
    scores: DataFrame, key: str = "doc_id", minimum: float = PROBLEM_SCORE, limit: int = TOP_SENTENCES
) -> DataFrame:
    """The ``limit`` best sentences per document that reach ``minimum``."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "sentence_no")
    return (
        scores.where(F.col("score") >= minimum)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    )
