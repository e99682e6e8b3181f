"""A relational linear text scorer: smoothed log-odds weight per term.

The score of a text is the intercept plus the weights of its distinct terms, its
probability the sigmoid of that.  The intercept is stored as the weight of the
empty term and added once to each sum, so no key of the join with the weights
stands for every text.  Weights are kept in whole millionths so that sums do
not depend on the order in which Spark adds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text as tx
from riskloom.operators import scoring, skew

MICRO = 1_000_000.0


def term_rows(df: DataFrame, key: str, column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct lower-case white-space terms per row.

    A text without terms has one that no vocabulary holds: a space and the row's
    own key, so that such texts keep a row and share no join key.
    """
    own = F.concat(F.lit(" "), F.coalesce(F.col(key).cast("string"), F.lit("")))
    # the outer form keeps Spark from testing the array's size, and so building it once more
    rows = df.select(key, *carry, F.explode_outer(F.array_distinct(tx.words(F.lower(column)))).alias("term"))
    return rows.withColumn("term", F.coalesce("term", own))


def fit_weights(labelled: DataFrame, key: str, label: str = "label", column: str = "text") -> DataFrame:
    """``term, pos_df, neg_df, weight_micro`` from a labelled corpus.

    Counts are smoothed towards the base rate, so a term that no class has seen
    often weighs next to nothing.  The row of the empty term is the intercept,
    the log odds of the classes; without one of the classes it is 0.
    """
    totals = labelled.agg(F.struct(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))).scalar()
    pos, neg = totals["pos"], totals["neg"]
    counts = term_rows(labelled, key, column, (label,)).where(~F.startswith("term", F.lit(" "))).groupBy("term").agg(
        F.count_if(F.col(label) == 1).alias("pos_df"), F.count_if(F.col(label) == 0).alias("neg_df"))
    base = labelled.sparkSession.range(1).select(F.lit("").alias("term"), pos.alias("pos_df"), neg.alias("neg_df"))
    counts = counts.unionByName(base)
    rate = pos / (pos + neg)
    odds = F.ln((F.col("pos_df") + rate) / (pos + 1)) - F.ln((F.col("neg_df") + (F.lit(1.0) - rate)) / (neg + 1))
    intercept = F.when((pos > 0) & (neg > 0), F.ln(pos / neg)).otherwise(0.0)
    weight = F.when(F.col("term") == "", intercept).otherwise(F.coalesce(odds, F.lit(0.0)))
    return counts.withColumn("weight_micro", F.round(weight * MICRO).cast("long"))


#: Terms of the weights that are broadcast at most; they are the most frequent ones.
HEAD_TERMS = 1 << 17


def head_and_tail(weights: DataFrame, head_terms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Weights ``term, weight_micro`` cut in two: at most ``head_terms`` of the most frequent terms, and the rest or None.

    The cut is a document frequency, found from counts per stretch of frequencies, so only these counts leave the tasks.
    """
    limit = HEAD_TERMS if head_terms is None else head_terms
    known = {"pos_df", "neg_df"} <= set(weights.columns)
    seen = F.floor(16 * F.log2(F.col("pos_df") + F.col("neg_df") + 1)) if known else F.lit(0).cast("long")
    terms = weights.where(F.col("term") != "").select("term", "weight_micro", seen.alias("_seen"))
    cut, total, whole = None, 0, True
    for r in sorted(terms.groupBy("_seen").count().collect(), key=lambda r: -(r["_seen"] or 0)):
        total += r["count"]
        if total > limit:
            whole = False
            break
        cut = r["_seen"]
    if whole:
        return terms.drop("_seen"), None
    low = F.lit(False) if cut is None else F.col("_seen") >= cut
    return terms.where(low).drop("_seen"), terms.where(~low).drop("_seen")


def tail_terms(df: DataFrame, head: DataFrame, tail: DataFrame, key: str, column: str) -> DataFrame:
    """``key, term, weight_micro`` of each row's distinct terms that are in the tail: few, so they alone are shuffled."""
    rare = term_rows(df, key, column).join(F.broadcast(head.select("term")), "term", "left_anti")
    return rare.join(tail, "term").select(key, "term", "weight_micro")


def placed(
    df: DataFrame, weights: DataFrame, key: str, column: str = "text", head_terms: int | None = None, parts: int | None = None,
    classes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Texts dealt by ``key``, each with ``_tail``, the weights of its rare terms as a map, and the weights of the others.

    Rare terms meet their weights as rows of distinct terms and travel to the texts, which are shuffled once; rows with
    equal keys, null too, share one map.

    ``classes`` has one row ``key, pred`` for each text that is wanted.  It travels with the rare terms, so that neither
    texts nor their word rows are joined: ``pred`` is added, and texts without one, or without a key, are left out.
    """
    head, tail = head_and_tail(weights, head_terms)
    parts = parts or skew.parts_of(df, column)
    own = T.MapType(T.StringType(), T.LongType())
    if tail is None and classes is None:
        return skew.dealt(df, key, parts).withColumn("_tail", F.lit(None).cast(own)), head
    entry = "struct<term:string,weight_micro:bigint>"
    both = df.withColumn("_rare", F.lit(None).cast(entry)).withColumn("_text", F.lit(True))
    if tail is not None:
        rare = tail_terms(df, head, tail, key, column).select(
            key, F.struct(F.col("term"), F.col("weight_micro").cast("long").alias("weight_micro")).alias("_rare"))
        both = both.unionByName(rare, allowMissingColumns=True)
    if classes is not None:
        both = both.unionByName(classes.select(key, "pred"), allowMissingColumns=True).where(F.col(key).isNotNull())
    group = Window.partitionBy(key)
    found = skew.dealt(both, key, parts).withColumn("_tail", F.collect_set("_rare").over(group))
    if classes is not None:
        found = found.withColumn("pred", F.max("pred").over(group)).where(F.col("pred").isNotNull())
    return found.where("_text").withColumn("_tail", F.map_from_entries("_tail")).drop("_rare", "_text"), head


def with_weight(rows: DataFrame, head: DataFrame, term: str) -> DataFrame:
    """Word rows of ``placed`` texts with ``weight_micro``, 0 where the term has none; no row is shuffled."""
    known = head.select(F.col("term").alias(term), F.col("weight_micro").alias("_head"))
    joined = rows.join(F.broadcast(known), term, "left")
    return joined.withColumn("weight_micro", F.coalesce("_head", F.col("_tail")[F.col(term)], F.lit(0).cast("long"))).drop("_head", "_tail")


def intercept_of(weights: DataFrame) -> Column:
    """The weight of the empty term, as a scalar; 0 where there is none."""
    return F.coalesce(weights.where(F.col("term") == "").agg(F.max("weight_micro")).scalar(), F.lit(0))


def score(df: DataFrame, weights: DataFrame, key: str, column: str = "text", head_terms: int | None = None) -> DataFrame:
    """``key, z_micro, prob, pred, confidence`` for every row of ``df``; nothing is rounded.

    Frequent terms meet their weights in place and leave one sum per text; rows of rare terms alone are shuffled.
    """
    head, tail = head_and_tail(weights, head_terms)
    found = term_rows(df, key, column).join(F.broadcast(head), "term", "left").select(key, "weight_micro")
    if tail is not None:
        found = found.unionByName(tail_terms(df, head, tail, key, column).select(key, "weight_micro"))
    summed = found.groupBy(key).agg(F.sum(F.coalesce("weight_micro", F.lit(0))).alias("_z"))
    whole = summed.select(key, (F.col("_z") + intercept_of(weights)).alias("z_micro"))
    return with_probability(whole)


def with_probability(df: DataFrame, z_micro: str = "z_micro") -> DataFrame:
    prob = scoring.sigmoid(F.col(z_micro) / MICRO)
    pred = (F.col(z_micro) > 0).cast("int")
    return (
        df.withColumn("prob", prob).withColumn("pred", pred)
        .withColumn("confidence", F.when(F.col("pred") == 1, F.col("prob")).otherwise(F.lit(1.0) - F.col("prob")))
    )


def word_scores(
    df: DataFrame, weights: DataFrame, key: str, column: str = "text", sentences: bool = False,
    head_terms: int | None = None, classes: DataFrame | None = None,
) -> DataFrame:
    """``key, pos, word, score``: every white-space word in order with its weight.

    With a zero baseline this weight times presence is the integrated gradient
    of the score with respect to the word.  What follows usually works per
    document, so the texts are partitioned by ``key`` before they are cut into
    words: text is several times smaller than its word rows, and neither the
    weights nor later windows and groupings by ``key`` need a further shuffle.

    ``sentences`` adds ``sentence_no``: the sentence that the running word cursor
    has reached, null past the last one; worked out inside the row.  The first word
    of a sentence has its text as ``sentence``, so texts need not be read again.

    ``classes``, one row ``key, pred`` per text, keeps these texts and adds ``pred``.
    """
    texts, head = placed(df, weights, key, column, head_terms, classes=classes)
    words = tx.words(F.lower(column))
    passed = [key, "_tail", *(["pred"] if classes is not None else [])]
    if sentences:
        owner = F.flatten(F.transform(tx.sentences(F.col(column)), lambda s, i: F.transform(
            F.array_repeat(i, tx.word_count(s)), lambda no, k: F.struct(no.alias("no"), F.when(k == 0, s).alias("text")))))
        rows = texts.select(*passed, F.posexplode_outer(F.arrays_zip(words.alias("w"), owner.alias("s"))).alias("pos", "_z")).where(
            F.col("_z.w").isNotNull()).select(
            *passed, "pos", F.col("_z.w").alias("word"), F.col("_z.s.no").alias("sentence_no"), F.col("_z.s.text").alias("sentence"))
    else:
        rows = texts.select(*passed, F.posexplode_outer(words).alias("pos", "word")).where(F.col("pos").isNotNull())
    joined = with_weight(rows, head, "word")
    kept = [c for c in rows.columns if c not in (key, "pos", "word", "_tail")]
    return joined.select(key, "pos", "word", (F.col("weight_micro") / MICRO).alias("score"), *kept)


def signed_for_class(score_column: Column, pred: Column) -> Column:
    """Attribution towards the predicted class: the sign flips for class 0."""
    return F.when(pred == 1, score_column).otherwise(-score_column)
