"""Mixing sources to target weights by weighted sampling without replacement (exponential keys).

Every document gets the key ``-ln(u) / weight`` with u from a digest of its id: taking documents of a source in key order
is a weighted sample without replacement.  Sizes are summed up in that order until the source's word budget is spent.
A budget of at least the whole source is filled with complete epochs first; only the rest is sampled.

All of it is DataFrame work.  A source may hold any share of the rows: its order is cut into blocks of keys, block sums
give the running totals, and only the one block in which the budget ends is sorted.  What is left per source is one row,
``cuts``, stored and counted, so documents are matched to their source's cut without moving any text; beyond
``MOST_SOURCES`` sources documents and cuts are salted instead.

Edge cases: null or blank texts have size 0 and are never taken; null sources form one group, ranked last; a source of
size 0 has target 0; rows that repeat a ``doc_id`` in one source share a key and divide the cut by size; documents
without id share one key; an empty table gives an empty result.  Other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Blocks of equal probability into which a source's keys are cut.
KEY_BLOCKS = 4096
#: With at most this many sources their rows (about 100 bytes each) are broadcast; with more, documents are salted.
MOST_SOURCES = 100_000
SALTS = 64


def _with_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` as b joined to ``facts`` as c, stored rows with a source at most once; any source may hold any share of ``rows``."""
    if facts.count() <= MOST_SOURCES:
        return rows.alias("b").join(F.broadcast(facts).alias("c"), F.expr("b.source <=> c.source"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    copied = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.alias("b").join(copied.alias("c"), F.expr("b.source <=> c.source and b.salt = c.salt"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of ordinary word length and at least 20 words, a quarter otherwise."""
    chars = F.coalesce(F.length(text), F.lit(0))
    return F.when((size >= 20) & (chars >= 3 * size) & (chars <= 12 * size), 1.0).otherwise(0.25)


def key_of(doc_id: Column, weight: Column) -> Column:
    """The exponential key; u is odd / 2**53, so never 0 or 1."""
    digest = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((2 * digest + 1) / F.lit(float(1 << 53))) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Budgets follow the weights; a source that would get more than ``most`` times its size gets that, and the excess goes
    to the others by weight.  With sources in the order of size per weight the level is found by running sums.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    filled = (sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
              .withColumn("place", F.row_number().over(by_need))
              .withColumn("capped", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
              .withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("open")))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(Window.partitionBy())
    return filled.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def _base(docs: DataFrame) -> DataFrame:
    size = size_of(F.col("text"))
    return (docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
            .withColumn("size", size).withColumn("key", key_of(F.col("doc_id"), quality_weight(F.col("text"), F.col("size")))).drop("text"))


def cuts(base: DataFrame, **settings) -> DataFrame:
    """One row per source: its target, complete epochs, and where in key order the sampled part ends.

    ``base`` holds doc_id, source, size and key.  Documents before (cut_key, cut_id) are taken once more; the document
    there gives ``cut_words`` of its ``cut_size`` words.
    """
    block = F.least(F.floor(KEY_BLOCKS * (1 - F.exp(-F.col("key")))), F.lit(KEY_BLOCKS - 1)).cast("int")
    filled = base.where("size > 0").withColumn("block", block)
    sums = materialize(filled.groupBy("source", "block").agg(F.sum("size").alias("words")), "block-sums")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = (targets(sizes, **settings)
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    goal = materialize(goal, "targets")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")
    ends = (sums.withColumn("before", before).alias("s").join(goal.alias("g"), F.expr("s.source <=> g.source"))
            .where("g.rest > 0 and s.before < g.rest and g.rest <= s.before + s.words")
            .select("s.source", "s.block", "s.before", "g.rest"))
    last = (_with_source(filled, materialize(ends, "ends")).where("b.block = c.block")
            .groupBy("b.source", "b.key", "b.doc_id", "c.before", "c.rest").agg(F.sum("b.size").alias("cut_size")))
    order = Window.partitionBy("source").orderBy("key", "doc_id")
    last = (last.withColumn("so_far", F.col("before") + F.sum("cut_size").over(order) - F.col("cut_size"))
            .where("so_far < rest and rest <= so_far + cut_size")
            .select("source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), "cut_size", (F.col("rest") - F.col("so_far")).alias("cut_words")))
    whole = (goal.alias("g").join(last.alias("l"), F.expr("g.source <=> l.source"), "left")
             .select("g.source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words"))
    return materialize(whole, "cuts")


def _taken() -> Column:
    k, c = F.col("b.key"), F.col("c.cut_key")
    same_key = (k == c) & F.col("b.doc_id").eqNullSafe(F.col("c.cut_id"))
    earlier = (k < c) | ((k == c) & (F.coalesce(F.col("b.doc_id") < F.col("c.cut_id"), F.lit(False)) | (F.col("b.doc_id").isNull() & F.col("c.cut_id").isNotNull())))
    part = F.when(same_key, F.floor(F.col("c.cut_words") * F.col("b.size") / F.col("c.cut_size"))).when(earlier, F.col("b.size")).otherwise(0)
    return (F.col("c.epochs") * F.col("b.size") + part).cast("long")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Per document: ``size``, its source's ``source_size`` and ``target``, and ``taken``, words that the mix takes."""
    base = materialize(_base(docs), "mix")
    joined = _with_source(base, cuts(base, **settings))
    return joined.select("b.doc_id", "b.size", "c.source_size", "c.target", _taken().alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each row as often as its words are taken, whole texts, the cut document to the nearer.

    Texts are read twice and not shuffled unless there are more sources than can be broadcast.
    """
    found = cuts(materialize(_base(docs), "mix"), **settings)
    size = size_of(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text")).withColumn("size", size)
    rows = rows.withColumn("key", key_of(F.col("doc_id"), quality_weight(F.col("text"), F.col("size")))).drop("text")
    joined = _with_source(rows, found)
    copies = F.when(F.col("b.size") > 0, F.round(_taken() / F.col("b.size"))).otherwise(0).cast("int")
    return joined.select("b.row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("row.*")
