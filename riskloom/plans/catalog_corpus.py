"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import lexicon as lx
from riskloom.functions import text as tx
from riskloom.functions import web
from riskloom.operators import corpus, feedback, profile, splits
from riskloom.plans.catalog import Catalog
from riskloom.plans.catalog_evaluation import split_sql
from riskloom.plans.oracle_views import pct, ratio, strip, word_count, words
from riskloom.plans.testbed import AGENTS, Testbed
from riskloom.session import scratch_path
from riskloom.sources import memberships

LABEL_SQL = "CASE class WHEN 'non-suicide' THEN 0 WHEN 'suicide' THEN 1 END"

HASH_SQL = "CAST(('0x' || substring(md5('42|' || doc_id), 1, 8)) AS BIGINT)"

TRAINING_SQL = """
    SELECT text, class FROM (SELECT text, class FROM dirty_corpus
      UNION ALL SELECT text, CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 'suicide' ELSE 'non-suicide' END
      FROM feedback, range(1, 6) WHERE NOT is_correct)
    WHERE text IS NOT NULL AND class IS NOT NULL"""

PROFILE_SQL = f"""count(*) AS n_rows, {ratio('sum(n_words)', 'count(*)')} AS mean_words, median(n_words) AS median_words,
    CAST(min(n_words) AS BIGINT) AS min_words, CAST(max(n_words) AS BIGINT) AS max_words,
    {pct('count(*) FILTER (WHERE n_words <= 128)', 'count(*)')} AS pct_le_128,
    {pct('count(*) FILTER (WHERE n_words <= 256)', 'count(*)')} AS pct_le_256"""


def _labelled(bed: Testbed) -> DataFrame:
    return corpus.map_labels(bed.corpus_classes)


def _split(parts):
    return lambda bed: splits.stratified_split(bed.corpus_classes, "doc_id", parts=parts)


def _picked(bed: Testbed) -> DataFrame:
    """Rows of the test part, picked through its index list."""
    index = _split(splits.SPLIT_80_10_10)(bed).where(F.col("split") == "test").select(F.col("doc_id").alias("row_id"))
    return corpus.pick_rows(bed.documents, index, "doc_id")


def _memberships(bed: Testbed) -> DataFrame:
    """The 80/10/10 split, written as bitmaps and read back."""
    path = scratch_path(bed.spark, "memberships")
    memberships.write_memberships(_split(splits.SPLIT_80_10_10)(bed), path, row_id="doc_id")
    return memberships.read_bitmaps(bed.spark, path)


def _picked_by_bitmap(bed: Testbed) -> DataFrame:
    return memberships.pick(bed.documents, _memberships(bed), "test", "doc_id")


def _first_copies(bed: Testbed) -> DataFrame:
    return corpus.first_copies(bed.documents, "doc_id").select("doc_id")


def _positions(bed: Testbed) -> DataFrame:
    from riskloom.sources.readers import parquet_positions

    return parquet_positions(bed.table("documents")).select("doc_id", "row_id")


def _untrimmed(bed: Testbed) -> DataFrame:
    """Documents with white space added, some of them blank."""
    k = F.col("doc_id")
    return bed.documents.select(
        "doc_id", F.when(k % 31 == 0, F.lit(" \t\n ")).otherwise(F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))).alias("text"))


def _corrections(bed: Testbed) -> DataFrame:
    return bed.feedback.where(~F.col("is_correct")).select(
        "text", lx.binary_label(F.col("teacher_correction")).alias("class"))


def _combined(bed: Testbed) -> DataFrame:
    return splits.combine(bed.dirty_corpus, _corrections(bed), 5)


def _gate(bed: Testbed) -> DataFrame:
    """Readiness of the corrections that the retraining job would read."""
    return bed.reviews.agg(F.count_if(F.col("feedback_type") == "correction").alias("n_samples")).select(
        "n_samples", (F.col("n_samples") >= feedback.MIN_CORRECTIONS).alias("enough"))


def _previews(bed: Testbed) -> DataFrame:
    agent = F.repeat(F.coalesce("user_agent", F.lit("")), 6)
    return bed.requests.select("id", F.substring(agent, 1, web.USER_AGENT_LIMIT).alias("user_agent"))


def register(c: Catalog) -> None:
    c.add("c01_drop_incomplete", lambda b: corpus.drop_incomplete(b.dirty_corpus),
          "SELECT doc_id, text, class FROM dirty_corpus WHERE text IS NOT NULL AND class IS NOT NULL")
    c.add("c02_map_labels", lambda b: corpus.map_labels(b.dirty_corpus).select("doc_id", "label"),
          f"SELECT doc_id, {LABEL_SQL} AS label FROM dirty_corpus WHERE {LABEL_SQL} IS NOT NULL")
    c.add("c03_unmapped_labels", lambda b: corpus.unmapped_labels(corpus.drop_incomplete(b.dirty_corpus)),
          "SELECT class, count(*) AS n_rows FROM dirty_corpus WHERE class NOT IN ('suicide', 'non-suicide') GROUP BY class")
    c.add("c04_row_positions", _positions,
          "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
    c.add("c05_pick_by_index", _picked,
          f"SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({split_sql(splits.SPLIT_80_10_10)}) WHERE split = 'test')")
    c.add("c05_pick_by_bitmap", _picked_by_bitmap,
          f"SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({split_sql(splits.SPLIT_80_10_10)}) WHERE split = 'test')")
    c.add("s04_split_indices", lambda b: memberships.listed(_memberships(b)),
          f"SELECT split, doc_id AS row_id FROM ({split_sql(splits.SPLIT_80_10_10)})")
    c.add("s04_split_sizes", lambda b: memberships.split_sizes(_memberships(b)),
          f"SELECT split, count(*) AS n_rows FROM ({split_sql(splits.SPLIT_80_10_10)}) GROUP BY split")
    c.add("c06_length_filter", lambda b: corpus.longer_than(b.documents),
          "SELECT doc_id, text FROM documents WHERE length(text) > 10")
    c.add("c06_length_report", lambda b: corpus.length_filter_report(b.documents), """
        SELECT count(*) AS before_rows, count(*) FILTER (WHERE length(text) > 10) AS kept_rows,
               count(*) FILTER (WHERE length(text) <= 10) AS removed_rows FROM documents""")
    c.add("c07_first_copies", _first_copies, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
    c.add("c07_duplicate_report", lambda b: corpus.duplicate_report(b.documents), """
        SELECT count(*) AS before_rows, count(DISTINCT text) AS after_rows,
               count(*) - count(DISTINCT text) AS removed_rows FROM documents""")
    c.add("c08_text_and_class", lambda b: corpus.require_columns(b.corpus),
          "SELECT text, class FROM corpus")
    c.add("c09_non_blank", lambda b: corpus.non_blank(_untrimmed(b)), f"""
        SELECT doc_id, {strip('text')} AS text FROM documents WHERE doc_id % 31 <> 0 AND length({strip('text')}) > 0""")
    c.add("c10_truncate_tokens", lambda b: corpus.truncate(b.documents, 128), f"""
        SELECT doc_id, array_to_string(({words('text')})[1:128], ' ') AS text FROM documents""")
    agent = "CASE k % 5 " + " ".join(f"WHEN {i + 1} THEN '{a}'" for i, a in enumerate(AGENTS)) + " ELSE '' END"
    c.add("c11_prefixes", _previews, f"SELECT id, substring(repeat({agent}, 6), 1, 500) AS user_agent FROM hits")
    c.add("j06_label_map_join", lambda b: _labelled(b).join(
        _picked(b).select("doc_id"), "doc_id", "left_semi"), f"""
        SELECT doc_id, class, {LABEL_SQL} AS label FROM ({split_sql(splits.SPLIT_80_10_10)}) WHERE split = 'test'""")

    for name, parts in (
        ("k01_split_80_10_10", splits.SPLIT_80_10_10), ("k02_split_90_5_5", splits.SPLIT_90_5_5),
        ("k03_split_70_15_15", splits.SPLIT_70_15_15), ("k04_split_90_10", splits.SPLIT_90_10),
    ):
        c.add(name, _split(parts), split_sql(parts))
    c.add("k05_fraction_sample", lambda b: splits.fraction_sample(b.documents, "doc_id", 0.1).select("doc_id"),
          f"SELECT doc_id FROM documents WHERE {HASH_SQL} < round(0.1 * 4294967296.0)")
    c.add("k06_fixed_sample", lambda b: splits.fixed_sample(b.documents, "doc_id", 100).select("doc_id"),
          "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
    c.add("k07_share_report", lambda b: splits.share_report(_split(splits.SPLIT_80_10_10)(b)), f"""
        SELECT split, class, n AS n_rows, round(sum(n) OVER (PARTITION BY split) / sum(n) OVER () * 100, 2) AS split_share,
               round(n / sum(n) OVER (PARTITION BY split) * 100, 2) AS class_share
        FROM (SELECT split, class, count(*) AS n FROM ({split_sql(splits.SPLIT_80_10_10)}) GROUP BY 1, 2)""")
    c.add("k08_oversample", lambda b: splits.oversample(_corrections(b), 3), """
        SELECT text, CASE WHEN teacher_correction IN ('HIGH', 'MEDIUM') THEN 'suicide' ELSE 'non-suicide' END AS class
        FROM feedback, range(1, 4) WHERE NOT is_correct""")
    c.add("k09_combine", _combined, TRAINING_SQL)
    c.add("k10_feedback_gate", _gate, """
        SELECT n_samples, n_samples >= 50 AS enough
        FROM (SELECT count(*) FILTER (WHERE feedback_type = 'correction') AS n_samples FROM reviews)""")
    c.add("k11_class_weights", lambda b: profile.class_weights(_labelled(b)), f"""
        SELECT CAST(label AS INTEGER) AS label, n AS n_rows, CAST(sum(n) OVER () AS BIGINT) / (count(*) OVER () * n) AS weight
        FROM (SELECT {LABEL_SQL} AS label, count(*) AS n FROM corpus GROUP BY 1)""")
    c.add("k12_imbalance", lambda b: profile.imbalance(_labelled(b)), f"""
        SELECT n_negative, n_positive, r AS imbalance_ratio, r > 2.0 OR r < 0.5 AS use_class_weights FROM (
          SELECT *, {ratio('n_negative', 'n_positive')} AS r FROM (
            SELECT count(*) FILTER (WHERE class = 'non-suicide') AS n_negative,
                   count(*) FILTER (WHERE class = 'suicide') AS n_positive FROM corpus))""")
    c.add("k13_corpus_profile", lambda b: profile.corpus_profile(b.dirty_corpus), f"""
        SELECT {PROFILE_SQL}, count(*) FILTER (WHERE class IS NOT NULL) AS clean_rows,
               count(*) FILTER (WHERE class = 'suicide') AS n_suicide,
               count(*) FILTER (WHERE class = 'non-suicide') AS n_non_suicide
        FROM (SELECT class, {word_count('text')} AS n_words FROM dirty_corpus)""")
    c.add("k14_length_by_class", lambda b: profile.length_by_class(b.corpus), f"""
        SELECT class, {PROFILE_SQL} FROM (SELECT class, {word_count('text')} AS n_words FROM corpus) GROUP BY class""")
    c.add("d12_quality_report", lambda b: corpus.quality_report(b.dirty_corpus, ["text", "class"]), """
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(tn) AS BIGINT) AS text_nulls, CAST(sum(cn) AS BIGINT) AS class_nulls,
               count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS tn, count(*) FILTER (WHERE class IS NULL) AS cn
              FROM dirty_corpus GROUP BY text)""")
