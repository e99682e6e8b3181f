"""Queries opN_<name> over the whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    block_labeller,
    bpe_index,
    conversation_repair,
    licence_scan,
    ngram_jaccard,
    pii_anchors,
    quality_ledger,
    source_mix,
    suffix_dedup,
    token_files,
    toxicity,
    vector_graph,
    whitening,
)

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similarity_components(_documents(spark, sf_dir))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_documents(spark, sf_dir))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchors.personal_data(_documents(spark, sf_dir))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_indexed(_documents(spark, sf_dir), WORD_VOCABULARY, by_word=True)


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_index.encoding_digests(_documents(spark, sf_dir), WORD_VOCABULARY)


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(_documents(spark, sf_dir))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.ledger(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failures",
        (~quality_ledger.verdict("base")).alias("base_failed"), quality_ledger.verdict("v1").alias("kept"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_documents(spark, sf_dir))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": _op1,
    "op2_source_mix": _op2,
    "op3_pii_anchors": _op3,
    "op4_block_labeller": _op4,
    "op5_vector_graph": _op5,
    "op6_token_files": _op6,
    "op7_bpe_index": _op7,
    "op8_toxicity": _op8,
    "op9_licence_scan": _op9,
    "op10_quality_ledger": _op10,
    "op11_whitening": _op11,
    "op12_suffix_dedup": _op12,
    "op13_conversation_repair": _op13,
}

_KEY = "('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 13))::BIGINT"

_NOTICES = ", ".join("('{}', '{}')".format(name, " ".join(re.sub(r"[^A-Za-z0-9]+", " ", t).lower().split())) for name, t in licence_scan.TEMPLATES)

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT l.y, r.root FROM reached r JOIN links l ON l.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op2_source_mix": rf"""
WITH sized AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((2 * {_KEY}::DOUBLE + 1) / 9007199254740992.0)
           / CASE WHEN size >= 20 AND chars >= 3 * size AND chars <= 12 * size THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS k
  FROM sized),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight
  FROM sums),
placed AS (
  SELECT *, row_number() OVER need AS place,
         coalesce(sum(cap) OVER (need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total
  FROM weighed WINDOW need AS (ORDER BY cap / weight, source IS NULL, source)),
levels AS (SELECT *, (1.5 * total - capped)::DOUBLE / open AS level FROM placed),
level AS (SELECT min_by(level, place) AS level FROM levels WHERE level * weight <= cap),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM level) * weight) AS target FROM levels),
ended AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
run AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs,
         round(g.target - g.epochs * g.source_size)::BIGINT AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM keyed d JOIN ended g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM run""",
    "op9_licence_scan": rf"""
WITH notices(name, notice) AS (VALUES {_NOTICES}),
templates AS (
  SELECT name, notice, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS grams
  FROM (SELECT name, notice, string_split(notice, ' ') AS w FROM notices)),
plain AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS p FROM documents),
units AS (
  SELECT doc_id, TRUE AS is_line, unnest(string_split(p, chr(10))) AS u FROM plain
  UNION ALL SELECT doc_id, FALSE, unnest(string_split_regex(p, '\n ?\n[\n ]*')) FROM plain
  UNION ALL SELECT doc_id, FALSE, p FROM plain),
worded AS (
  SELECT doc_id, is_line, list_filter(string_split(replace(u, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM units),
sized AS (SELECT *, len(w) - 1 AS n FROM worded WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, is_line, t.name, w,
         2.0::DOUBLE * len(list_intersect([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], grams)) / (n + len(grams)) AS dice, s.n
  FROM (SELECT *, row_number() OVER () AS at FROM sized) s JOIN templates t ON 2.0 * least(n, len(grams)) / (n + len(grams)) >= 0.8),
good AS (SELECT * FROM scored WHERE dice >= 0.8),
line_counts AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id, unnest(string_split(p, chr(10))) AS u FROM plain) l
  WHERE EXISTS (SELECT 1 FROM good g WHERE g.doc_id = l.doc_id AND g.is_line AND g.w = list_filter(string_split(l.u, ' '), lambda x: x <> ''))
  GROUP BY doc_id),
best AS (SELECT doc_id, max({{'dice': dice, 'name': name}}) AS b FROM good GROUP BY doc_id)
SELECT d.doc_id, b.b.name AS license, coalesce(b.b.dice, 0.0) AS dice, coalesce(c.n, 0)::BIGINT AS n_license_lines
FROM plain d LEFT JOIN best b USING (doc_id) LEFT JOIN line_counts c USING (doc_id)""",
    "op10_quality_ledger": r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS p, w FROM words WHERE len(w) >= 8),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM places),
again AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS times FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n FROM (SELECT doc_id, unnest(generate_series(p, p + 7)) AS q FROM again WHERE times > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM words),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
bits AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
    + 4 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT + 8 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 16 * (2 * n_dup_lines > n_lines)::BIGINT + 32 * (10 * n_symbols > n_words)::BIGINT
    + 64 * (10 * n_dup_lines > 3 * n_lines)::BIGINT AS failures
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failures,
       (failures & 3) <> 0 AS base_failed, (failures & 31) = 0 AS kept
FROM bits""",
}
