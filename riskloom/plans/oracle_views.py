"""SQL twins of the derived tables, as common table expressions for DuckDB."""

from __future__ import annotations

import re

from riskloom.functions import redaction as rd
from riskloom.functions import text as tx
from riskloom.plans import testbed as tb


SPACE_RUN = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def choose(values: tuple[str, ...], index: str) -> str:
    lines = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {lines} END"


def strip(column: str) -> str:
    return f"trim({column}, '{tx.WHITESPACE}')"


def words(column: str) -> str:
    bare = strip(column)
    return f"CASE WHEN length({bare}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split_regex({bare}, '{SPACE_RUN}') END"


def word_count(column: str) -> str:
    return f"CAST(len({words(column)}) AS INTEGER)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / {whole} * 100, 2) ELSE 0 END"


def ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part}) / ({whole}) ELSE 0 END"


_DISPLAY = "CASE WHEN {0} = 1 THEN 'Suicidal' ELSE 'Not Suicidal' END"
_NOTE = "CASE WHEN doc_id % 4 = 0 THEN 'note ' || doc_id END"

_MAIL, _PHONE = rd.EMAIL_PATTERN, rd.PHONE_PATTERN

VIEWS: dict[str, str] = {
    "redacted_documents": f"""
        SELECT doc_id, regexp_replace(mailless, '{_PHONE}', '[PHONE]', 'g') AS redacted,
               CAST(len(regexp_extract_all(text, '{_MAIL}')) AS INTEGER) AS email_count,
               CAST(len(regexp_extract_all(mailless, '{_PHONE}')) AS INTEGER) AS phone_count
        FROM (SELECT doc_id, text, regexp_replace(text, '{_MAIL}', '[EMAIL]', 'g') AS mailless FROM documents)""",
    "corpus": """
        SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'suicide' ELSE 'non-suicide' END AS class
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "dirty_corpus": """
        SELECT d.doc_id, d.text,
               CASE WHEN d.doc_id % 97 = 0 THEN 'unknown' WHEN l.toxic = 1 THEN 'suicide'
                    WHEN l.toxic = 0 THEN 'non-suicide' END AS class
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "hit_lists": """
        SELECT doc_id, text, CAST(contains(lower(text), 'scum') AS INTEGER) AS h,
               CAST(contains(lower(text), 'worthless') AS INTEGER) + CAST(contains(lower(text), 'clown') AS INTEGER) AS m
        FROM documents""",
    "scored": """
        SELECT doc_id, text,
               CASE WHEN h > 0 THEN 'HIGH' WHEN m > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
               CASE WHEN h > 0 THEN 0.95e0 WHEN m > 0 THEN 0.6e0 ELSE 0.1e0 END AS score,
               CASE WHEN h + m > 0 THEN 1 ELSE 0 END AS cls,
               CASE WHEN h > 0 THEN 0.95e0 WHEN m > 0 THEN 0.6e0 ELSE 0.9e0 END AS confidence
        FROM hit_lists""",
    "truth_rows": """
        SELECT doc_id, quality,
               CASE WHEN quality = 0 AND toxic = 0 THEN 1
                    WHEN quality = 1 AND toxic = 1 AND doc_id % 5 = 0 THEN 0 ELSE toxic END AS truth
        FROM labels""",
    "predictions": f"""
        SELECT doc_id AS id, text, cls AS predicted_class, {_DISPLAY.format('cls')} AS predicted_label, confidence,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts
        FROM scored""",
    "judged": "SELECT s.*, t.quality, t.truth FROM scored s JOIN truth_rows t ON s.doc_id = t.doc_id",
    "reviews": f"""
        SELECT doc_id AS id, doc_id AS prediction_id, truth AS correct_class,
               {_DISPLAY.format('truth')} AS correct_label,
               CASE WHEN doc_id % 11 = 0 THEN 'unsure' WHEN cls <> truth THEN 'correction' ELSE 'confirmation' END
                 AS feedback_type,
               {_NOTE} AS teacher_notes, TIMESTAMP '2024-01-02' + to_minutes(doc_id) AS ts,
               CAST(NULL AS VARCHAR) AS email
        FROM judged""",
    "feedback": f"""
        SELECT *, original_prediction = teacher_correction AS is_correct FROM (
        SELECT doc_id AS id, text, risk AS original_prediction, score AS original_score,
               confidence AS original_confidence,
               CASE WHEN truth = 1 AND quality = 0 THEN 'HIGH' WHEN truth = 1 THEN 'MEDIUM' ELSE 'LOW' END
                 AS teacher_correction,
               {_NOTE} AS teacher_notes, 't' || doc_id % 7 AS teacher_id,
               TIMESTAMP '2024-01-02' + to_minutes(doc_id) AS created_at,
               {choose(tb.FEEDBACK_STATES, 'doc_id % 3')} AS status, false AS used_for_training
        FROM judged)""",
    "corrections": "SELECT * FROM reviews WHERE feedback_type = 'correction'",
    "retraining_history": """
        SELECT id // 50 AS id, count(*) AS num_samples FROM corrections GROUP BY 1""",
    "contacts": f"""
        SELECT conv_id, turn, text AS message, {choose(tb.CONTACT_TYPES, 'conv_id % 4')} AS submission_type,
               {choose(tb.CONTACT_STATES, 'turn % 3')} AS status
        FROM conversations WHERE role = 'user'""",
    "model_rows": """
        SELECT 'm_full' AS model, doc_id, h + m AS hits FROM hit_lists
        UNION ALL SELECT 'm_high', doc_id, h FROM hit_lists
        UNION ALL SELECT 'm_medium', doc_id, m FROM hit_lists""",
    "model_predictions": """
        SELECT r.model, r.doc_id AS key, CASE WHEN r.hits > 0 THEN 1 ELSE 0 END AS pred,
               1.0e0 - 1.0e0 / (r.hits + 1) AS prob, t.truth
        FROM model_rows r JOIN truth_rows t ON r.doc_id = t.doc_id""",
    "cells": """
        SELECT model, count(*) FILTER (WHERE truth = 0 AND pred = 0) AS tn,
               count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp,
               count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn,
               count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp
        FROM model_predictions GROUP BY model""",
    "metrics": f"""
        SELECT *, CASE WHEN "precision" + recall > 0 THEN 2.0e0 * "precision" * recall / ("precision" + recall)
                       ELSE 0 END AS f1
        FROM (SELECT model, tn, fp, fn, tp, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
               {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall,
               {ratio('fn', 'fn + tp')} AS fnr, {ratio('fp', 'fp + tn')} AS fpr, {ratio('tn', 'tn + fp')} AS tnr
        FROM cells)""",
    "run_cells": """
        SELECT model, CASE key % 3 WHEN 0 THEN 42 WHEN 1 THEN 123 ELSE 456 END AS seed,
               count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp,
               count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn,
               count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp
        FROM model_predictions GROUP BY 1, 2""",
    "runs": f"""
        SELECT model, seed, fnr, CASE WHEN p + r > 0 THEN 2.0e0 * p * r / (p + r) ELSE 0 END AS f1
        FROM (SELECT model, seed, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r,
                     {ratio('fn', 'fn + tp')} AS fnr FROM run_cells)""",
    "class_totals": """
        SELECT count(*) FILTER (WHERE class = 'suicide') AS n_pos,
               count(*) FILTER (WHERE class = 'non-suicide') AS n_neg FROM corpus""",
    "corpus_terms": f"""
        SELECT doc_id, class, unnest(list_distinct({words('lower(text)')})) AS term FROM corpus""",
    "term_weights": """
        SELECT term, pos_df, neg_df,
               CAST(round((ln((pos_df + n_pos / (n_pos + n_neg)) / (n_pos + 1))
                           - ln((neg_df + (1.0e0 - n_pos / (n_pos + n_neg))) / (n_neg + 1))) * 1000000) AS BIGINT) AS weight_micro
        FROM (SELECT term, count(*) FILTER (WHERE class = 'suicide') AS pos_df,
                     count(*) FILTER (WHERE class = 'non-suicide') AS neg_df
              FROM corpus_terms WHERE term <> '' GROUP BY term) t, class_totals
        UNION ALL
        SELECT '', n_pos, n_neg, CAST(round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN ln(n_pos / n_neg) ELSE 0 END * 1000000) AS BIGINT)
        FROM class_totals""",
    "doc_words": f"""
        SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos
        FROM (SELECT doc_id, {words('lower(text)')} AS w FROM documents)""",
    "doc_z": """
        SELECT d.doc_id, CAST(i.weight_micro + coalesce(z.z, 0) AS BIGINT) AS z_micro
        FROM documents d CROSS JOIN (SELECT weight_micro FROM term_weights WHERE term = '') i LEFT JOIN (
          SELECT t.doc_id, sum(w.weight_micro) AS z FROM (SELECT DISTINCT doc_id, word FROM doc_words WHERE word <> '') t
          JOIN term_weights w ON t.word = w.term GROUP BY t.doc_id) z ON d.doc_id = z.doc_id""",
    "linear_scores": """
        SELECT doc_id, z_micro, prob, pred, CASE WHEN pred = 1 THEN prob ELSE 1.0e0 - prob END AS confidence
        FROM (SELECT doc_id, z_micro, 1.0e0 / (1.0e0 + exp(-(z_micro / 1000000.0e0))) AS prob,
                     CASE WHEN z_micro > 0 THEN 1 ELSE 0 END AS pred FROM doc_z)""",
    "word_scores": """
        SELECT d.doc_id, d.pos, d.word, coalesce(w.weight_micro, 0) / 1000000.0e0 AS score
        FROM doc_words d LEFT JOIN term_weights w ON d.word = w.term AND w.term <> ''""",
    "attributions": """
        SELECT w.doc_id, w.pos, w.word, CASE WHEN s.pred = 1 THEN w.score ELSE -w.score END AS score
        FROM word_scores w JOIN linear_scores s ON w.doc_id = s.doc_id""",
    "normalized": """
        SELECT doc_id, pos, word, score,
               CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0e0 END AS normalized_score
        FROM (SELECT *, min(score) OVER (PARTITION BY doc_id) AS lo, max(score) OVER (PARTITION BY doc_id) AS hi
              FROM attributions)""",
    "marked": """
        SELECT n.*, n.normalized_score >= c.cut AS is_important, s.pred
        FROM normalized n
        JOIN (SELECT doc_id, quantile_cont(normalized_score, 0.75) AS cut FROM normalized GROUP BY doc_id) c
          ON n.doc_id = c.doc_id
        JOIN linear_scores s ON n.doc_id = s.doc_id""",
    "sentences": f"""
        SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_no
        FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'),
                     lambda x: {strip('x')}), lambda x: length(x) > 0) AS s FROM documents)""",
    "positive_sentences": f"""
        SELECT t.doc_id, t.sentence_no, t.sentence, {word_count('t.sentence')} AS n_words
        FROM sentences t JOIN linear_scores s ON t.doc_id = s.doc_id WHERE s.pred = 1""",
    "sentence_scores": """
        SELECT p.doc_id, p.sentence_no, p.sentence, p.n_words, coalesce(round(avg(n.normalized_score), 9), 0.0) AS score
        FROM (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY sentence_no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_pos
              FROM positive_sentences) p
        LEFT JOIN normalized n ON n.doc_id = p.doc_id AND n.pos >= p.first_pos AND n.pos < p.first_pos + p.n_words
        GROUP BY 1, 2, 3, 4""",
    "clean_words": f"""
        SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos
        FROM (SELECT doc_id, {words('lower(redacted)')} AS w FROM redacted_documents)""",
    "clean_scores": """
        SELECT *, CASE WHEN pred = 1 THEN prob ELSE 1.0e0 - prob END AS confidence FROM (
          SELECT doc_id, z, 1.0e0 / (1.0e0 + exp(-(z / 1000000.0e0))) AS prob, CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred FROM (
            SELECT d.doc_id, i.weight_micro + coalesce(s.z, 0) AS z
            FROM documents d CROSS JOIN (SELECT weight_micro FROM term_weights WHERE term = '') i LEFT JOIN (
              SELECT t.doc_id, sum(w.weight_micro) AS z FROM (SELECT DISTINCT doc_id, word FROM clean_words) t
              JOIN term_weights w ON t.word = w.term AND w.term <> '' GROUP BY t.doc_id) s ON d.doc_id = s.doc_id))""",
    "clean_normalized": """
        SELECT doc_id, pos, word, pred, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0e0 END AS normalized_score FROM (
          SELECT *, min(s) OVER (PARTITION BY doc_id) AS lo, max(s) OVER (PARTITION BY doc_id) AS hi FROM (
            SELECT d.doc_id, d.pos, d.word, c.pred,
                   coalesce(w.weight_micro, 0) / 1000000.0e0 * CASE WHEN c.pred = 1 THEN 1.0e0 ELSE -1.0e0 END AS s
            FROM clean_words d JOIN clean_scores c ON d.doc_id = c.doc_id
            LEFT JOIN term_weights w ON d.word = w.term AND w.term <> ''))""",
    "clean_marked": """
        SELECT n.*, n.normalized_score >= c.cut AS is_important FROM clean_normalized n
        JOIN (SELECT doc_id, quantile_cont(normalized_score, 0.75) AS cut FROM clean_normalized GROUP BY doc_id) c
          ON n.doc_id = c.doc_id""",
    "clean_sentences": f"""
        SELECT t.doc_id, t.sentence_no, t.sentence, {word_count('t.sentence')} AS n_words FROM (
          SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_no
          FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(redacted, '[.!?]+'),
                       lambda x: {strip('x')}), lambda x: length(x) > 0) AS s FROM redacted_documents)) t
        JOIN clean_scores c ON t.doc_id = c.doc_id WHERE c.pred = 1""",
    "clean_problems": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_no) AS rank FROM (
          SELECT p.doc_id, p.sentence_no, p.sentence, round(avg(n.normalized_score), 9) AS score
          FROM (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY sentence_no
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_pos FROM clean_sentences) p
          JOIN clean_normalized n ON n.doc_id = p.doc_id AND n.pos >= p.first_pos AND n.pos < p.first_pos + p.n_words
          GROUP BY 1, 2, 3) WHERE score >= 0.5) WHERE rank <= 3""",
    "hits": """
        SELECT event_id AS id, ts, event_type,
               '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip_address,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
               CASE WHEN event_type = 'error' THEN '/api/' ELSE '/' END || event_type AS path,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method
        FROM events""",
    "visitors": f"""
        SELECT id, ip_address, path, method, {choose(tb.BROWSERS, 'k % 5 - 1')} AS browser,
               {choose(tb.DEVICES, 'k % 3')} AS device_type, {choose(tb.SYSTEMS, 'k % 4')} AS os, ts
        FROM hits""",
    "requests": f"""
        SELECT id, CASE WHEN k % 2 = 0 THEN ip_address || ', 172.16.0.1' END AS forwarded, ip_address AS peer,
               {choose(tb.AGENTS, 'k % 5 - 1')} AS user_agent, path, method, ts
        FROM hits""",
    "last_week": """
        SELECT * FROM visitors WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
}


def with_views(body: str) -> str:
    """``body`` preceded by the views it names, directly or through other views."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text):
                needed.add(name)
                todo.append(sql)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed)
    return f"WITH {parts}\n{body}"
