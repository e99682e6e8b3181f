"""Text scoring and attribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels as lb
from riskloom.functions import lexicon as lx
from riskloom.functions import redaction as rd
from riskloom.functions import text as tx
from riskloom.operators import attribution, explain, linear, scoring
from riskloom.plans.catalog import Catalog
from riskloom.plans.testbed import TEST_LEXICON, Testbed

REDACTED_SQL = "SELECT * FROM redacted_documents"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def keyword_sql(source: str, column: str, passed: str) -> str:
    """Keyword risk with the test lexicon over ``column`` of ``source``."""
    g = lx.KEYWORD_GUIDANCE
    return f"""
    SELECT {passed}, risk_level,
           CASE risk_level WHEN 'HIGH' THEN 0.95e0 WHEN 'MEDIUM' THEN 0.6e0 ELSE 0.1e0 END AS score,
           CASE risk_level WHEN 'HIGH' THEN 'scum' WHEN 'MEDIUM' THEN concat_ws('; ',
                CASE WHEN worthless THEN 'worthless' END, CASE WHEN clown THEN 'clown' END) ELSE '' END AS triggers,
           CASE risk_level WHEN 'HIGH' THEN {_quote(g['HIGH'])} WHEN 'MEDIUM' THEN {_quote(g['MEDIUM'])}
                ELSE {_quote(g['LOW'])} END AS guidance,
           true AS needs_human_review
    FROM (SELECT *, contains(lower({column}), 'worthless') AS worthless, contains(lower({column}), 'clown') AS clown,
                 CASE WHEN contains(lower({column}), 'scum') THEN 'HIGH'
                      WHEN contains(lower({column}), 'worthless') OR contains(lower({column}), 'clown') THEN 'MEDIUM'
                      ELSE 'LOW' END AS risk_level
          FROM ({source}))"""


EXCERPT_SQL = "CASE WHEN length({0}) > 240 THEN substring({0}, 1, 240) || '...' ELSE {0} END"


def analysis_sql() -> str:
    passed = f"doc_id, email_count, phone_count, {EXCERPT_SQL.format('redacted')} AS sanitized_excerpt"
    return f"SELECT *, 'keyword_fallback' AS method FROM ({keyword_sql(REDACTED_SQL, 'redacted', passed)})"


def model_risk_sql(source: str) -> str:
    """Model columns ``pred, confidence`` of ``source`` to the risk struct's fields."""
    return f"""
    SELECT doc_id, pred, confidence,
           CASE WHEN pred = 1 AND confidence >= 0.9 THEN 'HIGH' WHEN pred = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
           CASE WHEN pred = 1 THEN confidence ELSE 1.0e0 - confidence END AS score,
           CASE WHEN pred = 1 THEN 'suicide' ELSE 'non-suicide' END AS prediction,
           CASE WHEN pred <> 1 THEN {_quote(lx.NO_SIGNAL_GUIDANCE)} WHEN confidence >= 0.9 THEN {_quote(lx.ALERT_GUIDANCE)}
                WHEN confidence >= 0.7 THEN {_quote(lx.CHECK_IN_GUIDANCE)} ELSE {_quote(lx.WEAK_SIGNAL_GUIDANCE)} END AS guidance
    FROM ({source})"""


# every fifth document has no model result, so it falls back to keywords
PARTIAL_SQL = "SELECT doc_id, pred, confidence FROM linear_scores WHERE doc_id % 5 <> 0"


def analyze(bed: Testbed) -> DataFrame:
    return scoring.flatten(scoring.analyze(bed.documents, TEST_LEXICON), "doc_id")


def _explained(bed: Testbed) -> DataFrame:
    """Flat for comparison: words with their score in millionths, important ones marked."""
    risk = F.col("risk")
    micro = lambda c: F.round(c * 1_000_000).cast("long").cast("string")
    words = F.transform(risk["highlighted_words"], lambda w: F.concat(
        w["text"], F.lit("="), micro(w["normalized_score"]), F.when(w["is_important"], "!").otherwise("")))
    sentences = F.transform(risk["problematic_sentences"], lambda s: F.concat(s["sentence"], F.lit("="), micro(s["score"])))
    return explain.analyze_explained(bed.documents, bed.weights).select(
        "doc_id", F.col("pii_redacted.email").alias("email_count"), F.col("pii_redacted.phone").alias("phone_count"),
        risk["risk_level"].alias("risk_level"), F.round(risk["score"], 6).alias("score"), risk["prediction"].alias("prediction"),
        risk["guidance"].alias("guidance"), F.array_join(risk["triggers"], "; ").alias("triggers"),
        F.array_join(words, " ").alias("highlighted_words"), F.array_join(sentences, " | ").alias("problematic_sentences"),
        "sanitized_excerpt", "method")


def _redact(bed: Testbed) -> DataFrame:
    return rd.redact(bed.documents).select("doc_id", "redacted", "email_count", "phone_count")


def _keyword(bed: Testbed) -> DataFrame:
    return scoring.keyword_risk(bed.documents, TEST_LEXICON).drop("text").withColumn(
        "triggers", F.array_join("triggers", "; "))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded for comparison only; nothing is decided on rounded values."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _model_scores(bed: Testbed) -> DataFrame:
    return _shown(bed.linear_scores.select("doc_id", "pred", "confidence"), "confidence")


def _model_levels(bed: Testbed) -> DataFrame:
    pred, conf = F.col("pred"), F.col("confidence")
    return _shown(bed.linear_scores.select(
        "doc_id", "pred", "confidence", scoring.model_level(pred, conf).alias("risk_level"),
        scoring.model_guidance(pred, conf).alias("guidance")), "confidence")


def _direction(bed: Testbed) -> DataFrame:
    return _shown(bed.linear_scores.select(
        "doc_id", scoring.directional_score(F.col("pred"), F.col("confidence")).alias("score")), "score")


def _partly_scored(bed: Testbed) -> DataFrame:
    partial = bed.linear_scores.where(F.col("doc_id") % 5 != 0).select("doc_id", "pred", "confidence")
    return bed.documents.join(partial, "doc_id", "left")


def _fallback(bed: Testbed) -> DataFrame:
    document = scoring.analyze(_partly_scored(bed), TEST_LEXICON, model_class="pred", model_confidence="confidence")
    return document.select(
        "doc_id", F.col("risk.risk_level").alias("risk_level"), F.round(F.col("risk.score"), 6).alias("score"),
        F.col("risk.prediction").alias("prediction"), F.col("risk.guidance").alias("guidance"))


def _methods(bed: Testbed) -> DataFrame:
    document = scoring.analyze(_partly_scored(bed), TEST_LEXICON, model_class="pred", model_confidence="confidence")
    return document.select("doc_id", "method", "process_method")


def _excerpts(bed: Testbed) -> DataFrame:
    return rd.redact(bed.documents).select("doc_id", tx.excerpt(F.col("redacted")).alias("sanitized_excerpt"))


def _sentences(bed: Testbed) -> DataFrame:
    return attribution.sentence_rows(bed.documents).select("doc_id", "sentence_no", "sentence")


def _worst_sentences(bed: Testbed) -> DataFrame:
    return attribution.problematic_sentences(attribution.sentence_means(attribution.normalize(bed.sentence_words)))


def _problematic(bed: Testbed) -> DataFrame:
    told = attribution.sentence_means(attribution.normalize(bed.sentence_words), with_text=True)
    return attribution.problematic_sentences(told).select("doc_id", "rank", F.explode("sentences").alias("sentence"), "score")


def _sentence_join(bed: Testbed) -> DataFrame:
    """The same scores when the words come from elsewhere: joined on (document, position)."""
    docs = bed.texts.join(bed.linear_scores.select("doc_id", "pred"), "doc_id")
    scores = attribution.sentence_scores(docs, attribution.normalize(bed.positive_words))
    return scores.select("doc_id", "sentence_no", "n_words", "score")


def _merged(bed: Testbed) -> DataFrame:
    return attribution.merge_pieces(bed.pieces)


def _normalized(bed: Testbed) -> DataFrame:
    return attribution.normalize(bed.attributions).select("doc_id", "pos", "word", "score", "normalized_score")


def _marked(bed: Testbed) -> DataFrame:
    return attribution.mark_important(_normalized(bed)).select(
        "doc_id", "pos", "word", "normalized_score", "is_important")


def _triggers(bed: Testbed) -> DataFrame:
    marked = attribution.mark_important(attribution.normalize(bed.positive_words))
    return attribution.trigger_words(marked.withColumn("pred", F.lit(1))).select("doc_id", "rank", "pos", "word")


def _top_words(bed: Testbed) -> DataFrame:
    return attribution.top_words(_normalized(bed)).select("doc_id", "rank", "pos", "word", "normalized_score")


def _token_attribution(bed: Testbed) -> DataFrame:
    return bed.attributions.select("doc_id", "pos", "word", F.col("score").alias("attribution"))


def _two_class(bed: Testbed) -> DataFrame:
    z = F.col("z_micro") / linear.MICRO
    p0, p1 = scoring.softmax2(F.lit(0.0), z)
    scores = F.array(F.lit(0.0), z)
    wide = scoring.softmax(scores)
    return bed.linear_scores.select(
        "doc_id", F.round(p0, 6).alias("p0"), F.round(p1, 6).alias("p1"),
        F.round(F.element_at(wide, 2), 6).alias("p1_from_array"), scoring.argmax(scores).alias("pred"))


def _labels(bed: Testbed) -> DataFrame:
    return bed.scored.select(
        "doc_id", lb.label_of(F.col("cls")).alias("prediction"), lb.display_of(F.col("cls")).alias("display"))


def _severity(bed: Testbed) -> DataFrame:
    return _worst_sentences(bed).groupBy(
        scoring.severity(F.col("score")).alias("color")).agg(F.count("*").alias("n_sentences"))


def _weights(bed: Testbed) -> DataFrame:
    return bed.weights.select("term", "pos_df", "neg_df", "weight_micro")


def _linear(bed: Testbed) -> DataFrame:
    return _shown(bed.linear_scores, "prob", "confidence")


def register(c: Catalog) -> None:
    c.add("x01_redact_pii", _redact, REDACTED_SQL)
    c.add("x02_keyword_risk", _keyword, keyword_sql("SELECT * FROM documents", "text", "doc_id"))
    c.add("x03_model_scores", _model_scores, "SELECT doc_id, pred, round(confidence, 6) AS confidence FROM linear_scores")
    c.add("x04_model_risk_level", _model_levels,
          f"SELECT doc_id, pred, round(confidence, 6) AS confidence, risk_level, guidance FROM ({model_risk_sql('SELECT * FROM linear_scores')})")
    c.add("x05_directional_score", _direction,
          f"SELECT doc_id, round(score, 6) AS score FROM ({model_risk_sql('SELECT * FROM linear_scores')})")
    c.add("x06_model_or_keywords", _fallback, f"""
        SELECT k.doc_id, coalesce(m.risk_level, k.risk_level) AS risk_level, round(coalesce(m.score, k.score), 6) AS score,
               m.prediction, coalesce(m.guidance, k.guidance) AS guidance
        FROM ({keyword_sql(REDACTED_SQL, 'redacted', 'doc_id')}) k
        LEFT JOIN ({model_risk_sql(PARTIAL_SQL)}) m ON k.doc_id = m.doc_id""")
    c.add("x07_method_tag", _methods, """
        SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'ml_model' ELSE 'keyword_fallback' END AS method,
               'ml_model' AS process_method FROM documents""")
    c.add("x08_excerpt", _excerpts,
          f"SELECT doc_id, {EXCERPT_SQL.format('redacted')} AS sanitized_excerpt FROM ({REDACTED_SQL})")
    c.add("x09_analyze", analyze, analysis_sql())
    c.add("x09_analyze_explained", _explained, f"""
        SELECT d.doc_id, d.email_count, d.phone_count, m.risk_level, round(m.score, 6) AS score, m.prediction, m.guidance,
               coalesce(t.triggers, '') AS triggers, h.words AS highlighted_words,
               CASE WHEN h.words IS NOT NULL THEN coalesce(p.sentences, '') END AS problematic_sentences,
               {EXCERPT_SQL.format('d.redacted')} AS sanitized_excerpt, 'ml_model' AS method
        FROM redacted_documents d JOIN ({model_risk_sql('SELECT * FROM clean_scores')}) m ON d.doc_id = m.doc_id
        LEFT JOIN (SELECT doc_id, string_agg(word || '=' || CAST(CAST(round(normalized_score * 1000000) AS BIGINT) AS VARCHAR)
                     || CASE WHEN is_important THEN '!' ELSE '' END, ' ' ORDER BY pos) AS words
                   FROM clean_marked GROUP BY doc_id) h ON d.doc_id = h.doc_id
        LEFT JOIN (SELECT doc_id, string_agg(word, '; ' ORDER BY pos) AS triggers FROM (
                     SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM clean_marked WHERE is_important AND pred = 1)
                   WHERE r <= 10 GROUP BY doc_id) t ON d.doc_id = t.doc_id
        LEFT JOIN (SELECT doc_id, string_agg(sentence || '=' || CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ' | ' ORDER BY rank) AS sentences
                   FROM clean_problems GROUP BY doc_id) p ON d.doc_id = p.doc_id""")
    c.add("x10_sentences", _sentences, "SELECT doc_id, sentence_no, sentence FROM sentences")
    c.add("x11_problematic_sentences", _problematic, """
        SELECT doc_id, CAST(rank AS INTEGER) AS rank, sentence, score FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_no) AS rank
          FROM sentence_scores WHERE score >= 0.5) WHERE rank <= 3""")
    c.add("x11_sentence_scores", _sentence_join,
          "SELECT doc_id, sentence_no, n_words, score FROM sentence_scores")
    c.add("x12_merge_pieces", _merged, """
        SELECT doc_id, pos * 2 AS pos, word,
               CASE WHEN length(word) > 6 THEN score / 2 ELSE score END AS score FROM word_scores""")
    c.add("x13_normalize", _normalized, "SELECT doc_id, pos, word, score, normalized_score FROM normalized")
    c.add("x14_important_words", _marked,
          "SELECT doc_id, pos, word, normalized_score, is_important FROM marked")
    c.add("x15_trigger_words", _triggers, """
        SELECT doc_id, CAST(rank AS INTEGER) AS rank, pos, word FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank
          FROM marked WHERE is_important AND pred = 1) WHERE rank <= 10""")
    c.add("x16_top_words", _top_words, """
        SELECT doc_id, CAST(rank AS INTEGER) AS rank, pos, word, normalized_score FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY normalized_score DESC, pos) AS rank
          FROM normalized) WHERE rank <= 10""")
    c.add("x17_token_attribution", _token_attribution, """
        SELECT doc_id, pos, word, score AS attribution FROM attributions""")
    c.add("x18_softmax_argmax", _two_class, """
        SELECT doc_id, round(1.0e0 - p, 6) AS p0, round(p, 6) AS p1, round(p, 6) AS p1_from_array,
               CASE WHEN z_micro > 0 THEN 1 ELSE 0 END AS pred
        FROM (SELECT doc_id, z_micro, 1.0e0 / (1.0e0 + exp(-(z_micro / 1000000.0e0))) AS p FROM doc_z)""")
    c.add("x19_display_label", _labels, """
        SELECT doc_id, CASE WHEN cls = 1 THEN 'suicide' ELSE 'non-suicide' END AS prediction,
               CASE WHEN cls = 1 THEN 'Suicidal' ELSE 'Not Suicidal' END AS display FROM scored""")
    c.add("x20_sentence_severity", _severity, """
        SELECT CASE WHEN score >= 0.9 THEN 'red' WHEN score >= 0.7 THEN 'orange' ELSE 'yellow' END AS color,
               count(*) AS n_sentences
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_no) AS rank
              FROM sentence_scores WHERE score >= 0.5) WHERE rank <= 3 GROUP BY 1""")
    c.add("m06_term_weights", _weights, "SELECT term, pos_df, neg_df, weight_micro FROM term_weights")
    c.add("m06_linear_scores", _linear, "SELECT doc_id, z_micro, round(prob, 6) AS prob, pred, round(confidence, 6) AS confidence FROM linear_scores")
