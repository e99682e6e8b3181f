"""Risk assessment of texts: redaction, keyword or model score, risk level, excerpt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels, lexicon as lx, redaction, text

# Confidence cuts of the model path.
HIGH_CONFIDENCE, FIRM_CONFIDENCE = 0.90, 0.70
RISK_FIELDS = (
    "risk_level", "score", "confidence", "prediction", "triggers", "guidance", "needs_human_review")


def keyword_risk(df: DataFrame, lexicon: lx.Lexicon = lx.Lexicon(), column: str = "text") -> DataFrame:
    """Add ``risk_level, score, triggers, guidance, needs_human_review`` from the lexicon."""
    lowered = df.withColumn("_low", F.lower(column))
    found = lowered.select(
        *df.columns,
        lexicon.matches(F.col("_low"), lexicon.high).alias("_high"),
        lexicon.matches(F.col("_low"), lexicon.medium).alias("_medium"),
    )
    levelled = found.withColumn("risk_level", lx.level_of(F.col("_high"), F.col("_medium")))
    level = F.col("risk_level")
    return levelled.select(
        *df.columns,
        level,
        lx.by_level(level, lx.KEYWORD_SCORE).alias("score"),
        F.when(level == lx.HIGH, F.col("_high")).otherwise(F.col("_medium")).alias("triggers"),
        lx.by_level(level, lx.KEYWORD_GUIDANCE).alias("guidance"),
        F.lit(True).alias("needs_human_review"),
    )


def model_level(cls: Column, confidence: Column) -> Column:
    return (
        F.when((cls == 1) & (confidence >= HIGH_CONFIDENCE), lx.HIGH)
        .when(cls == 1, lx.MEDIUM).otherwise(lx.LOW)
    )


def model_guidance(cls: Column, confidence: Column) -> Column:
    return (
        F.when(cls != 1, lx.NO_SIGNAL_GUIDANCE)
        .when(confidence >= HIGH_CONFIDENCE, lx.ALERT_GUIDANCE)
        .when(confidence >= FIRM_CONFIDENCE, lx.CHECK_IN_GUIDANCE)
        .otherwise(lx.WEAK_SIGNAL_GUIDANCE)
    )


def directional_score(cls: Column, confidence: Column) -> Column:
    """Probability of the positive class, whichever class was predicted."""
    return F.when(cls == 1, confidence).otherwise(F.lit(1.0) - confidence)


def model_risk(cls: Column, confidence: Column, triggers: Column | None = None) -> Column:
    """Model assessment as a struct; null where the model gave nothing."""
    return F.when(
        cls.isNotNull() & confidence.isNotNull(),
        F.struct(
            model_level(cls, confidence).alias("risk_level"),
            directional_score(cls, confidence).alias("score"),
            confidence.cast("double").alias("confidence"),
            labels.label_of(cls).alias("prediction"),
            (triggers if triggers is not None else F.array().cast("array<string>")).alias("triggers"),
            model_guidance(cls, confidence).alias("guidance"),
            F.lit(True).alias("needs_human_review"),
        ),
    )


def analyze(
    df: DataFrame,
    lexicon: lx.Lexicon = lx.Lexicon(),
    column: str = "text",
    model_class: str | None = None,
    model_confidence: str | None = None,
    model_triggers: str | None = None,
) -> DataFrame:
    """Analysis document per text, in one narrow projection.

    Redacts first, assesses the redacted text, cuts the excerpt from it.  When
    ``model_class`` and ``model_confidence`` name columns, rows that have them
    use the model and the rest fall back to keywords.  ``method`` tags the row,
    ``process_method`` the run.  The raw text is not passed on.
    """
    passed = [c for c in df.columns if c != column]
    assessed = keyword_risk(redaction.redact(df, column, "_clean"), lexicon, "_clean")
    keyword = F.struct(
        F.col("risk_level"), F.col("score"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("prediction"), F.col("triggers"), F.col("guidance"),
        F.col("needs_human_review"),
    )
    if model_class and model_confidence:
        model = model_risk(
            F.col(model_class), F.col(model_confidence), F.col(model_triggers) if model_triggers else None)
        used_model = model.isNotNull()
        risk, process = F.coalesce(model, keyword), "ml_model"
        method = F.when(used_model, "ml_model").otherwise("keyword_fallback")
    else:
        risk, process = keyword, "keyword_fallback"
        method = F.lit("keyword_fallback")
    return assessed.select(
        *passed,
        F.struct(F.col("email_count").alias("email"), F.col("phone_count").alias("phone")).alias("pii_redacted"),
        risk.alias("risk"),
        text.excerpt(F.col("_clean")).alias("sanitized_excerpt"),
        method.alias("method"),
        F.lit(process).alias("process_method"),
    )


def flatten(analysis: DataFrame, *keys: str) -> DataFrame:
    """Scalar columns of an analysis document; triggers joined by ``; ``."""
    return analysis.select(
        *keys,
        F.col("pii_redacted.email").alias("email_count"),
        F.col("pii_redacted.phone").alias("phone_count"),
        F.col("risk.risk_level").alias("risk_level"),
        F.col("risk.score").alias("score"),
        F.array_join("risk.triggers", "; ").alias("triggers"),
        F.col("risk.guidance").alias("guidance"),
        F.col("risk.needs_human_review").alias("needs_human_review"),
        "sanitized_excerpt",
        "method",
    )


def softmax2(zero: Column, one: Column) -> tuple[Column, Column]:
    """Two-class softmax, shifted by the larger score so that it cannot overflow."""
    top = F.greatest(zero, one)
    a, b = F.exp(zero - top), F.exp(one - top)
    return a / (a + b), b / (a + b)


def softmax(scores: Column) -> Column:
    """Softmax over an array of scores."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def prediction_or_default(pred: Column, default: int = 0) -> Column:
    """A failed prediction counts as ``default``."""
    return F.coalesce(pred, F.lit(default))


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, "red").when(score >= 0.7, "orange").otherwise("yellow")
