"""Removal of e-mail addresses and phone numbers, with counts per kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and placeholders.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b"
# the same matches in linear time: a match begins where a run of local characters does, or where the last match ended
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# digits, white space and word borders are Unicode ones
_PHONE = "(?U)" + PHONE_PATTERN
# every phone number ends in this; the test is cheaper than the pattern and most texts fail it
_PHONE_TAIL = r"(?U)\d{3}[-.\s]?\d{4}"
EMAIL_MARK = "[EMAIL]"
PHONE_MARK = "[PHONE]"


def _marks(text: Column, mark: str) -> Column:
    gone = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return (gone / len(mark)).cast("int")


def _gained(before: Column, after: Column, mark: str) -> Column:
    return F.when(before == after, F.lit(0)).otherwise(_marks(after, mark) - _marks(before, mark))


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """Add ``out``, ``email_count`` and ``phone_count``.

    E-mails go first, phones are looked for in what is left.  A cheap necessary
    test keeps each pattern off the many texts that cannot match it, and each
    pattern runs once per text: since no match can overlap a mark already in the
    text, the number of marks gained is the number of matches.
    """
    step = df.withColumn(
        "_mailless",
        F.when(F.contains(F.col(text), F.lit("@")), F.regexp_replace(text, _EMAIL, EMAIL_MARK))
        .otherwise(F.col(text)),
    ).withColumn(
        "_numberless",
        F.when(F.rlike(F.col("_mailless"), F.lit(_PHONE_TAIL)), F.regexp_replace("_mailless", _PHONE, PHONE_MARK))
        .otherwise(F.col("_mailless")),
    )

    return (
        step.withColumn("email_count", _gained(F.col(text), F.col("_mailless"), EMAIL_MARK))
        .withColumn("phone_count", _gained(F.col("_mailless"), F.col("_numberless"), PHONE_MARK))
        .withColumn(out, F.col("_numberless"))
        .drop("_mailless", "_numberless")
    )
