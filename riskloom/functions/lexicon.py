"""Keyword risk: a lexicon of phrases per risk level, matched as lower-case substrings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH = "LOW", "MEDIUM", "HIGH"
RISK_LEVELS = (LOW, MEDIUM, HIGH)

# Score per level and the wording shown to reviewers.
KEYWORD_SCORE = {HIGH: 0.95, MEDIUM: 0.6, LOW: 0.1}

ALERT_GUIDANCE = (
    "High-risk indicators detected. Alert appropriate staff immediately and follow your school's escalation protocol."
)
CHECK_IN_GUIDANCE = (
    "Concerning signals present. Review with care and consider a check-in with the student per policy."
)
WEAK_SIGNAL_GUIDANCE = (
    "Some concerning language detected. Review in context and follow institutional guidelines."
)
NO_KEYWORD_GUIDANCE = (
    "No explicit self-harm language detected by the heuristic. Still review in context."
)
NO_SIGNAL_GUIDANCE = (
    "No strong indicators of suicidal ideation detected. Still review in context."
)

# The default phrases, in matching order.
DEFAULT_HIGH = (
    "suicide",
    "kill myself",
    "end my life",
    "want to die",
    "hang myself",
    "overdose",
    "take my life",
    "kill myself tonight",
)
DEFAULT_MEDIUM = (
    "self-harm",
    "self harm",
    "cutting",
    "cut myself",
    "i can't go on",
    "i cant go on",
    "hopeless",
    "worthless",
    "i wish i wasn't here",
    "i wish i wasnt here",
    "i don't want to live",
    "i dont want to live",
    "life is pointless",
)


@dataclass(frozen=True)
class Lexicon:
    """Phrases per level.  ``whole_words`` matches at word boundaries instead of anywhere."""

    high: tuple[str, ...] = DEFAULT_HIGH
    medium: tuple[str, ...] = DEFAULT_MEDIUM
    whole_words: bool = False

    def _hit(self, lowered: Column, phrase: str) -> Column:
        if self.whole_words:
            return F.rlike(lowered, F.lit(r"(?U)\b\Q" + phrase + r"\E\b"))
        return F.contains(lowered, F.lit(phrase))

    def matches(self, lowered: Column, phrases: tuple[str, ...]) -> Column:
        """Matching phrases in list order.  Built from codegen-able parts, no lambda."""
        if not phrases:
            return F.array().cast("array<string>")
        hits = [F.when(self._hit(lowered, p), F.lit(p)) for p in phrases]
        return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))

    def hit_count(self, lowered: Column, phrases: tuple[str, ...]) -> Column:
        total = F.lit(0)
        for phrase in phrases:
            total = total + self._hit(lowered, phrase).cast("int")
        return total


def level_of(high: Column, medium: Column) -> Column:
    return F.when(F.size(high) > 0, HIGH).when(F.size(medium) > 0, MEDIUM).otherwise(LOW)


def by_level(level: Column, values: dict) -> Column:
    chain = F.when(level == HIGH, F.lit(values[HIGH])).when(level == MEDIUM, F.lit(values[MEDIUM]))
    return chain.otherwise(F.lit(values[LOW]))


KEYWORD_GUIDANCE = {HIGH: ALERT_GUIDANCE, MEDIUM: CHECK_IN_GUIDANCE, LOW: NO_KEYWORD_GUIDANCE}


def binary_label(level: Column) -> Column:
    """HIGH and MEDIUM are the positive class, anything else negative."""
    return F.when(level.isin(HIGH, MEDIUM), "suicide").otherwise("non-suicide")


def binary_class(level: Column) -> Column:
    return level.isin(HIGH, MEDIUM).cast("int")
