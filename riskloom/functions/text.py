"""Text expressions: trimming, words, tokens, sentences, previews.

White space is the full Unicode set, so results do not depend on the regex
engine's idea of ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters, as code points and as a regex class.
WHITESPACE_POINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITESPACE = "".join(map(chr, WHITESPACE_POINTS))
# Below U+0100 the characters are listed singly and the rest sits behind one range
# test, so that a letter costs Java's matcher two checks instead of one per range.
_CLASS = (
    r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)
SPACE_RUN = f"[{_CLASS}]+"
WORD_RUN = f"[^{_CLASS}]+"

SENTENCE_END = "[.!?]+"

# Fixed value: a vectoriser token is two or more word characters.
TOKEN = r"\b\w\w+\b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def words(text: Column) -> Column:
    """White-space separated words in order; an empty array for blank text."""
    bare = strip(text)
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RUN))


def truncate_words(text: Column, max_length: int) -> Column:
    """First ``max_length`` white-space tokens, joined by one space."""
    return F.array_join(F.slice(words(text), 1, max_length), " ")


def sentences(text: Column) -> Column:
    """Sentences in order, trimmed, empty ones removed."""
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def excerpt(text: Column, size: int = 240) -> Column:
    """First ``size`` characters, with ``...`` only when something was cut."""
    cut = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(cut, F.lit("..."))).otherwise(cut)


def preview(text: Column, size: int = 100) -> Column:
    """Dashboard preview: the prefix, always followed by ``...``."""
    return F.concat(F.substring(F.coalesce(text, F.lit("")), 1, size), F.lit("..."))


def iso_timestamp(ts: Column) -> Column:
    """ISO form; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
