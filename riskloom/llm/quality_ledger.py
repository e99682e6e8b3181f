"""Quality rules as a ledger: every rule is evaluated once, policies and ablations only read the stored bits.

``measure`` reads each text once and returns its counts; ``ledger`` adds ``failures``, one bit per rule; ``verdict``
applies a versioned policy (a mask of rules) to the bits; ``ablation`` tells for a policy how many documents each rule
alone turns away, from counts per distinct bit pattern.

Edge cases: a null or blank text has no words and all counts are 0; white space is the space and the characters 9 to 13;
rows that repeat a ``doc_id`` are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.wordhash import Block, blocks, mix

WINDOW = 8
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in _MEASURES)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _rules() -> dict[str, Column]:
    """Each rule is true where a document fails it; a rule's bit is its place in this list, so only append."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "short_or_long_words": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "some_symbols": 10 * c("n_symbols") > c("n_words"),
        "some_repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


RULE_NAMES = ("few_words", "repeated_windows", "short_or_long_words", "symbols", "repeated_lines", "some_symbols", "some_repeated_lines")
#: Policies by version; a document is kept if it fails none of the rules named.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_or_long_words", "symbols", "repeated_lines"),
    "strict": RULE_NAMES,
}


def mask(policy: str) -> int:
    return sum(1 << RULE_NAMES.index(name) for name in POLICIES[policy])


def _repeat_words(block: Block) -> np.ndarray:
    """Words of each text that lie in a window that occurs at least twice in it."""
    words = block.hashes(lower=False)
    windows, begin = block.windows(words, WINDOW)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(windows):
        owner = np.searchsorted(block.bounds, begin, "right").astype(np.uint64)
        keys = mix(windows ^ mix(owner + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(keys), bool)
        again[1:] |= same
        again[:-1] |= same
        at = begin[order[again]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return inside[block.bounds[1:]] - inside[block.bounds[:-1]]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for block in blocks(batch.column("text")):
            n_words = block.counts()
            letters = (block.data & 0xC0) != 0x80
            gaps = (block.data == 32) | ((block.data >= 9) & (block.data <= 13))
            lines, repeated = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            raw = block.data.tobytes()
            for i, (a, b) in enumerate(zip(block.offsets, block.offsets[1:], strict=False)):
                filled = [x for x in raw[a:b].split(b"\n") if x.strip()]
                lines[i], repeated[i] = len(filled), len(filled) - len(set(filled))
            ids = batch.column("doc_id").slice(at, len(block)).cast(pa.int64())
            at += len(block)
            counts = (n_words, _per_text(letters & ~gaps, block.offsets), _per_text(_SYMBOL[block.data], block.offsets),
                      repeated, lines, _repeat_words(block))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts)], schema=_SCHEMA)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts every rule is built on; one narrow pass over the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_measure, ", ".join(f"{f.name} long" for f in _SCHEMA))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with ``failures``: bit k is set if the document fails rule k."""
    return measure(docs).withColumn("failures", _bits())


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for k, failed in enumerate(_rules().values()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(0).cast("long"))
    return bits


def verdict(policy: str = "v1") -> Column:
    """True for a ledger row that fails no rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it turns away, and that stay without it."""
    names = POLICIES[policy]
    whole = mask(policy)
    patterns = entries.groupBy("failures").agg(F.count("*").alias("rows"))  # at most two to the number of rules

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    def failing(bits: int) -> Column:
        return F.col("failures").bitwiseAND(F.lit(bits).cast("long"))

    sums = []
    for name in names:
        bit = 1 << RULE_NAMES.index(name)
        sums.append(F.struct(F.lit(name).alias("rule"), total(failing(bit) != 0).alias("n_failed"), total(failing(whole) == bit).alias("n_alone"),
                             total(failing(whole & ~bit) == 0).alias("n_kept_without")))
    return patterns.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def apply_policy(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns.

    The rules are evaluated beside the row itself, so no text is shuffled or joined.
    """
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(m, T.LongType()) for m in _MEASURES)])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    measured = packed.mapInArrow(_measure_beside, schema)
    return measured.withColumn("failures", _bits()).where(verdict(policy)).select("row.*")


def _measure_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("row").field("text")], ["doc_id", "text"])
        at = 0
        for part in _measure([plain]):
            row = batch.column("row").slice(at, part.num_rows)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays([row, *part.columns[1:]], ["row", *_MEASURES])
