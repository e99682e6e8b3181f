"""Personal data by anchor expansion: an automaton finds anchors, local parsers read around them.

One Aho-Corasick pass over a text finds at-signs, address schemes, plus signs, digits and identifier cues.  At each anchor
a parser looks at the few characters around it, so the work grows with the text and not with its square, whatever the
text holds.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are exactly the leftmost non-overlapping matches of fixed patterns
(``BASE_PATTERNS``), checked and not retried.  Further kinds: ``account``, an account or identity number after a cue, and
``login``, an address with scheme whose authority part carries a user name.

Edge cases: a null text counts as empty; positions are code points, end exclusive; rows that repeat a ``doc_id`` are
separate rows; other columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
#: What the base kinds are.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "kontonummer", "cuenta", "compte")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
#: Texts handled at a time.
TEXTS = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[ :#.=]|no\b|number\b|nr\b){0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]+(?::[^\s@/]{1,100})?@[A-Za-z0-9.-]+(?::[0-9]+)?")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    for scheme in SCHEMES:
        found.add_word(scheme, "scheme")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, "cue")
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def _luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data, by start and then by the order of KINDS."""
    out: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    last_digit = -2
    for at, anchor in _AUTOMATON.iter(text):
        if anchor == "digit":
            first, last_digit = at != last_digit + 1, at
            if at >= free["card"]:
                if m := _CARD.match(text, at):
                    free["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        out.append((at, m.end(), "card"))
            if first and at >= free["ip"]:
                if m := _IP.match(text, at):
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out.append((at, m.end(), "ip"))
        elif anchor == "at":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                out.append((start, m.end(), "email"))
        elif anchor == "plus":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((at, m.end(), "phone"))
        elif anchor == "cue":
            if at >= free["account"] and (m := _ACCOUNT.match(text, at + 1)):
                value = m[1].replace(" ", "").replace("-", "")
                if not value[0].isalpha() or _iban(value):
                    free["account"] = m.end()
                    out.append((m.start(1), m.end(1), "account"))
        elif at >= free["login"] and (m := _LOGIN.match(text, at + 1)):
            free["login"] = m.end()
            out.append((at + 1, m.end(), "login"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first is named."""
    parts, done = [], 0
    spans = find(text)
    for k, (start, end, kind) in enumerate(spans):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
            done = end
        elif end > done:
            done = end
    return "".join([*parts, text[done:]]) if spans else text


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for at in range(0, len(column), TEXTS):
        yield [t or "" for t in column.slice(at, TEXTS).to_pylist()]


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
    for batch in batches:
        at = 0
        for texts in _texts(batch.column("text")):
            found = [find(t) for t in texts]
            base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            ids = batch.column("doc_id").slice(at, len(texts)).cast(pa.int64())
            at += len(texts)
            yield pa.RecordBatch.from_arrays([ids, *counts, pa.array([hashlib.sha256(_digest(s).encode()).hexdigest() for s in base], pa.string()),
                                              pa.array(list(map(_digest, found)), pa.string())], names)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document the counts of base kinds, a digest of their spans, and all spans; one narrow pass."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return texts.mapInArrow(_span_rows, f"doc_id long, {counts}, base_sha256 string, spans string")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for start in range(0, batch.num_rows, TEXTS):
            part = batch.slice(start, TEXTS)
            clean = [None if t is None else redact(t) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The rows with personal data in ``text`` replaced; ``n_chars``, where there is one, is counted anew."""
    out = docs.mapInArrow(_redacted, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
