"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a batch of texts are laid out in one array of symbols.  An index maps each mergeable pair to all its
positions; active ranks are applied in ascending order, all positions of a rank at once, and the lists of the
neighbouring pairs are updated.  A text is then the concatenation of its words' ids.

Vocabulary files are read from the path given; nothing is trained.  The file's own normaliser and splitter are honoured in
the form that word-level vocabularies with word ends use: canonical composition, white space to one space, lower case,
then letter runs, single digits, other runs and the short English endings; special strings are taken out of the text
first.  ``Vocabulary`` refuses files of another form.

Edge cases: a null or empty text has no ids and decodes to the empty text; rows that repeat a ``doc_id`` are separate
rows; other columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are cut into batches of about this many bytes, whose new distinct words are encoded together: a worker needs about
#: fifteen times as much.  ``SMALL`` is for stages that share an executor's memory with much else.
BATCH_CHARS, SMALL_CHARS = 12_000_000, 2_000_000
#: Words whose ids a worker keeps from one batch to the next, in each of two generations (about 200 bytes each).
REMEMBERED, SMALL_REMEMBERED = 300_000, 100_000
#: Fixed value: the splitting pattern of the vocabulary files that are supported.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = regex.compile(r"\s+")
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """A visible letter for every byte: printable ones stand for themselves, the others for 256 and on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class Vocabulary:
    """A vocabulary file and its merges, ready to encode and decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [(p["type"], p.get("pattern", {}).get("Regex")) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splits != [("Split", SPLIT), ("ByteLevel", None)] or spec["decoder"]:
            raise ValueError(f"{path} holds a vocabulary of another form")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.tokens = [named.get(i, "") for i in range(max(named) + 1)]
        self.spaced = [t.encode() + b" " for t in self.tokens]
        letters = _byte_letters()
        self.first = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        pairs, made = [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append(self.vocab[a] << 32 | self.vocab[b])
            made.append(self.vocab[a + b])
        keys, self.made = np.array(pairs, np.int64), np.array(made, np.int64)
        self.left, self.right = keys >> 32, keys & 0xFFFFFFFF
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._split = regex.compile(SPLIT)

    def normalize(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        return (chunk.replace("Σ", "σ") if "Σ" in chunk else chunk).lower()

    def chunks(self, text: str) -> list[str]:
        """The text cut so that each part can be encoded by itself: runs without white space, and special strings.

        Words never hold white space, and composition and case do not reach across it.
        """
        if self._special is not None and any(s in text for s in self.special):
            return [c for k, part in enumerate(self._special.split(text)) for c in ([" " + part] if k % 2 else self.chunks(part))]
        if _ODD.search(text):  # white space to Python only
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk in order; a special string, marked by a leading space, is one word."""
        if chunk[0] == " ":
            return [chunk]
        chunk = self.normalize(chunk)
        return [chunk] if chunk.isalpha() else self._split.findall(chunk)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is no merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words together through one pair occurrence index: their ids in a row, and where each word's ids begin."""
        raw = [w.encode() for w in words]
        lengths = np.array(list(map(len, raw)), np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.first[flat]
        final = ends[lengths > 0] - 1
        symbol[final] = self.last[flat[final]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[final] = -1
        before[ends[:-1][lengths[1:] > 0]] = -1 if n else 0
        if n:
            before[0] = -1
        alive = np.ones(n, bool)
        where: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []
        redo: list[np.ndarray] = []

        def enter(at: np.ndarray, now: int) -> None:
            rank = self._rank(symbol[at], symbol[after[at]])
            hit = rank >= 0
            if not hit.any():
                return
            at, rank = at[hit], rank[hit]
            if (rank <= now).any():  # a pair that should have gone first: its word is done again, pair by pair
                redo.append(at[rank <= now])
            if len(at) == 1:
                groups = [(int(rank[0]), at)]
            else:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = list(zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True))
            for r, positions in groups:
                if r not in where:
                    heapq.heappush(active, r)
                where[r].append(positions)

        enter(np.flatnonzero(after >= 0), -1)
        while active:
            rank = heapq.heappop(active)
            lists = where.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            left, right = self.left[rank], self.right[rank]
            nxt = after[at]
            good = alive[at] & (symbol[at] == left) & (nxt >= 0)
            good &= symbol[nxt] == right
            at, nxt = at[good], nxt[good]
            if left == right and len(at) > 1:  # in a run of equal symbols every other pair, from the left
                at = np.unique(at)
                keep, taken = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep)
                nxt = after[at]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            alive[nxt] = False
            beyond = after[nxt]
            after[at] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            prior = before[at]
            fresh = np.concatenate([prior[prior >= 0], at[linked]])
            if len(fresh):
                enter(np.unique(fresh) if len(fresh) > 1 else fresh, rank)
        kept = np.flatnonzero(alive)
        ids, bounds = symbol[kept].astype("<u4"), np.concatenate([[0], np.searchsorted(kept, ends)])
        if redo:
            parts = np.split(ids, bounds[1:-1])
            for w in set(np.searchsorted(ends, np.concatenate(redo), "right").tolist()):
                parts[w] = np.array(self._plain(raw[w]), "<u4")
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
        return ids, bounds

    def _plain(self, raw: bytes) -> list[int]:
        """One word, one merge at a time: the lowest rank, and of these the leftmost."""
        symbols = [int(self.first[b]) for b in raw[:-1]] + [int(self.last[raw[-1]])]
        while len(symbols) > 1:
            s = np.array(symbols, np.int64)
            ranks = self._rank(s[:-1], s[1:])
            if (ranks < 0).all():
                break
            at = int(np.argmin(np.where(ranks < 0, np.iinfo(np.int64).max, ranks)))
            symbols[at:at + 2] = [int(self.made[ranks[at]])]
        return symbols

    def coded(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each word its ids as little-endian unsigned 32-bit integers, and their strings, each with a space behind it."""
        ids, bounds = self.encode_words(words)
        raw, cut = ids.tobytes(), bounds.tolist()
        names = list(map(self.spaced.__getitem__, ids.tolist()))
        return [(raw[4 * a:4 * b], b"".join(names[a:b])) for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as a vocabulary without decoder is decoded."""
        return " ".join([self.tokens[i] for i in ids])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A column of texts in order, in parts of about ``limit`` bytes; null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield pc.fill_null(column.slice(at, to - at), "").cast(pa.large_string())
        at = to


class Chunks:
    """Texts as arrays of word numbers, and what is known of each word; frequent words are remembered between batches.

    Arrow cuts a batch into chunks and numbers them, cuts the distinct chunks into words and numbers those; new distinct
    words alone go to ``code``, and what they became is gathered by number.  Chunks that Arrow would cut differently (not
    ASCII, with an apostrophe, special strings) are cut one by one, distinct as they are.  ``whole`` codes a chunk that
    has a word which normalisation would change once more.
    """

    def __init__(self, vocab: Vocabulary, code: Callable[[list[str]], list[tuple[bytes, ...]]], kinds: int,
                 whole: Callable[[str], tuple[bytes, ...]] | None = None, remembered: int | None = None) -> None:
        self.vocab, self.code, self.kinds, self.whole = vocab, code, kinds, whole
        self.remembered = remembered or REMEMBERED
        self.recent: dict[str, tuple[bytes, ...]] = {}
        self.older: dict[str, tuple[bytes, ...]] = {}

    def _lists(self, texts: pa.Array) -> pa.Array:
        """The chunks of each text; texts with special strings, or with white space to Python only, are cut one by one."""
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for name in self.vocab.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        return _replaced(pc.utf8_split_whitespace(texts), odd, texts, self.vocab.chunks)

    def _words(self, chunk: str) -> list[str]:
        words = self.vocab.words(chunk) if chunk else []
        if self.whole and words != [chunk] and any(not w.isascii() and self.vocab.normalize(w) != w for w in words):
            return ["\n" + chunk]
        return words

    def _cut(self, chunks: pa.Array) -> pa.Array:
        """The words of each chunk."""
        odd = pc.or_(pc.invert(pc.string_is_ascii(chunks)), pc.match_substring_regex(chunks, "['\\s\x0b\x1c-\x1f]"))
        apart = pc.replace_substring_regex(pc.ascii_lower(chunks), "([^a-z0-9]+|[0-9])", " \\1 ")
        return _replaced(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(apart)), odd, chunks, self._words)

    def _coded(self, words: list[str]) -> dict[str, tuple[bytes, ...]]:
        """What new words become; a leading space marks a special string, a leading line end a whole chunk."""
        plain = [w for w in words if w and w[0] not in " \n"]
        out = dict(zip(plain, self.code(plain), strict=True)) if plain else {}
        for w in words:
            if not w:
                out[w] = (b"",) * self.kinds
            elif w[0] == " ":
                i = self.vocab.special[w[1:]]
                out[w] = (np.array([i], "<u4").tobytes(), self.vocab.spaced[i])[:self.kinds]
            elif w[0] == "\n":
                out[w] = self.whole(w[1:])
        return out

    def _known(self, words: list[str]) -> list[tuple[bytes, ...]]:
        recent, older = self.recent, self.older
        found = [recent.get(w) or older.get(w) for w in words]
        fresh = self._coded([w for w, f in zip(words, found, strict=True) if f is None])
        if fresh:
            found = [fresh[w] if f is None else f for w, f in zip(words, found, strict=True)]
        if len(recent) + len(words) > self.remembered:  # two generations: what came lately stays
            self.recent, self.older = {}, recent if len(recent) <= self.remembered else {}
        self.recent.update(zip(words, found, strict=True))
        return found

    def gathered(self, texts: pa.Array) -> list[tuple[memoryview, np.ndarray]]:
        """For each thing known of words: all of it in the order of the texts, and where each text begins in it."""
        lists = self._lists(texts)
        numbered = lists.values.dictionary_encode()
        cut = self._cut(numbered.dictionary)
        words = cut.values.dictionary_encode()
        known = self._known(words.dictionary.to_pylist())
        out = []
        for column in zip(*known, strict=True) if known else [()] * self.kinds:
            data, ends = _bytes(pa.array(column, pa.large_binary()).take(words.indices))
            chunks = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.ascontiguousarray(ends[cut.offsets.to_numpy()])), data])
            data, ends = _bytes(chunks.take(numbered.indices))
            out.append((memoryview(data), ends[lists.offsets.to_numpy()]))
        return out


def _bytes(values: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of an array that begins at its buffers' start, and where each value begins."""
    data = values.buffers()[2]
    ends = np.frombuffer(values.buffers()[1], np.int64)[:len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return data if data is not None else pa.py_buffer(b""), ends


def _replaced(lists: pa.Array, odd: pa.Array, values: pa.Array, cut: Callable[[str], list[str]]) -> pa.Array:
    """``lists`` with those of odd values cut by ``cut`` instead."""
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(at):
        return lists
    apart = pa.array([cut(v) for v in values.take(pa.array(at)).to_pylist()], lists.type)
    order = np.arange(len(values))
    order[at] = len(values) + np.arange(len(at))
    return pa.concat_arrays([lists, apart]).take(pa.array(order))


def _digest_rows(path: str, whole: bool, decode: bool):
    names = ["ids", "decoded"] if whole else ["ids_sha256", "decoded_sha256"]
    size, remembered = (SMALL_CHARS, SMALL_REMEMBERED) if whole else (BATCH_CHARS, REMEMBERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        chunks = Chunks(vocab, vocab.coded if decode else lambda new: [c[:1] for c in vocab.coded(new)], 1 + decode, remembered=remembered)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), size):
                (raw, ends), *rest = chunks.gathered(texts)
                counts = np.diff(ends) // 4
                if whole:
                    ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(raw)]).cast(pa.binary())
                else:
                    ids = pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)])
                if rest:
                    (told, to), = rest
                    parts = [told[a:max(a, b - 1)] for a, b in zip(to.tolist(), to[1:].tolist(), strict=False)]  # without the last space
                    decoded = pa.array([bytes(p).decode() if whole else hashlib.sha256(p).hexdigest() for p in parts], pa.string())
                else:
                    decoded = pa.array([""] * len(texts))
                keys = batch.column("doc_id").slice(at, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts), ids, decoded], ["doc_id", "n_tokens", *names])
                at += len(texts)
        pa.default_memory_pool().release_unused()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``, empty unless asked for."""
    return _texts(docs).mapInArrow(_digest_rows(path, True, decode), "doc_id long, n_tokens long, ids binary, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of ids and decoded text, without moving either out of the task."""
    return _texts(docs).mapInArrow(_digest_rows(path, False, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
