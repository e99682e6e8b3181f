"""Words of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and the bytes 9 to 13; all of these are ASCII, so byte runs are
character runs.  Words get 64-bit hashes from a byte table and prefix sums, so the work per text is a few numpy calls
over a block of texts and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Hashing walks a block in pieces of this many bytes.
PIECE_BYTES = 1 << 18

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 & ~3 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n <= 4 * PIECE_BYTES:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Some texts in a row: ``data`` holds their bytes, text i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        inside = ~_GAP[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            begins[edges] = inside[edges]  # a word never goes on into the next text
            ends[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        #: text i has the words ``bounds[i]`` up to ``bounds[i + 1]``
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; equal for equal words everywhere."""
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            origin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, origin + PIECE_BYTES, "right")))
            piece = self.data[origin:self.ends[to - 1]]
            values = _TABLE[_LOWER[piece] if lower else piece]
            values *= _power_table(_BASE, len(piece))[:len(piece)]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            start, end = self.starts[at:to] - origin, self.ends[at:to] - origin
            word = (sums[end] - sums[start]) * _power_table(_INVERSE, len(piece))[start]
            out[at:to] = mix(word + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = to
        return out

    def windows(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside one text, and where each begins."""
        if len(words) < width:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        last = np.repeat(self.bounds[1:], self.counts())[:len(words) - width + 1]
        begin = np.flatnonzero(np.arange(len(words) - width + 1) + width <= last)
        h = words[begin]
        for k in range(1, width):
            h = h * np.uint64(0xFF51AFD7ED558CCD) + words[begin + k]
        return mix(h + np.uint64(width)), begin


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingles of ``width`` lower-cased words.

    With fewer words the whole sequence is one shingle; a text without words has none.
    """
    words = block.hashes(lower=True)
    shingles, begin = block.windows(words, width)
    cut = np.searchsorted(begin, block.bounds)
    for i, n in enumerate(block.counts()):
        if n >= width:
            yield np.unique(shingles[cut[i]:cut[i + 1]])
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words[block.bounds[i]:block.bounds[i + 1]]:
                h = h * np.uint64(0xFF51AFD7ED558CCD) + w
            yield mix(h + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column in order, in blocks of about ``limit`` bytes; null counts as empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(part):
            continue
        part = part.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield Block(data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at], at)
            at = to
