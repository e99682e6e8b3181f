import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers_llm as h  # noqa: E402

from riskloom.llm import suffix_dedup as sd  # noqa: E402

SPAN = 200


def plain(texts):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[p:p + SPAN] for r in raws for p in range(len(r) - SPAN + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - SPAN + 1):
            if times[r[p:p + SPAN]] > 1:
                gone[p:p + SPAN] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((gone[:-1] < gone[1:]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def cases(seed=4):
    rng = random.Random(seed)
    passage, second = h.prose(rng, 60), h.prose(rng, 45) + " é ü 漢字"
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 600, "é" * 150, passage, passage[3:], second * 2]
    texts += [h.prose(rng, rng.randint(1, 90)) + passage[rng.randint(0, 30):rng.randint(180, 400)] + h.prose(rng, rng.randint(1, 90)) for _ in range(30)]
    texts += [h.prose(rng, 50) + second + h.prose(rng, 20) + second[40:]] * 3 + [h.prose(rng, 300)] * 2
    texts += ["".join(rng.choice("ab") for _ in range(900))]
    rng.shuffle(texts)
    return texts


def check(spark, texts, parts=3):
    rows = [(i // 2, t, "s") for i, t in enumerate(texts)]  # ids repeat
    got = sd.deduplicate(h.frame(spark, rows).repartition(parts)).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(plain(texts))
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t, _ in rows)


def test_against_plain_version(spark):
    check(spark, cases())


def test_empty_table_and_only_short_texts(spark):
    assert sd.deduplicate(h.frame(spark, [])).count() == 0
    check(spark, ["a", None, "b" * 199])


def test_frequent_anchors_are_salted(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 3)
    rng = random.Random(8)
    passage = h.prose(rng, 50)
    check(spark, [h.prose(rng, 30) + passage + h.prose(rng, 30) for _ in range(40)] + [passage] * 2 + cases())


def test_long_text_is_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(2)
    text = h.prose(rng, 4000)
    long = text + " " + text[5000:9000] + h.prose(rng, 200_000)
    assert len(long) > sd.CHUNK
    (row,) = sd.deduplicate(h.frame(spark, [(1, long, "s")])).collect()
    gone = np.zeros(len(long), bool)
    gone[5000:9000] = gone[len(text) + 1:len(text) + 4001] = True
    kept = "".join(c for c, g in zip(long, gone, strict=True) if not g)
    assert abs(row.n_removed - 8000) <= 8 and row.n_spans == 2
    if row.n_removed == 8000:
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_order_and_leaves(letters):
    rng = random.Random(len(letters))
    text = "".join(rng.choice(letters) for _ in range(1500))
    raw = np.frombuffer((text + text[300:900] + text[:400]).encode(), np.uint8)
    places = np.random.default_rng(1).permutation(len(raw) - SPAN + 1)
    suffix, leaf = sd.deep_shallow(raw, places)
    strings = [raw[p:p + SPAN].tobytes() for p in suffix]
    assert strings == sorted(strings) and sorted(suffix.tolist()) == sorted(places.tolist())
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], leaf, leaf[1:], strict=False))
