import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers_llm as h  # noqa: E402

from riskloom.llm import ngram_jaccard, source_mix  # noqa: E402
from riskloom.llm.wordhash import blocks, shingle_sets  # noqa: E402


def test_shingle_sets_have_the_sizes_and_overlaps_of_plain_sets():
    texts = [t for _, t, _ in h.documents()] + ["x" * 700_000 + " y", "a b c\x0bd", "a " * 300_000]
    found = [s for limit in (64, 1 << 20) for b in blocks(pa.array(texts), limit) for s in shingle_sets(b, 5)]
    plain = [h.shingles(t) for t in texts]
    for half in (found[:len(texts)], found[len(texts):]):
        assert list(map(len, half)) == list(map(len, plain))
    for i in range(0, 60):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(plain[i] & plain[j])


def test_components_equal_brute_force(spark):
    rows = h.documents()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similarity_components(h.frame(spark, rows)).collect()}
    assert got == h.components(rows)


def test_one_large_near_group_and_blocks(spark, monkeypatch):
    """Copies with independent changes: pairs on both sides of the threshold, more rows than a block holds."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 16)
    rng = random.Random(1)
    base = h.prose(rng, 90).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = h.prose(rng, 1)
        rows.append((i, " ".join(copy), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similarity_components(h.frame(spark, rows)).collect()}
    assert got == h.components(rows)


@pytest.mark.parametrize("limit", [0, 1000])
def test_one_of_each_group_stays(spark, limit):
    rows = h.documents(seed=8, groups=5)
    rows += [rows[0], (None, "no id at all", "s1")]
    kept = ngram_jaccard.one_of_each_group(h.frame(spark, rows), broadcast_ids=limit)
    want = sorted({c for i, (_, c) in h.components(rows[:-2]).items()})
    assert kept.columns == h.frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_join_of_an_empty_table(spark):
    assert ngram_jaccard.similarity_components(h.frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed, most", [(1, 100_000), (2, 100_000), (1, 1)])
def test_mix_equals_plain_version(spark, monkeypatch, seed, most):
    monkeypatch.setattr(source_mix, "MOST_SOURCES", most)  # broadcast or salted
    rows = h.documents(seed)
    taken, target = h.mix(rows)
    source = {i: s for i, _, s in rows}
    for r in source_mix.mix(h.frame(spark, rows)).collect():
        assert r.taken == taken[r.doc_id] and r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[source[r.doc_id]])


def test_mix_meets_targets_with_repeated_rows_and_hot_source(spark):
    rng = random.Random(3)
    rows = [(i, h.prose(rng, rng.randint(1, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(300)]
    rows += rows[:20]
    got = source_mix.mix(h.frame(spark, rows)).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 2 for r in got)


def test_mixed_documents_repeat_whole_rows(spark):
    rows = h.documents(4)
    taken, _ = h.mix(rows)
    frame = h.frame(spark, rows)
    out = source_mix.mixed_documents(frame)
    assert out.columns == frame.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, t, _ in rows:
        n = h.sizes(t)
        assert times.get(i, 0) == (int(taken[i] / n + 0.5) if n else 0)


def test_mixing_moves_no_text(spark):
    plan = source_mix.mixed_documents(h.frame(spark, h.documents(4)))._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan


def test_mix_of_empty_tables(spark):
    assert source_mix.mix(h.frame(spark, [])).count() == 0
    assert [r.taken for r in source_mix.mix(h.frame(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]
