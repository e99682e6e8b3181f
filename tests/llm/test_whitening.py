import math
import random

import numpy as np
import pytest

from riskloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 5) for i, v in vectors], SCHEMA)


def plain(vectors):
    """Rows by plain linear algebra: whitened values up to each component's sign."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (d - len(v)) for _, v in kept]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(v[k] for v in fit) for k in range(d)]
    c = np.array([[n * v[k] - sums[k] for k in range(d)] for v in fit], float) / max(1, n)
    e, q = np.linalg.eigh(c.T @ c / max(1, n))
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    return [(i, n, sum((n * v[k] - sums[k]) ** 2 for k in range(d)), (np.array([n * v[k] - sums[k] for k in range(d)]) / n) @ q / np.sqrt(e)) for (i, _), v in zip(kept, x, strict=True)], e, c.var(axis=0).sum()


@pytest.mark.parametrize("d", [3, 48])
def test_against_eigendecomposition(spark, d):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0] * np.linspace(3, 0.2, d)
    vectors = [(i, (rng.standard_normal(d) @ basis).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(200)] + [(None, vectors[3][1]), (5, None), (6, [float("nan")] * d), (7, [None] * d), (8, [float("inf")] * d), (9, vectors[0][1][:-1]), (9, [])]
    want, values, trace = plain(vectors)
    got = wh.whiten(table(spark, vectors).repartition(5)).collect()
    parts = min(4, d)
    assert len(got) == len(want) * parts and {r.n for r in got} == {want[0][1]}
    assert max(r.identity_error for r in got) < 1e-9
    by = {(r.vec_id, r.component, r.deviation): r for r in got}
    for k in range(parts):
        ours = np.array([by[i, k + 1, dev].whitened for i, _, dev, _ in want])
        theirs = np.array([w[k] for *_, w in want])
        assert np.abs(ours * np.sign(ours @ theirs) - theirs).max() < 1e-9
        assert by[want[0][0], k + 1, want[0][2]].explained == pytest.approx(values[k] / trace, rel=1e-12)


def test_degenerate_tables(spark):
    assert wh.whiten(table(spark, [])).count() == 0
    assert wh.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert wh.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    flat = wh.whiten(table(spark, [(i, [float(i % 7), 1.0, 2.0]) for i in range(20)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 20
    assert flat[0].explained == pytest.approx(1)


def test_entries_beyond_machine_integers(spark):
    rng = random.Random(1)
    got = wh.whiten(table(spark, [(i, [rng.choice((-1e30, 1e30, 3e17)), rng.random()]) for i in range(30)])).collect()
    assert got and all(r.deviation is None and math.isfinite(r.whitened) for r in got)
