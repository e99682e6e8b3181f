import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import helpers_llm as h  # noqa: E402

from riskloom.llm import block_labeller, toxicity, vector_graph  # noqa: E402

PAGE = ('<html><head><title>{t}</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x -->'
        '<div class="ad">Buy {t}</div><article><h1>{t}</h1><p><b>{p}<br><p>{q} &amp; &lt;more&gt;</p></article><footer>&copy; {t}</footer>')


def labelled(n=400):
    rng = random.Random(6)
    rows, truth = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = h.prose(rng, rng.randint(10, 60)).split()
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(("zzfoul", "zzvile", "zzgrim"))
        rows.append((i, " ".join(words), "s"))
        truth.append((i, 1, int(bad)))
    return rows, truth


def test_toxicity_held_out_accuracy(spark):
    rows, truth = labelled()
    labels = spark.createDataFrame([*truth, (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    extra = [(5000, None, "s"), (5001, "", "s"), rows[0]]
    got = toxicity.toxicity(h.frame(spark, rows + extra), labels).collect()
    want = {i: y for i, _, y in truth}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == len(rows) + 3
    assert toxicity.toxicity(h.frame(spark, []), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(h.frame(spark, rows[:3]), labels.limit(0)).collect()} == {0.0}


def test_held_out_labels_are_never_read(spark):
    rows, truth = labelled(120)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in truth]
    schema = "doc_id long, quality int, toxic int"
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(h.frame(spark, rows), spark.createDataFrame(t, schema)).collect()} for t in (truth, turned))
    assert one == two


def test_weights_are_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.unique(np.append(rng.integers(10, 1 << toxicity.BITS, 40), 3 if i % 4 == 0 else 4)).astype(np.int32), int(i % 4 == 0)) for i in range(600)]
    at, w, _ = toxicity.fit(rows)
    assert len(at) < 200 and w[list(at).index(3)] > 1


def test_pages(spark):
    rng = random.Random(9)
    parts = [(h.prose(rng, 5), h.prose(rng, 40), h.prose(rng, 30)) for _ in range(40)]
    rows = [(i, f"u{i}", PAGE.format(t=t, p=p, q=q), "x") for i, (t, p, q) in enumerate(parts)]
    rows += [(100, "n", None, "x"), (101, None, "", "x"), (102, "s", "<p>" * 3000 + "</div>" * 50, "x"), (103, "b", '<script>never closed', "x"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = block_labeller.extract(pages).orderBy("page_id").collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for i, (t, p, q) in enumerate(parts):
        assert texts[i] == f"{t} {p} {q} & <more>"
    assert texts[100] == texts[101] == texts[103] == "" and all(r.n_chars == len(r.text) for r in got)
    assert block_labeller.extract(pages.limit(0)).count() == 0


def test_labels_reach_markup_that_the_sample_lacks():
    rng = random.Random(10)
    model = block_labeller.fit([PAGE.format(t=h.prose(rng, 4), p=h.prose(rng, 40), q=h.prose(rng, 30)) for _ in range(60)])
    page = ('<body><header><h2>Site</h2></header><main><h1>Head line</h1><p>First <b>bo</b>ld words of the text.</p><aside>See also</aside><p>Second part of the text, '
            'longer than the first.</p></main><section class="comments"><p>Nice post.</p></section><div id="cookie-notice">We use cookies</div><footer>c</footer>')
    assert block_labeller.main_texts(model, [page]) == ["Head line First bold words of the text. Second part of the text, longer than the first."]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    model = block_labeller.Labeller()
    x, mask = rng.standard_normal((5, 3, block_labeller.WIDTH)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = (rng.random((5, 3)) > 0.5).astype(float)
    model.p = {k: v.astype(float) for k, v in model.p.items()}

    def loss():
        z = model.logits(x, mask)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    grad = model.gradient(x, mask, y)
    for name in ("fx", "bh", "fb", "out"):
        at = tuple(int(rng.integers(n)) for n in model.p[name].shape)
        model.p[name][at] += 1e-3
        up = loss()
        model.p[name][at] -= 2e-3
        down = loss()
        model.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grad[name][at]) < 1e-4 + 0.02 * abs(grad[name][at])


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)


def test_search_against_brute_force(spark):
    x = vectors(900)
    x[100:160] = x[100]  # one vector many times
    rows = [(k, v.tolist(), 1, 0.5) for k, v in enumerate(x)]
    rows += [(2000, None, 1, 0.5), (2020, [0.0] * 16, 1, 0.5), (2040, [float("nan")] * 16, 1, 0.5), (2060, [None] * 16, 1, 0.5), (2080, [1.0], 1, 0.5), rows[0], rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, score double")
    got = {}
    for r in vector_graph.nearest(frame, shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 900, 20):
        exact = x.astype(float) @ x[q].astype(float)
        want = sorted((k for k in range(900) if k != q), key=lambda k: (-exact[k], k))[:20]
        found = sorted(got.pop(q))
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - exact[v]) < 1e-9 for _, v, s in found) and [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(want))
    assert not got and hit / (45 * 20) >= 0.9


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_graph.nearest(spark.createDataFrame([], schema)).count() == 0
    assert vector_graph.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    got = vector_graph.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [2.0, 1.0])], schema)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 7), (0, 2, 20), (20, 1, 7), (20, 2, 0)]
