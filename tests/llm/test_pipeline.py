import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline  # noqa: E402
import helpers_llm as h  # noqa: E402
from test_row_operators import library, plain_quality  # noqa: E402

from riskloom.llm import pii_anchors  # noqa: E402
from riskloom.session import materialize  # noqa: E402


def plain_run(rows):
    def keeps(text):
        n, chars, symbols, repeated, covered = plain_quality(text)
        lines = len([x for x in (text or "").split("\n") if h.WORD.search(x)])
        return not (n < 20 or 100 * covered > 30 * n or chars < 2 * n or chars > 20 * n or 10 * symbols > 3 * n or 2 * repeated > lines)

    rows = [r for r in rows if keeps(r[1])]
    groups = h.components(rows)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    rows = [(i, pii_anchors.redact(t), s) for i, t, s in rows]
    taken, _ = h.mix(rows)
    tokenizer = library()
    return sorted((i, np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                  for i, t, _ in rows for _ in range(int(taken[i] / h.sizes(t) + 0.5)))


def fixture():
    rows = h.documents(seed=12)
    return [(i, f"{t} mail to a.b@example.org now" if t and i % 4 == 0 else t, s) for i, t, s in rows]


def test_stages_equal_the_plain_version(spark, tmp_path):
    rows = fixture()
    h.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain_run(rows)
    assert len(want) > 5 and got == want


def test_stages_on_an_empty_table(spark):
    docs = h.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = materialize(out, "empty")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
