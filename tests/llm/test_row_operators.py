import hashlib
import json
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import helpers_llm as h  # noqa: E402

from riskloom.llm import bpe_index, licence_scan, pii_anchors, quality_ledger, token_files  # noqa: E402

from riskloom.session import scratch_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(pii_anchors.BASE_PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and pii_anchors._luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if good():
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["a", "@", ".", "b-c", " ", "1", "255", "256.", "1.2.3.4", "+1 (2", "4111111111111111", "4111 1111-1111 1111", "--", "é", "\U0001f600", "(555)", "x@y.zz", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in pii_anchors.find(text) if k in pii_anchors.BASE_KINDS)
        assert base == plain_spans(text), text


def test_added_spans_and_redaction():
    text = "iban DE89 3704 0044 0532 0130 00, ssn: 123-45-6789, ftp://bob:pw@h.example/x, m@example.org"
    kinds = [k for *_, k in pii_anchors.find(text)]
    assert kinds.count("account") == 2 and "login" in kinds and "email" in kinds
    assert "DE89" not in pii_anchors.redact(text) and "bob" not in pii_anchors.redact(text) and pii_anchors.redact("plain") == "plain"


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("a" * 1_000_000 + "@", "1" * 1_000_000, "1." * 400_000, "+" * 500_000, "@" * 300_000):
        pii_anchors.find(text)
    assert time.time() - start < 20


def test_personal_data_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a@b.cc and 10.0.0.1", "s"), (3, "a@b.cc and 10.0.0.1", "s")]
    got = pii_anchors.personal_data(h.frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [0, 0, 1, 1] and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:19").hexdigest()
    clean = pii_anchors.redacted_documents(h.frame(spark, rows))
    assert clean.columns == h.frame(spark, rows).columns
    assert [(r.text, r.n_chars) for r in clean.orderBy("doc_id").collect()][2] == ("[EMAIL] and [IP]", 16)
    assert pii_anchors.personal_data(h.frame(spark, [])).count() == 0


def odd_texts():
    rng = np.random.default_rng(1)
    pool = np.r_[32:127, 32:127, 160:600, 0x370:0x400, 0x4E00:0x4E40, 0x1100:0x1200, 0x300:0x330]
    return ["", "   ", "<|endoftext|> hi<|startoftext|>x", "a" * 50, "ΣΑΣ İstanbul ǅ", "don't WE'LL 's", "a\u0085b\u001cc", "x" * 3000, "\x00\x01",
            *("".join(map(chr, rng.choice(pool, int(rng.integers(1, 90))))) for _ in range(200)), *(t or "" for _, t, _ in h.documents())]


def test_encoder_equals_the_library():
    tokenizer = library()
    texts = odd_texts()
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    vocab = bpe_index.vocabulary(PATH)
    for chunks in (bpe_index.Chunks(vocab, vocab.coded, 2), ) * 2:  # again from what it remembers
        (ids, at), (told, to) = chunks.gathered(pa.array(texts, pa.large_string()))
        for k, (text, e) in enumerate(zip(texts, want, strict=True)):
            assert bytes(ids[at[k]:at[k + 1]]) == np.array(e.ids, "<u4").tobytes(), text
            assert bytes(told[to[k]:max(to[k], to[k + 1] - 1)]).decode() == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_what_is_remembered_stays_bounded_and_right(monkeypatch):
    monkeypatch.setattr(bpe_index, "REMEMBERED", 40)
    vocab, tokenizer = bpe_index.vocabulary(PATH), library()
    chunks = bpe_index.Chunks(vocab, vocab.coded, 2)
    for text in odd_texts() * 2:
        (ids, at), _ = chunks.gathered(pa.array([text], pa.large_string()))
        assert bytes(ids[at[0]:at[1]]) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(chunks.older) <= 40 and len(chunks.recent) <= max(80, len(text))


def test_two_vocabularies_in_one_worker(spark, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:300]
    other = tmp_path / "fewer.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    rows = [(k, "the theatre thereafter, and others", "s") for k in range(8)]
    for path in (PATH, str(other), PATH):
        want = Tokenizer.from_file(path).encode(rows[0][1], add_special_tokens=False).ids + [1]
        target = scratch_path(spark, "two")
        token_files.write_tokens(h.frame(spark, rows), path, target, files=1, by_word=True)
        assert {tuple(r.ids) for r in token_files.read_tokens(spark, target).collect()} == {tuple(want)}


def test_encoding_digests(spark):
    rows = [(1, None, "s"), (2, "Hello, world!", "s"), (2, "Hello, world!", "s")]
    ids = library().encode("Hello, world!", add_special_tokens=False).ids
    got = bpe_index.encoding_digests(h.frame(spark, rows), PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [0, len(ids), len(ids)]
    assert got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe_index.encode_documents(h.frame(spark, []), PATH).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = [(5 * k, t, "s") for k, t in enumerate(odd_texts())]
    random.Random(1).shuffle(rows)
    for by_word in (True, False):
        target = f"file://{tmp_path}/tokens-{by_word}"
        token_files.write_tokens(h.frame(spark, rows), PATH, target, files=5, by_word=by_word)
        tokenizer, start = library(), 0
        index = {r.doc_id: r for r in token_files.token_index(spark, target).collect()}
        for i, t, _ in sorted(rows):
            ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
            assert (index[i].start, index[i].n_tokens) == (start, len(ids))
            assert index[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    plan = token_files.read_tokens(spark, target).where("doc_id < 10").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in plan and "ids:array" not in plan.split("ReadSchema")[1]
    assert token_files.written_and_indexed(h.frame(spark, []), PATH, by_word=True).count() == 0


def plain_quality(text):
    words = h.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if h.WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_policies(spark):
    rng = random.Random(4)
    texts = [None, "", "a b", h.prose(rng, 30), h.prose(rng, 9) + "\n" + "\n".join([h.prose(rng, 9)] * 4), "x %% | " * 30, "é ü # " + h.prose(rng, 40) + "\n\n \n", ("w " * 40).strip()]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    entries = quality_ledger.ledger(h.frame(spark, rows)).withColumn("kept", quality_ledger.verdict())
    for r in entries.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(texts[r.doc_id])
        assert r.kept == (r.failures & quality_ledger.mask("v1") == 0)
    kept = quality_ledger.apply_policy(h.frame(spark, rows))
    assert kept.columns == h.frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in entries.where("kept").collect()) and kept.count() >= 2
    bits = [r.failures for r in entries.collect()]
    for r in quality_ledger.ablation(entries).collect():
        bit, whole = 1 << quality_ledger.RULE_NAMES.index(r.rule), quality_ledger.mask("v1")
        assert (r.n_failed, r.n_alone, r.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b & whole == bit for b in bits), sum(b & whole & ~bit == 0 for b in bits))
    assert quality_ledger.ledger(h.frame(spark, [])).count() == 0


@pytest.mark.parametrize("text, name, least", [
    ("words before\nReleased under the MIT License.\nafter", "mit", 1.0), ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0", 1.0),
    ("Licensed under the Apache License,\nVersion 2.0", "apache-2.0", 1.0), ("this is licensed under the apache license version 2.0 now", "apache-2.0", 0.8),
    ("a licence of no kind at all", None, 0.0), (None, None, 0.0), ("", None, 0.0), ("word", None, 0.0),
])
def test_licences(spark, text, name, least):
    found = licence_scan.scan(h.frame(spark, [(1, text, "s")])).head()
    assert found.license == name and found.dice >= least


def test_template_bigrams_are_distinct():
    for _, notice in licence_scan.TEMPLATES:
        words = re.sub(r"[^\w]+", " ", notice.lower()).split()
        assert len(licence_scan.bigrams(notice)) == len(words) - 1


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:"""
GPL_3_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def in_a_file(name):
    """A whole licence between other lines, each line as a comment."""
    lines = ["Copyright (c) 2020 Some Body and others", "", *next(t for n, t in licence_scan.BODIES if n == name and len(t) > 800).splitlines(), "", "import os of the first kind"]
    return "\n".join(f" * {line}" for line in lines)


WHOLE = [
    *((in_a_file(n), n, 0.95) for n in ("mit", "mit-0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "apache-2.0", "cc0-1.0", "unlicense", "zlib", "mpl-2.0")),
    (MIT_GRANT, "mit", 0.95), (MIT_GRANT.splitlines()[0], "mit", 0.8), ("a\nThe MIT License (MIT)\nb", "mit", 1.0), (GPL_3_HEADER, "gpl-3.0", 0.95),
    (GPL_3_HEADER.replace("version 3", "version 2"), "gpl-2.0", 0.95), (APACHE_HEADER, "apache-2.0", 0.95), (" ".join(APACHE_HEADER.split()), "apache-2.0", 0.95),
    ("some words come first and this tool is released under the MIT License, as most of its parts are, and then it goes on", "mit", 0.8),
    ("words before. " * 9 + "It is licensed under the Apache License, Version 2.0, and more words " + "follow it here " * 9, "apache-2.0", 0.9),
    (f"x {MIT_GRANT[:150]} {'other words here ' * 9} {MIT_GRANT} y", "mit", 0.95), ("\n\n".join(f"part {k} by {k * 'b'} {MIT_GRANT}" for k in range(1, 20)), "mit", 0.95),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0", 1.0),
    ("I read the license of the software, version 2, and all the rights in it are provided without a copy of the source", None, 0.0),
]


def test_whole_licences_and_runs(spark):
    found = licence_scan.scan(h.frame(spark, [(k, text, "s") for k, (text, *_) in enumerate(WHOLE)])).collect()
    assert len(found) == len(WHOLE)
    wrong = [(row, WHOLE[row.doc_id]) for row in found if row.license != WHOLE[row.doc_id][1] or row.dice < WHOLE[row.doc_id][2]]
    assert not wrong, wrong


def test_matches_have_an_anchor():
    """Without the bigrams that hold an anchor, no short template keeps as many as the threshold needs."""
    grams = [licence_scan.bigrams(t) for _, t in licence_scan.TEMPLATES + licence_scan.NOTICES + licence_scan.TITLES + licence_scan.BODIES]
    short = [g for g in grams if len(g) <= licence_scan.SHORT]
    anchors = set(licence_scan._anchors(short, 0.8))
    assert all(3 * sum(not anchors & set(b.split()) for b in g) < 2 * len(g) for g in short)


def test_a_worker_keeps_its_words_from_task_to_task(monkeypatch):
    """A second task asks the library for the new words alone, and has the same ids."""
    import public_tokenizers
    import pyarrow as pa

    from riskloom.llm import token_files as tf

    path = public_tokenizers.path("word_bpe_49k.json")
    asked, library = [], tf._word_coder(path)
    monkeypatch.setattr(tf, "_known", {}, raising=False)
    monkeypatch.setattr(tf, "_word_coder", lambda p: lambda words: (asked.append(sorted(words)), library(words))[1])
    batch = lambda *texts: pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": list(texts)})
    run = lambda b: [r for out in tf._encode_rows(path, True)(iter([b])) for r in out.column("ids").to_pylist()]
    first, second = run(batch("Straße plain \u0130x Über")), run(batch("plain Straße Über new \u0130x"))
    assert asked[-1] == ["new"] and len(asked) == 2
    plain = lambda t: [*tf._tokenizer(path).encode(t, add_special_tokens=False).ids, tf.END_ID]
    assert [first, second] == [[plain("Straße plain \u0130x Über")], [plain("plain Straße Über new \u0130x")]]


def test_token_files_cut_new_chunks_alone(monkeypatch):
    """What a worker has met is neither cut into words nor encoded again, and what it keeps is bounded and right."""
    cut, plain = [], bpe_index.Chunks._cut
    monkeypatch.setattr(token_files, "_known", {})
    monkeypatch.setattr(bpe_index.Chunks, "_cut", lambda self, chunks: (cut.append(chunks.to_pylist()), plain(self, chunks))[1])
    batch = lambda *texts: pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": list(texts)})
    for texts in (("one, two", None, "Ärger!"), ("two three Ärger!", "one,")):
        got = [r for out in token_files._encode_rows(PATH, True)(iter([batch(*texts)])) for r in out.column("ids").to_pylist()]
        assert got == [library().encode(t or "", add_special_tokens=False).ids + [token_files.END_ID] for t in texts]
    assert cut[-1] == ["three"]
    tokenizer, few = library(), token_files.KnownChunks(
        bpe_index.vocabulary(PATH), token_files._word_coder(PATH), lambda chunk: (token_files._ids(chunk, PATH),), 40)
    for text in odd_texts() * 2:
        ((ids, at),) = few.gathered(pa.array([text], pa.large_string()))
        assert bytes(ids[at[0]:at[1]]) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(few.known.known) <= 40 and len(few.known_words.known) <= 40
