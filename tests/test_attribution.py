"""Attribution against straightforward Python on random documents."""

import math
import random
import statistics

import pytest

from riskloom.operators import attribution, linear


def _interpolated(values, share):
    ordered = sorted(values)
    at = (len(ordered) - 1) * share
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def _normalized(scores):
    low, high = min(scores), max(scores)
    return [(s - low) / (high - low) if high > low else 1.0 for s in scores]


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(7)
    vocabulary = ["calm", "sad", "bad", "day", "night", "end.", "stop!", "why?", "x.y", "fine"]
    out = {}
    for d in range(30):
        out[d] = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 40)))
    out[30], out[31] = "same same same", "one"
    return out


@pytest.fixture(scope="module")
def scores():
    draw = random.Random(8)
    return {w: draw.randint(-9, 9) / 8 for w in ["calm", "sad", "bad", "day", "night", "end.", "stop!", "why?", "x.y", "fine", "same", "one"]}


@pytest.fixture(scope="module")
def frames(spark, docs, scores):
    texts = spark.createDataFrame([(d, t, 1 if d % 4 else 0) for d, t in docs.items()], "doc_id long, text string, pred int")
    weights = spark.createDataFrame([(w, int(s * 1e6)) for w, s in scores.items()], "term string, weight_micro long")
    return texts, weights


def test_words_and_normalisation(frames, docs, scores):
    texts, weights = frames
    words = linear.word_scores(texts, weights, "doc_id")
    marked = attribution.mark_important(attribution.normalize(words))
    got = {}
    for r in marked.orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["word"], r["normalized_score"], r["is_important"]))
    for d, t in docs.items():
        raw = [scores[w] for w in t.split()]
        norm = _normalized(raw)
        cut = _interpolated(norm, 0.75)
        assert [w for w, _, _ in got[d]] == t.split()
        assert [n for _, n, _ in got[d]] == pytest.approx(norm)
        assert [i for _, _, i in got[d]] == [n >= cut for n in norm]


def test_triggers_and_top_words(frames, docs, scores):
    texts, weights = frames
    norm = attribution.normalize(linear.word_scores(texts, weights, "doc_id"))
    marked = attribution.mark_important(norm).join(texts.select("doc_id", "pred"), "doc_id")
    triggers, top = {}, {}
    for r in attribution.trigger_words(marked).orderBy("rank").collect():
        triggers.setdefault(r["doc_id"], []).append(r["word"])
    for r in attribution.top_words(norm).orderBy("rank").collect():
        top.setdefault(r["doc_id"], []).append(r["word"])
    for d, t in docs.items():
        values = _normalized([scores[w] for w in t.split()])
        cut = _interpolated(values, 0.75)
        important = [w for w, n in zip(t.split(), values) if n >= cut][:10]
        assert triggers.get(d, []) == (important if d % 4 else [])
        ranked = sorted(range(len(values)), key=lambda i: (-values[i], i))[:10]
        assert top[d] == [t.split()[i] for i in ranked]


def _worst(t, values):
    import re

    at, found = 0, []
    for number, sentence in enumerate(s.strip() for s in re.split(r"[.!?]+", t) if s.strip()):
        mine = values[at: at + len(sentence.split())]
        at += len(mine)
        mean = sum(mine) / len(mine) if mine else 0.0
        if round(mean, 9) >= 0.5:
            found.append((-round(mean, 9), number, sentence))
    return [s for _, _, s in sorted(found)[:3]]


@pytest.mark.parametrize("joined", [True, False])
def test_problematic_sentences(frames, docs, scores, joined):
    texts, weights = frames
    if joined:
        norm = attribution.normalize(linear.word_scores(texts, weights, "doc_id"))
        chosen = attribution.problematic_sentences(attribution.sentence_scores(texts, norm))
    else:
        norm = attribution.normalize(linear.word_scores(texts, weights, "doc_id", sentences=True))
        positive = norm.join(texts.where("pred = 1").select("doc_id"), "doc_id", "left_semi")
        chosen = attribution.with_sentence_text(
            attribution.problematic_sentences(attribution.sentence_means(positive)), texts)
    got = {}
    for r in chosen.orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    for d, t in docs.items():
        expected = _worst(t, _normalized([scores[w] for w in t.split()])) if d % 4 else []
        assert got.get(d, []) == expected


@pytest.mark.parametrize("block", [None, 3])
def test_merge_pieces(spark, block):
    draw = random.Random(3)
    data, expected = [], {}
    for d in range(20):
        pieces = ["[CLS]"] + [draw.choice(["ab", "##cd", "ef", "##g", "[PAD]"]) for _ in range(30)] + ["[SEP]"]
        words, current, group = [], "", []
        for pos, token in enumerate(pieces):
            s = draw.randint(-8, 8) / 4
            data.append((d, pos, token, s))
            if token.startswith("["):
                continue
            if token.startswith("##"):
                current, group = current + token[2:], group + [s]
            else:
                if current:
                    words.append((current, statistics.fmean(group)))
                current, group = token, [s]
        words.append((current, statistics.fmean(group)))
        expected[d] = words
    merged = attribution.merge_pieces(
        spark.createDataFrame(data, "doc_id long, pos int, token string, score double").repartition(5), block=block)
    got = {}
    for r in merged.orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["word"], r["score"]))
    assert got == expected


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_scores_do_not_depend_on_the_join(spark, frames, limit):
    texts, weights = frames
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {r["doc_id"]: r["z_micro"] for r in linear.score(texts, weights, "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    micro = {r["term"]: r["weight_micro"] for r in weights.collect()}
    assert got == {r["doc_id"]: sum(micro[w] for w in set(r["text"].split())) for r in texts.collect()}


def test_fitted_weights_follow_the_base_rate(spark):
    """The bad word alone makes a text positive, and the intercept is the log odds."""
    rows = [(i, "good day" if i % 5 else "bad day", int(i % 5 == 0)) for i in range(100)]
    data = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weights = linear.fit_weights(data, "doc_id")
    found = {r["term"]: r["weight_micro"] / 1e6 for r in weights.collect()}
    assert found[""] == pytest.approx(math.log(20 / 80), abs=1e-6) and found["bad"] > 3 and abs(found["day"]) < 0.1
    got = {r["doc_id"]: r["pred"] for r in linear.score(data, weights, "doc_id").collect()}
    assert got == {i: y for i, _, y in rows}


def test_scorer_quality_on_the_test_tables(spark):
    from riskloom.plans.testbed import Testbed

    bed = Testbed(spark, "/root/testdata/sf0.01")
    scored = bed.linear_scores.join(bed.table("labels").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert 0.05 <= sum(r["pred"] for r in scored) / len(scored) <= 0.15
    known = [r for r in scored if r["toxic"] is not None]
    assert sum(r["pred"] == r["toxic"] for r in known) / len(known) > 0.95


def test_blank_texts_have_a_score(spark, frames):
    blank = spark.createDataFrame([(1, " "), (2, "unknownword")], "doc_id long, text string")
    got = {r["doc_id"]: (r["z_micro"], r["prob"], r["pred"]) for r in linear.score(blank, frames[1], "doc_id").collect()}
    assert got == {1: (0, 0.5, 0), 2: (0, 0.5, 0)}


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C! ")], "doc_id int, text string")
    got = [tuple(r) for r in attribution.sentence_rows(df).orderBy("sentence_no").collect()]
    assert got == [(1, 0, "A b", 2), (1, 1, "C", 1)]


@pytest.mark.parametrize("head_terms", [0, 5])
def test_rare_terms_weigh_the_same_and_no_word_row_is_shuffled(spark, head_terms):
    """With fewer head terms than the vocabulary has, on keys that repeat and are null, without automatic broadcasts."""
    rows = [(i % 9 if i % 10 else None, f"calm Day w{i % 7} w{i % 3} w{i} unknown{i}. sad calm") for i in range(60)] + [(70, None), (71, " ")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = {"calm": 60, "day": 50, "sad.": 40} | {f"w{i}": 2 if i < 7 else 1 for i in range(50)}
    weights = spark.createDataFrame(
        [("", 0, 0, 100)] + [(w, n, 0, 1000 * n + len(w)) for w, n in known.items()], "term string, pos_df long, neg_df long, weight_micro long")
    micro = {w: 1000 * n + len(w) for w, n in known.items()}
    head, tail = linear.head_and_tail(weights, head_terms)
    assert head.count() <= head_terms and head.count() + tail.count() == len(known)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = linear.word_scores(texts, weights, "doc_id", head_terms=head_terms)
        got = sorted((str(r["doc_id"]), r["pos"], r["word"], round(r["score"] * 1e6)) for r in words.collect())
        summed = {r["doc_id"]: r["z_micro"] for r in linear.score(texts, weights, "doc_id", head_terms=head_terms).collect()}
        final = attribution.normalize(words)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    cut = [(k, (t or "").lower().split()) for k, t in rows]
    assert got == sorted((str(k), p, w, micro.get(w, 0)) for k, ws in cut for p, w in enumerate(ws))
    assert summed == {k: 100 * 1 + sum(micro.get(w, 0) for q, ws in cut if q == k for w in set(ws)) for k, _ in cut}
    rare = final[final.index("Generate posexplode"):].count("SortMergeJoin")
    assert "SortMergeJoin" not in final[:final.index("Generate posexplode")] and rare == 1, final


def _tables(spark, folder):
    """Documents, of which every second one has a label."""
    rows = [(i, f"calm day w{i % 7}. bad w{i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("query", ["x17_token_attribution", "x14_important_words", "x11_problematic_sentences"])
def test_word_rows_meet_their_class_in_the_text(spark, monkeypatch, tmp_path, query):
    """No join or shuffle of word rows, also where texts are dealt to fewer tasks than the session's number."""
    import __spark_entry__
    from riskloom.operators import skew

    monkeypatch.setattr(skew, "dealt", lambda df, key, parts: df.repartition(3, key))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()[query](spark, _tables(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[:plan.index("Generate posexplode")]
    assert "SortMergeJoin" not in above and "Exchange hashpartitioning" not in above, plan


@pytest.mark.parametrize("head_terms", [1, None])
def test_classes_travel_with_the_texts(spark, head_terms):
    """Texts without a class or a key are left out; copies of a key are kept, each with its sentences."""
    rows = [(1, "Bad a. Fine. Bad."), (1, "Bad a. Fine. Bad."), (2, "bad"), (3, "fine"), (None, "bad"), (4, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    weights = spark.createDataFrame([("", 0, 0, 0), ("bad", 9, 0, 7), ("a.", 1, 0, 5)], "term string, pos_df long, neg_df long, weight_micro long")
    classes = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (None, 1)], "doc_id long, pred int")
    words = linear.word_scores(texts, weights, "doc_id", sentences=True, head_terms=head_terms, classes=classes)
    got = sorted((r["doc_id"], r["pos"], r["word"], round(r["score"] * 1e6), r["pred"], r["sentence_no"], r["sentence"]) for r in words.collect())
    one = [(1, 0, "bad", 7, 1, 0, "Bad a"), (1, 1, "a.", 5, 1, 0, None), (1, 2, "fine.", 0, 1, 1, "Fine"), (1, 3, "bad.", 0, 1, 2, "Bad")]
    assert got == sorted([*one, *one, (3, 0, "fine", 0, 0, 0, "fine")])
    means = attribution.sentence_means(attribution.normalize(words.where("pred = 1")), with_text=True)
    assert sorted((r["sentence_no"], r["sentences"]) for r in means.collect()) == [(0, ["Bad a"] * 2), (1, ["Fine"] * 2), (2, ["Bad"] * 2)]


def test_labels_are_broadcast_to_the_texts_up_to_a_bound(spark, monkeypatch, tmp_path):
    """The fit of the weights shuffles terms alone while the labels are few; with more it is a join, with equal weights."""
    from riskloom.plans import testbed

    seen, fitted, folder = [], linear.fit_weights, _tables(spark, tmp_path)
    monkeypatch.setattr(testbed, "_weights", {})
    monkeypatch.setattr(testbed.linear, "fit_weights", lambda rows, key: (seen.append(
        rows._jdf.queryExecution().executedPlan().toString()), fitted(rows, key))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = testbed.Testbed(spark, folder).weights.collect()
        testbed._weights.clear()
        monkeypatch.setattr(testbed, "BROADCAST_LABELS", 10)
        many = testbed.Testbed(spark, folder).weights.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" in seen[1]
    assert sorted(few) == sorted(many)
