import math

import pytest

from riskloom.functions import text as tx
from riskloom.operators import explain, linear

WEIGHTS = [("", 0, 0, 100_000), ("sad", 1, 0, 900_000), ("night", 1, 0, 400_000), ("happy", 0, 1, -800_000), ("day.", 0, 1, -100_000)]
TEXTS = [(1, "Sad night. Happy day. sad sad! Mail me a@b.org"), (2, "happy day. happy"), (3, "  "), (4, None), (5, "plain words only"),
         (6, "sad sad sad"), (7, " ".join(["sad"] * 3000 + ["calm"] * 3000) + ". night")]


@pytest.fixture(scope="module")
def told(spark):
    weights = spark.createDataFrame(WEIGHTS, "term string, pos_df long, neg_df long, weight_micro long")
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, pos string")
    return weights, docs, {r["doc_id"]: r for r in explain.analyze_explained(docs, weights).collect()}


def test_scores_equal_the_linear_scorer(told):
    weights, docs, got = told
    for r in linear.score(docs.where("doc_id not in (1)"), weights, "doc_id").collect():
        assert got[r["doc_id"]]["risk"]["confidence"] == r["confidence"]
        assert got[r["doc_id"]]["risk"]["prediction"] == ("suicide" if r["pred"] else "non-suicide")


def test_words_triggers_and_sentences(told):
    _, _, got = told
    risk = got[1]["risk"]
    words = [(w["text"], round(w["normalized_score"], 6), w["is_important"]) for w in risk["highlighted_words"]]
    low, high = -0.8, 0.9
    scale = lambda s: round((s - low) / (high - low), 6)
    assert [w[0] for w in words] == ["sad", "night.", "happy", "day.", "sad", "sad!", "mail", "me", "[email]"]
    assert words[0][1] == 1.0 and words[2][1] == 0.0 and words[3][1] == scale(-0.1) and words[1][1] == scale(0)
    assert risk["triggers"] == [w[0] for w in words if w[2]] == ["sad", "night.", "sad", "sad!", "mail", "me", "[email]"]  # the cut is the middle value
    assert got[1]["pii_redacted"]["email"] == 1 and got[1]["pos"] == "x"
    best = [(s["sentence"], round(s["score"], 6)) for s in risk["problematic_sentences"]]
    assert best[0] == ("Sad night", round((1 + 0.8 / 1.7) / 2, 6)) and len(best) == 2
    assert best[1] == ("sad sad", round((1 + 0.8 / 1.7) / 2, 6))


def test_texts_without_words_and_of_the_other_class(told):
    _, _, got = told
    assert got[3]["risk"]["highlighted_words"] is None and got[3]["risk"]["problematic_sentences"] is None and got[3]["risk"]["triggers"] == []
    assert got[4]["risk"]["highlighted_words"] is None and got[2]["risk"]["prediction"] == "non-suicide"
    assert got[2]["risk"]["triggers"] == [] and got[2]["risk"]["problematic_sentences"] == []
    assert [w["normalized_score"] for w in got[6]["risk"]["highlighted_words"]] == [1.0] * 3


def test_long_text_is_linear_work(told):
    _, _, got = told
    words = got[7]["risk"]["highlighted_words"]
    assert len(words) == 6001 and sum(w["is_important"] for w in words) == 3000 and len(got[7]["risk"]["triggers"]) == 10
    assert [math.isclose(s["score"], 0.5) for s in got[7]["risk"]["problematic_sentences"]] == [True]


def test_no_word_row_is_shuffled_with_broadcast_weights(spark, told):
    weights, docs, _ = told
    small = explain.F.broadcast(weights)
    plan = explain.with_weighed_words(docs, small, "doc_id")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == final.count("REPARTITION_BY_COL") <= 2, final  # texts only


def test_no_join_key_stands_for_every_text(spark, told):
    weights, docs, _ = told
    terms = linear.term_rows(docs, "doc_id").groupBy("term").count().collect()
    assert "" not in {r["term"] for r in terms}
    assert {r["term"] for r in terms if r["term"].startswith(" ")} == {" 3", " 4"} and tx.WHITESPACE
