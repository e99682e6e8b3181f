import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import corpus, profile, ranking, retraining, splits


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(
        [(1, "a", "suicide"), (2, None, "suicide"), (3, "c", None), (4, "d", "other"), (5, "e", "non-suicide")],
        "id int, text string, class string")


def test_clean_drops_nulls_then_unknown_labels(dirty, rows):
    assert rows(corpus.clean(dirty)) == [("a", "suicide", 1), ("e", "non-suicide", 0)]
    assert rows(corpus.map_labels(corpus.drop_incomplete(dirty)), "id", "label") == [(1, 1), (5, 0)]


def test_unmapped_labels(dirty, rows):
    assert rows(corpus.unmapped_labels(dirty)) == [("other", 1), (None, 1)]


def test_strict_labels_fail(dirty, rows):
    good = dirty.where("class in ('suicide', 'non-suicide')")
    assert len(rows(corpus.map_labels_strict(good))) == 3
    with pytest.raises(Exception, match="unmapped label"):
        corpus.map_labels_strict(dirty).collect()


def test_missing_columns(dirty):
    with pytest.raises(ValueError, match="label"):
        corpus.require_columns(dirty, ("text", "label"))


def test_first_copies_with_one_text_a_third_of_all(spark, rows):
    data = [(i, "same" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    df = spark.createDataFrame(data, "id int, text string").repartition(7)
    first = {}
    for i, t in data:
        first.setdefault(t, i)
    assert rows(corpus.first_copies(df, "id"), "id") == sorted(((i,) for i in first.values()), key=str)
    report = corpus.duplicate_report(df).first()
    assert (report["before_rows"], report["after_rows"], report["removed_rows"]) == (600, len(first), 600 - len(first))


def test_empty_reports(spark):
    empty = spark.createDataFrame([], "id int, text string, class string")
    assert tuple(corpus.duplicate_report(empty).first()) == (0, 0, 0)
    assert corpus.quality_report(empty, ["text"]).first()["n_rows"] == 0


def _expected_split(keys, parts, seed=42):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))
    total, upto, out = sum(n for _, n in parts), 0, {}
    start = 0
    for name, n in parts:
        upto += n
        stop = len(order) * upto // total
        out.update({k: name for k in order[start:stop]})
        start = stop
    return out


@pytest.mark.parametrize("parts", [
    splits.SPLIT_80_10_10, splits.SPLIT_90_5_5, splits.SPLIT_70_15_15, splits.SPLIT_90_10])
@pytest.mark.parametrize("n_pos, n_neg", [(1000, 37), (3, 1), (0, 25)])
def test_split_matches_a_full_ranking(spark, monkeypatch, parts, n_pos, n_neg):
    monkeypatch.setattr(ranking, "PREFIX_HEX", 1)  # many rows per hash bucket
    data = [(i, "suicide") for i in range(n_pos)] + [(10_000 + i, "non-suicide") for i in range(n_neg)]
    df = spark.createDataFrame(data, "id long, class string").repartition(5)
    got = {r["id"]: r["split"] for r in splits.stratified_split(df, "id", parts=parts).collect()}
    expected = _expected_split([i for i, c in data if c == "suicide"], parts)
    expected.update(_expected_split([i for i, c in data if c != "suicide"], parts))
    assert got == expected


def test_split_refuses_undeclared_classes(spark):
    df = spark.createDataFrame([(1, "suicide"), (2, "odd")], "id int, class string")
    with pytest.raises(Exception, match="declared classes"):
        splits.stratified_split(df, "id").collect()


def test_split_reads_texts_once_and_does_not_shuffle_them(spark, tmp_path):
    spark.createDataFrame([(1, "suicide", "x")], "id int, class string, text string").write.parquet(str(tmp_path / "c"))
    split = splits.stratified_split(spark.read.parquet(str(tmp_path / "c")), "id")
    plan = split._jdf.queryExecution().sparkPlan().toString()
    schemas = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line]
    assert len(schemas) >= 2 and sum("text" in s for s in schemas) == 1


def test_fraction_and_fixed_sample(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    picked = {r["k"] for r in splits.fraction_sample(df, "k", 0.1).collect()}
    expected = {k for k in range(2000) if int(hashlib.md5(f"42|{k}".encode()).hexdigest()[:8], 16) < 0.1 * 16**8}
    assert picked == expected
    assert splits.fraction_sample(df, "k", 1.0).count() == 2000
    assert splits.fraction_sample(df, "k", 0.0).count() == 0
    assert splits.fixed_sample(df, "k", 10).count() == 10
    assert splits.fixed_sample(df, "k", 5000).count() == 2000


def test_oversample_and_combine(spark, rows):
    a = spark.createDataFrame([("x", "suicide"), (None, "suicide")], "text string, class string")
    b = spark.createDataFrame([("y", "non-suicide")], "text string, class string")
    assert rows(splits.combine(a, b, 3)) == [("x", "suicide")] + [("y", "non-suicide")] * 3
    assert splits.oversample(b, 1).count() == 1


def test_split_first_keeps_copies_on_one_side(spark):
    original = spark.createDataFrame([(i, f"o{i}", "suicide") for i in range(50)], "doc_id long, text string, class string")
    extra = spark.createDataFrame([(i, f"f{i}", "suicide") for i in range(40)], "feedback_id long, text string, class string")
    tagged = retraining.tagged(original, extra)
    clean = retraining.training_set(tagged, 5, split_first=True).groupBy("text").agg(
        F.countDistinct("split").alias("sides"), F.count("*").alias("n")).collect()
    assert all(r["sides"] == 1 for r in clean)
    assert {r["n"] for r in clean} == {1, 5}
    leaky = retraining.training_set(tagged, 5, split_first=False)
    assert leaky.count() == 50 + 200
    assert leaky.groupBy("text").agg(F.countDistinct("split").alias("s")).where("s > 1").count() > 0


def test_class_weights_and_imbalance(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(0,)] * 30, "label int")
    got = {r["label"]: r["weight"] for r in profile.class_weights(df).collect()}
    assert got == {1: 2.0, 0: 40 / 60}
    weighted = {(r["label"], r["weight"]) for r in profile.with_class_weights(df).collect()}
    assert weighted == {(1, 2.0), (0, 40 / 60)}
    one = profile.imbalance(df).first()
    assert (one["imbalance_ratio"], one["use_class_weights"]) == (3.0, True)
    assert profile.imbalance(df.where("label = 0")).first()["imbalance_ratio"] == 0.0


def test_profile(spark):
    data = [("a b c", "suicide"), ("a", "non-suicide"), (" ".join("w" * 200), "suicide"), (" ".join("w" * 300), None)]
    row = profile.corpus_profile(spark.createDataFrame(data, "text string, class string")).first()
    assert (row["n_rows"], row["clean_rows"], row["median_words"], row["mean_words"]) == (4, 3, 101.5, 126.0)
    assert (row["pct_le_128"], row["pct_le_256"]) == (50.0, 75.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_sums_equal_plain_running_totals(spark, seed):
    draw = random.Random(seed)
    data = list({(draw.choice("ab"), round(draw.random() ** 3, 3)): draw.randint(0, 9) for _ in range(500)}.items())
    df = spark.createDataFrame([(g, s, v) for (g, s), v in data], "g string, s double, v long").repartition(6)
    out = ranking.prefix_sums(df, ["g"], [F.col("s")], ["v"], ranking.unit_blocks(F.col("s"), (2, 5)))
    total = {"a": 0, "b": 0}
    expected = {}
    for (g, s), v in sorted(data):
        total[g] += v
        expected[g, s] = total[g]
    assert {(r["g"], r["s"]): r["v_upto"] for r in out.collect()} == expected
