import json

import pytest
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import lexicon as lx
from riskloom.operators import corpus, evaluation, splits
from riskloom.sources import exports, readers, tables

TRICKY = 'line one\nline "two", with comma\n'


@pytest.fixture
def feedback(spark):
    rows = [(i, TRICKY + str(i), "LOW", 0.1, lx.RISK_LEVELS[i % 3], None if i % 2 else "n", f"2024-01-01 00:00:0{i}", "pending") for i in range(6)]
    df = spark.createDataFrame(rows, (
        "id long, text string, original_prediction string, original_score double, teacher_correction string, "
        "teacher_notes string, at string, status string"))
    return df.withColumn("created_at", F.col("at").cast("timestamp_ntz")).withColumn(
        "is_correct", F.col("original_prediction") == F.col("teacher_correction")).drop("at")


def test_csv_corpus_with_multiline_texts(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text('text,class\n"first\nline ""q"", x",suicide\nplain,non-suicide\n,suicide\n')
    rows = readers.read_corpus_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('first\nline "q", x', "suicide"), ("plain", "non-suicide"), (None, "suicide")]
    assert readers.read_corpus_csv(spark, str(path)).schema == schemas.CORPUS


def test_malformed_lines_are_skipped_and_kept_aside(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("text,class\ngood,suicide\nbad,suicide,extra,fields\nfine,non-suicide\n")
    assert readers.read_corpus_tolerant(spark, str(path)).count() == 2
    bad = readers.read_quarantine(spark, str(path)).collect()
    assert len(bad) == 1 and "extra" in bad[0][0]


def test_first_existing(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x")
    assert readers.first_existing(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).endswith("b.csv")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "none")])


def test_split_indices(spark, tmp_path, rows):
    path = tmp_path / "split.json"
    path.write_text(json.dumps(dict(total_samples=4, train_size=2, val_size=1, test_size=1, random_seed=42,
                                    train_indices=[0, 3], val_indices=[1], test_indices=[2]), indent=1))
    assert rows(readers.read_split_indices(spark, str(path))) == [("test", 2), ("train", 0), ("train", 3), ("val", 1)]
    assert readers.read_split_sizes(spark, str(path)).first()["random_seed"] == 42


def test_positions_are_dense_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(7).write.parquet(path)
    got = sorted(r["row_id"] for r in readers.parquet_positions(spark.read.parquet(path)).collect())
    assert got == list(range(1000))


@pytest.mark.parametrize("url, expected", [
    ("postgres://h/db", "jdbc:postgresql://h/db"), ("postgresql://h/db", "jdbc:postgresql://h/db"),
    ("jdbc:sqlite:f.db", "jdbc:sqlite:f.db")])
def test_database_urls(url, expected):
    assert readers.normalize_url(url) == expected


def test_csv_export_reads_back(spark, feedback, tmp_path):
    exports.export_feedback(feedback, str(tmp_path / "e"), "csv", is_correct=False)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "e")).collect()
    assert len(back) == 4 and back[0].asDict().keys() == {
        "id", "text", "original_prediction", "original_score", "teacher_correction", "is_correct", "teacher_notes", "created_at", "status"}
    assert {r["text"] for r in back} == {r["text"] for r in feedback.where("not is_correct").collect()}
    with pytest.raises(ValueError):
        exports.export_feedback(feedback, str(tmp_path / "e"), "xml")


def test_csv_rows_are_newest_first_with_empty_notes(feedback):
    rows = exports.csv_rows(feedback).collect()
    assert [r["id"] for r in rows] == [5, 4, 3, 2, 1, 0] and {r["teacher_notes"] for r in rows} == {"", "n"}


def test_jsonl_export_is_nested(spark, feedback, tmp_path):
    exports.export_feedback(feedback, str(tmp_path / "j"), "jsonl", status="pending")
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(lines) == 6 and lines[0]["metadata"].keys() == {"id", "original_score", "teacher_notes", "created_at"}
    assert any(x["metadata"]["teacher_notes"] is None for x in lines)


def test_training_export_has_a_simple_twin(spark, feedback, tmp_path):
    full, simple = exports.export_training(feedback, str(tmp_path / "out.csv"), corrections_only=True)
    assert simple.endswith("out_simple.csv")
    assert spark.read.option("header", True).csv(simple).columns == ["text", "class"]
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(full).count() == 4


def test_correction_batches(spark, feedback, tmp_path):
    root = str(tmp_path / "exports")
    path = exports.export_corrections(feedback, root, 4, "20240101_090000")
    exports.export_corrections(feedback, root, 4, "20240101_090000")  # again: same place
    listed = exports.list_exports(spark, root).collect()
    assert [r["filename"] for r in listed] == ["corrections_4samples_20240101_090000.csv"] and listed[0]["size_bytes"] > 0
    assert exports.read_export(spark, root, listed[0]["filename"]).count() == 4
    sidecar = {r["class"]: r["n_rows"] for r in spark.read.json(path[:-4] + "_metadata").collect()}
    assert sidecar == {"suicide": 4}
    for name in ("../corrections_1samples_1_1.csv", "corrections_xsamples_1_1.csv", "other.csv"):
        with pytest.raises(ValueError):
            exports.read_export(spark, root, name)


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = spark.createDataFrame([("t", 1, 0.9)], "text string, predicted_class int, confidence double")
    for _ in range(2):
        tables.append(tables.with_content_id(rows, "text"), path, schemas.PREDICTIONS)
    stored = tables.read(spark, path, schemas.PREDICTIONS)
    assert stored.count() == 2 and stored.select("id").distinct().count() == 1
    assert stored.schema.fieldNames() == schemas.PREDICTIONS.fieldNames()


def test_results_document_round_trip(spark, tmp_path):
    counts = spark.createDataFrame(
        [("m", "test", 11401, 203, 271, 11333), ("m", "val", 11385, 219, 265, 11338)],
        "model string, split string, tn long, fp long, fn long, tp long")
    metrics = evaluation.metrics(counts, ["model", "split"])
    document = exports.results_document(metrics, "linear", 42, {"learning_rate": 2e-5, "epochs": 3})
    document.coalesce(1).write.json(str(tmp_path / "r"))
    back = readers.read_results_document(spark, str(tmp_path / "r")).first()
    assert back["test_results"]["eval_fnr"] == pytest.approx(0.02335401585660117)
    assert back["val_results"]["eval_true_positives"] == 11338 and back["training_config"]["epochs"] == 3


def test_metrics_table_appends(spark, tmp_path):
    frame = spark.createDataFrame([(0.9,)], "f1 double")
    for run in ("r1", "r2"):
        tables.append_metrics(frame, str(tmp_path / "m"), {"run": run})
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_feature_cache_is_keyed_by_content(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("n", F.length("text"))

    one = spark.createDataFrame([(1, "aa"), (2, "b")], "id int, text string")
    other = spark.createDataFrame([(1, "aa"), (2, "c")], "id int, text string")  # same size, other content
    for df in (one, one.repartition(3), other):
        got = tables.feature_cache(df, build, str(tmp_path), "words-256-train", "id", "text")
        assert {r["text"] for r in got.collect()} == {r["text"] for r in df.collect()}
    assert len(calls) == 2


def test_day_partitions_prune(spark, tmp_path):
    df = spark.sql("select id, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) timestamp from range(10)")
    tables.write_partitioned_by_day(df, str(tmp_path / "v"))
    picked = spark.read.parquet(str(tmp_path / "v")).where("day >= '2024-01-08'")
    assert picked.count() == 3 and "PartitionFilters: [isnotnull(day" in picked._jdf.queryExecution().executedPlan().toString()


def test_cleaned_corpus_and_training_set_are_stored(spark, tmp_path):
    dirty = spark.createDataFrame([("a, b", "suicide"), ("c", "odd"), (None, "suicide")], "text string, class string")
    exports.write_csv(corpus.relabel(corpus.drop_incomplete(dirty)), str(tmp_path / "mapped"))
    back = spark.read.schema("text string, class int").option("header", True).csv(str(tmp_path / "mapped")).collect()
    assert [tuple(r) for r in back] == [("a, b", 1)]
    splits.combine(dirty, dirty.limit(1), 3).write.parquet(str(tmp_path / "combined"))
    assert spark.read.parquet(str(tmp_path / "combined")).count() == 5


def test_stored_feedback_and_contacts_conform(spark, tmp_path):
    review = spark.createDataFrame([(1, 10, 1, "correction")], "id long, prediction_id long, correct_class int, feedback_type string")
    contact = spark.createDataFrame([(1, "a@b.org", "s", "m", "bug", "new")], (
        "id long, email string, subject string, message string, submission_type string, status string"))
    for name, df, schema in (("reviews", review, schemas.REVIEWS), ("contacts", contact, schemas.CONTACTS)):
        tables.append(df, str(tmp_path / name), schema)
        assert tables.read(spark, str(tmp_path / name), schema).first()["id"] == 1
