import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import feedback as fb
from riskloom.operators import visitors as vs
from riskloom.sources import exports
from riskloom.streaming import common, scoring, stateful, traffic
from riskloom.streaming.monitor import CorrectionMonitor


def _feedback(spark, ids):
    rows = [(i, f"text {i}", "LOW", "HIGH" if i % 2 else "LOW", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in ids]
    df = spark.createDataFrame(rows, "id long, text string, original_prediction string, teacher_correction string, created_at timestamp")
    return fb.with_agreement(df).drop("message")


def _finish(query):
    query.awaitTermination()


def test_scored_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    tasks = spark.createDataFrame(
        [(i, "mail a@b.org, hopeless" if i % 2 else "   " if i % 5 == 0 else "fine") for i in range(40)], "task_id long, text string")
    tasks.repartition(4).write.parquet(source)
    stream = common.parquet_stream(spark, source, tasks.schema, files_per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        _finish(scoring.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    batch = scoring.score_stream(tasks)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(got.columns).collect()))
    assert scoring.result_of(spark, str(tmp_path / "out"), 1).first()["risk"]["risk_level"] == "MEDIUM"
    assert scoring.result_of(spark, str(tmp_path / "out"), 999).count() == 0


def test_resent_tasks_count_once(spark, tmp_path):
    rows = [(i % 5, "t", dt.datetime(2024, 1, 1, 0, i)) for i in range(20)]
    tasks = spark.createDataFrame(rows, "task_id long, text string, submitted_at timestamp")
    tasks.write.parquet(str(tmp_path / "in"))
    stream = scoring.drop_resent(common.parquet_stream(spark, str(tmp_path / "in"), tasks.schema))
    _finish(scoring.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


@pytest.mark.parametrize("mode, sizes", [("full", [60, 80]), ("delta", [60, 20])])
def test_monitor_exports_when_due_and_only_then(spark, tmp_path, mode, sizes):
    monitor = CorrectionMonitor(spark, str(tmp_path), 50, mode)
    monitor.handle(_feedback(spark, range(0, 80)), 0)      # 40 corrections: too few
    assert monitor.exported_batches().count() == 0
    monitor.handle(_feedback(spark, range(80, 120)), 1)    # 60: export
    monitor.handle(_feedback(spark, range(120, 140, 2)), 2)  # no new correction: nothing
    monitor.handle(_feedback(spark, range(140, 180)), 3)   # 80: export
    done = monitor.exported_batches().orderBy("batch_id").collect()
    assert [(r["batch_id"], r["last_export_count"]) for r in done] == [(1, 60), (3, 80)]
    root = f"{tmp_path}/exports"
    assert [exports.read_export(spark, root, r["exported"].rsplit("/", 1)[1]).count() for r in done] == sizes


def test_monitor_replay_changes_nothing(spark, tmp_path):
    monitor = CorrectionMonitor(spark, str(tmp_path), 10)
    monitor.handle(_feedback(spark, range(0, 40)), 0)
    monitor.handle(_feedback(spark, range(40, 60)), 1)
    before = sorted(map(str, monitor._state_rows().collect()))
    # a fresh process is given the last batch once more
    CorrectionMonitor(spark, str(tmp_path), 10).handle(_feedback(spark, range(40, 60)), 1)
    assert sorted(map(str, monitor._state_rows().collect())) == before
    assert exports.list_exports(spark, f"{tmp_path}/exports").count() == 2


def test_monitor_as_a_stream_survives_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    _feedback(spark, range(0, 120)).coalesce(1).write.parquet(source)
    stream = common.parquet_stream(spark, source, _feedback(spark, [1]).schema)
    _finish(CorrectionMonitor(spark, str(tmp_path / "m")).start(stream))
    _finish(CorrectionMonitor(spark, str(tmp_path / "m")).start(stream))
    _feedback(spark, range(120, 160)).coalesce(1).write.mode("append").parquet(source)
    _finish(CorrectionMonitor(spark, str(tmp_path / "m")).start(stream))
    counts = [r["last_export_count"] for r in CorrectionMonitor(spark, str(tmp_path / "m")).exported_batches().orderBy("batch_id").collect()]
    assert counts == [60, 80]


def test_monitor_refuses_unknown_modes(spark, tmp_path):
    with pytest.raises(ValueError):
        CorrectionMonitor(spark, str(tmp_path), mode="some")


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(i, f"10.0.0.{i % 3}", "/a" if i % 2 else "/b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, ip_address string, path string, timestamp timestamp")


def test_dashboards_equal_batch(spark, tmp_path, visits):
    visits.repartition(3).write.parquet(str(tmp_path / "v"))
    stream = common.parquet_stream(spark, str(tmp_path / "v"), visits.schema, files_per_trigger=1)
    _finish(traffic.traffic_dashboard(stream, str(tmp_path / "t"), str(tmp_path / "cp"), every=None))
    got = sorted(map(tuple, common.newest(spark, str(tmp_path / "t"), traffic.TRAFFIC_KEYS).select("day", "path", "n_visits").collect()))
    expected = sorted(map(tuple, visits.groupBy(F.date_format("timestamp", "yyyy-MM-dd"), "path").count().collect()))
    assert got == expected

    feedback = _feedback(spark, range(30))
    feedback.repartition(3).write.parquet(str(tmp_path / "f"))
    stream = common.parquet_stream(spark, str(tmp_path / "f"), feedback.schema, files_per_trigger=1)
    _finish(traffic.feedback_dashboard(stream, str(tmp_path / "d"), str(tmp_path / "cp2"), every=None))
    row = common.newest(spark, str(tmp_path / "d")).first()
    assert (row["total_feedback"], row["low_correct"], row["low_incorrect"]) == (30, 15, 15)


def test_windows_agree_with_each_other(visits):
    sliding = sorted(map(tuple, traffic.sliding_counts(visits, 3).collect()))
    assert sliding == sorted(map(tuple, traffic.trailing_windows(visits, 3).collect()))


def test_session_windows_equal_the_batch_operator(visits):
    live = sorted((r["ip_address"], r["n_visits"], str(r["started_at"])) for r in traffic.sessions(visits, "60 minutes").collect())
    batch = sorted((r["ip_address"], r["n_visits"], str(r["started_at"])) for r in vs.sessions(visits, 60).collect())
    assert live == batch


def test_ingest_is_partitioned_by_day(spark, tmp_path):
    rows = [(i, None, "1.2.3.4", "curl/8", "/x" if i % 2 else "/api/y", "GET", dt.datetime(2024, 1, 1 + i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, (
        "id long, forwarded string, peer string, user_agent string, path string, method string, timestamp timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    _finish(traffic.ingest(common.parquet_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp")))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 6 and stored.select("day").distinct().count() == 3


def test_days_past_the_retention_leave_the_state(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, path string, timestamp timestamp"
    counts = lambda: traffic.daily_windows(common.parquet_stream(spark, source, spark.createDataFrame([], schema).schema))
    removed, kept = 0, []
    for month in (1, 3, 5):
        spark.createDataFrame([(month, "/", dt.datetime(2024, month, 1))], schema).coalesce(1).write.mode("append").parquet(source)
        query = common.to_batches(counts(), common.change_log(str(tmp_path / "t")), str(tmp_path / "cp"), mode="update")
        query.awaitTermination()
        for progress in query.recentProgress:
            removed += progress["stateOperators"][0]["numRowsRemoved"]
            kept.append(progress["stateOperators"][0]["numRowsTotal"])
    assert removed >= 1 and kept[-1] <= 2
    assert common.newest(spark, str(tmp_path / "t"), ("day",)).count() == 3


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_change_log_compacts_and_survives_replay(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long"
    log = common.change_log(path)
    log(spark.createDataFrame([(k, 1) for k in range(2000)], schema), 0)
    first = _size(tmp_path / "t")
    log(spark.createDataFrame([(2, 5)], schema), 1)
    assert _size(tmp_path / "t") - first < first / 2  # what a batch writes depends on its own rows
    table = lambda: {r["k"]: r["v"] for r in common.newest(spark, path, ("k",)).collect()}
    want = {k: 1 for k in range(2000)} | {2: 5}
    assert table() == want
    assert common.compact(spark, path, ("k",)) == 1 and table() == want
    log(spark.createDataFrame([(2, 5)], schema), 1)  # the last batch once more
    log(spark.createDataFrame([(3, 7), (9999, 1)], schema), 2)
    want |= {3: 7, 9999: 1}
    assert table() == want
    assert common.compact(spark, path, ("k",), F.col("k") >= 3) == 2
    assert table() == {k: v for k, v in want.items() if k >= 3}
    assert common.compact(spark, path, ("k",)) == 2 and not (tmp_path / "t" / "log" / "batch_id=0").exists()
    log(spark.createDataFrame([(5, 8)], schema), 3)
    assert common.compact(spark, path, ("k",)) == 3 and table()[5] == 8 and len(table()) == len(want) - 3
    with pytest.raises(FileNotFoundError):
        common.newest(spark, str(tmp_path / "none"))


def test_retention_drops_days_and_cuts_one(spark, tmp_path):
    rows = [(i, None, "1.2.3.4", "curl/8", "/x", "GET", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, forwarded string, peer string, user_agent string, path string, method string, timestamp timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    _finish(traffic.ingest(common.parquet_stream(spark, str(tmp_path / "in"), df.schema, 1), path, str(tmp_path / "cp")))
    for _ in range(2):  # a second run changes nothing
        traffic.drop_old_visits(spark, path, "2024-01-02 12:00:00")
        assert {r["id"] for r in spark.read.parquet(path).collect()} == {i for i in range(20) if 5 * i >= 36}
    assert sorted(common.folders(spark, path, "day")) == ["2024-01-02", "2024-01-03", "2024-01-04"]
    traffic.drop_old_visits(spark, path, "2024-01-04 23:59:59")
    assert spark.read.schema(df.schema).parquet(path).count() == 0


def test_sessions_of_a_stream_close_with_the_watermark(spark, tmp_path, visits):
    later = visits.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("end").alias("ip_address"), F.lit("/").alias("path"),
                                   F.lit(dt.datetime(2024, 3, 1)).cast("timestamp").alias("timestamp"))
    visits.unionByName(later).write.parquet(str(tmp_path / "v"))
    stream = common.parquet_stream(spark, str(tmp_path / "v"), visits.schema)
    _finish(common.to_parquet(traffic.sessions(stream, "60 minutes").drop("w"), str(tmp_path / "t"), str(tmp_path / "cp")))
    live = sorted((r["ip_address"], r["n_visits"], str(r["started_at"])) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert live == sorted((r["ip_address"], r["n_visits"], str(r["started_at"])) for r in vs.sessions(visits, 60).collect())


def test_results_carry_a_bloom_filter(spark, tmp_path):
    tasks = spark.createDataFrame([(f"task-{i * 7919 % 5000}", "fine") for i in range(5000)], "task_id string, text string")
    tasks.coalesce(1).write.parquet(str(tmp_path / "in"))
    _finish(scoring.start(common.parquet_stream(spark, str(tmp_path / "in"), tasks.schema), str(tmp_path / "out"), str(tmp_path / "cp")))
    (file,) = (tmp_path / "out").glob("*.parquet")
    jvm = spark._jvm.org.apache.parquet.hadoop
    source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration())
    reader = jvm.ParquetFileReader.open(source)
    column = next(c for c in reader.getFooter().getBlocks().get(0).getColumns() if c.getPath().toDotString() == "task_id")
    assert column.getBloomFilterOffset() > 0
    reader.close()
    found = scoring.result_of(spark, str(tmp_path / "out"), "task-3")
    assert found.count() == 1 and "EqualTo(task_id,task-3)" in found._jdf.queryExecution().toString()


def test_stateful_monitor_over_batches_restart_and_replay(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "m")
    schema = _feedback(spark, [1]).withColumn("source", F.lit("school")).schema
    arrive = lambda ids: _feedback(spark, ids).withColumn("source", F.lit("school")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stored = spark.read.schema(schema).parquet(source)
        _finish(stateful.start(common.parquet_stream(spark, source, schema, 1), stored, root))

    arrive(range(0, 80))    # 40 corrections: too few
    run()
    assert not exports_of(spark, tmp_path)
    arrive(range(80, 120))  # 60: export
    run()
    arrive(range(120, 140, 2))  # no new correction
    arrive(range(140, 180))  # 80: export
    run()
    run()
    done = common.newest(spark, f"{root}/events", ("incorrect",)).orderBy("incorrect").collect()
    assert [(r["incorrect"], r["exports"]) for r in done] == [(60, 1), (80, 2)]
    assert sorted(exports_of(spark, tmp_path).values()) == [60, 80]
    # the last batch is run again: its commit is taken away
    commits = sorted((tmp_path / "m" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    again = common.newest(spark, f"{root}/events", ("incorrect",)).orderBy("incorrect").collect()
    assert again == done and sorted(exports_of(spark, tmp_path).values()) == [60, 80]


def exports_of(spark, tmp_path):
    root = tmp_path / "m" / "exports"
    names = [r["filename"] for r in exports.list_exports(spark, str(root)).collect()] if root.exists() else []
    return {n: exports.read_export(spark, str(root), n).count() for n in names}
