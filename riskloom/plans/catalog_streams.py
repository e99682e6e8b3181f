"""Streaming queries: each runs its stream over what the tables hold and returns what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import lexicon as lx
from riskloom.functions import rates
from riskloom.operators import feedback as fb
from riskloom.operators import scoring
from riskloom.plans.catalog import Catalog
from riskloom.plans.catalog_feedback import BREAKDOWN_SQL, TOTALS_SQL
from riskloom.plans.catalog_text import analysis_sql
from riskloom.plans.catalog_visitors import INGEST_SQL, SESSIONS_SQL, VIEW_SQL, iso
from riskloom.plans.testbed import TEST_LEXICON, Testbed
from riskloom.session import scratch_path
from riskloom.sources import exports
from riskloom.streaming import scoring as score_jobs
from riskloom.streaming import stateful, traffic
from riskloom.streaming.common import change_log, exists, newest, parquet_stream, to_batches, to_parquet
from riskloom.streaming.monitor import CorrectionMonitor


class StreamBed(Testbed):
    """The same derived tables, with the driver's tables read as streams."""

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return parquet_stream(self.spark, path, self.spark.read.parquet(path).schema)


def _streams(bed: Testbed) -> StreamBed:
    return StreamBed(bed.spark, bed.sf_dir)


def _finish(query) -> None:
    query.awaitTermination()


def _results(bed: Testbed) -> str:
    """Every text sent as a task, and every third one again ten minutes later; where the results went."""
    out = scratch_path(bed.spark, "scored")
    sent = bed._at(F.lit(0))
    tasks = _streams(bed).documents.select(F.col("doc_id").alias("task_id"), "text", F.explode(
        F.when(F.col("doc_id") % 3 == 0, F.array(sent, sent + F.make_dt_interval(mins=F.lit(10)))).otherwise(F.array(sent))).alias("submitted_at"))
    _finish(score_jobs.start(tasks, f"{out}/results", f"{out}/checkpoint", TEST_LEXICON, time="submitted_at"))
    return f"{out}/results"


def _scored(bed: Testbed) -> DataFrame:
    return scoring.flatten(bed.spark.read.parquet(_results(bed)), "task_id")


def _looked_up(bed: Testbed) -> DataFrame:
    """The result of one task, which was sent twice."""
    return scoring.flatten(score_jobs.result_of(bed.spark, _results(bed), 123), "task_id")


def _feedback_stream(bed: Testbed) -> DataFrame:
    """Feedback arriving over time: the batch table, stored and read as a stream."""
    path = scratch_path(bed.spark, "feedback")
    bed.feedback.write.parquet(path)
    return parquet_stream(bed.spark, path, bed.feedback.schema)


def _monitored(bed: Testbed) -> DataFrame:
    monitor = CorrectionMonitor(bed.spark, scratch_path(bed.spark, "monitor"), min_corrections=50)
    _finish(monitor.start(_feedback_stream(bed)))
    return monitor._state_rows().orderBy(F.desc("batch_id")).limit(1).select("total", "incorrect", "last_export_count")


def _stateful(bed: Testbed) -> DataFrame:
    """The monitor with keyed state, over several micro-batches and a second run that finds nothing new."""
    path, root = scratch_path(bed.spark, "feedback"), scratch_path(bed.spark, "monitor")
    rows = bed.feedback.withColumn("source", F.lit("reviews"))
    rows.repartition(3).write.parquet(path)
    for _ in range(2):
        _finish(stateful.start(parquet_stream(bed.spark, path, rows.schema, 1), bed.spark.read.schema(rows.schema).parquet(path), root))
    events = newest(bed.spark, f"{root}/events", ("source",))
    if not exists(bed.spark, f"{root}/exports"):  # never enough corrections, so no event either
        return events.select("source", "incorrect", F.lit(False).alias("last_export_is_whole"))
    last = exports.list_exports(bed.spark, f"{root}/exports").select(F.regexp_extract("filename", "corrections_([0-9]+)samples", 1).cast("long").alias("n"))
    return events.select("source", "incorrect", (last.agg(F.max("n")).scalar() == F.col("incorrect")).alias("last_export_is_whole"))


def _scheduled(bed: Testbed) -> DataFrame:
    """Two scheduled runs over the same input: the second finds nothing new and exports nothing."""
    monitor = CorrectionMonitor(bed.spark, scratch_path(bed.spark, "monitor"), min_corrections=50)
    source = _feedback_stream(bed)
    _finish(monitor.start(source))
    _finish(monitor.start(source))
    return monitor.exported_batches().agg(
        F.count("*").alias("n_exports"), F.max("last_export_count").alias("last_export_count"))


def _ingested(bed: Testbed) -> DataFrame:
    out = scratch_path(bed.spark, "visitors")
    _finish(traffic.ingest(_streams(bed).requests, f"{out}/table", f"{out}/checkpoint"))
    stored = bed.spark.read.parquet(f"{out}/table").drop("day", "batch")
    return iso(stored, "timestamp")


def _feedback_dashboard(bed: Testbed) -> DataFrame:
    out = scratch_path(bed.spark, "dashboard")
    _finish(traffic.feedback_dashboard(_feedback_stream(bed), f"{out}/table", f"{out}/checkpoint", every=None))
    return newest(bed.spark, f"{out}/table")


def _live_totals(bed: Testbed) -> DataFrame:
    return _feedback_dashboard(bed).select(
        "total_feedback", "correct_predictions", "incorrect_predictions", "accuracy_rate")


def _live_breakdown(bed: Testbed) -> DataFrame:
    lines = [
        F.struct(
            F.lit(level).alias("risk_level"), F.col(f"{level.lower()}_correct").alias("correct"),
            F.col(f"{level.lower()}_incorrect").alias("incorrect"),
            (F.col(f"{level.lower()}_correct") + F.col(f"{level.lower()}_incorrect")).alias("total"),
            rates.percent(
                F.col(f"{level.lower()}_correct"),
                F.col(f"{level.lower()}_correct") + F.col(f"{level.lower()}_incorrect")).alias("accuracy"))
        for level in lx.RISK_LEVELS]
    return _feedback_dashboard(bed).select(F.inline(F.array(*lines)))


def _live_traffic(bed: Testbed) -> DataFrame:
    """Counts after the stream, once more after compaction: the second reads one base table."""
    out = scratch_path(bed.spark, "traffic")
    _finish(traffic.traffic_dashboard(_streams(bed).visitors, f"{out}/table", f"{out}/checkpoint", every=None))
    traffic.compact_traffic(bed.spark, f"{out}/table")
    return newest(bed.spark, f"{out}/table", traffic.TRAFFIC_KEYS)


def _live_recent(bed: Testbed) -> DataFrame:
    """The dashboard's table after retention: ten days up to the newest visit."""
    out = scratch_path(bed.spark, "traffic")
    _finish(traffic.traffic_dashboard(_streams(bed).visitors, f"{out}/table", f"{out}/checkpoint", every=None))
    traffic.compact_traffic(bed.spark, f"{out}/table", _days_back(bed, 9)[:10])
    return newest(bed.spark, f"{out}/table", traffic.TRAFFIC_KEYS)


def _days_back(bed: Testbed, days: int) -> str:
    """The newest visit's time less ``days`` days, as text to the microsecond."""
    newest_visit = bed.visitors.agg(F.max("timestamp").alias("t"))
    return newest_visit.select(F.date_format(F.col("t") - F.make_dt_interval(days=F.lit(days)), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]


def _live_windows(bed: Testbed) -> DataFrame:
    out = scratch_path(bed.spark, "windows")
    counts = traffic.sliding_counts(_streams(bed).visitors)
    _finish(to_batches(counts, change_log(f"{out}/table"), f"{out}/checkpoint", mode="update"))
    return newest(bed.spark, f"{out}/table", ("window_end",))


def _kept_visits(bed: Testbed) -> DataFrame:
    """A table partitioned by day, ingested as a stream, after retention of twenty days."""
    out = scratch_path(bed.spark, "retained")
    _finish(traffic.ingest(_streams(bed).requests, f"{out}/table", f"{out}/checkpoint"))
    traffic.drop_old_visits(bed.spark, f"{out}/table", _days_back(bed, 20))
    return bed.spark.read.parquet(f"{out}/table").select("id", "path")


def _live_sessions(bed: Testbed) -> DataFrame:
    """Sessions of a stream; a visit two days after the last one closes them all and stays open itself."""
    out = scratch_path(bed.spark, "sessions")
    closing = bed.visitors.agg(F.max("timestamp") + F.make_dt_interval(days=F.lit(2))).toDF("timestamp")
    visits = bed.visitors.select("ip_address", "timestamp")
    visits.unionByName(closing.withColumn("ip_address", F.lit("closing"))).write.parquet(f"{out}/visits")
    stream = parquet_stream(bed.spark, f"{out}/visits", visits.schema)
    _finish(to_parquet(traffic.sessions(stream).drop("w"), f"{out}/table", f"{out}/checkpoint"))
    return iso(bed.spark.read.parquet(f"{out}/table"), "started_at", "ended_at").select("ip_address", "started_at", "ended_at", "n_visits")


SLIDING_SQL = """
    SELECT strftime(date_trunc('day', ts) + to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS window_end, count(*) AS n_visits
    FROM visitors, range(1, 8) g(i) GROUP BY 1"""


def register(c: Catalog) -> None:
    c.add("t01_scored_stream", _scored, f"SELECT * EXCLUDE (doc_id), doc_id AS task_id FROM ({analysis_sql()})")
    c.add("t01_task_lookup", _looked_up, f"SELECT * EXCLUDE (doc_id), doc_id AS task_id FROM ({analysis_sql()}) WHERE doc_id = 123")
    c.add("t02_correction_monitor", _monitored, """
        SELECT total, incorrect, CASE WHEN incorrect >= 50 THEN incorrect ELSE 0 END AS last_export_count FROM (
          SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_correct) AS incorrect FROM feedback)""")
    c.add("t02_stateful_monitor", _stateful, """
        SELECT 'reviews' AS source, incorrect, true AS last_export_is_whole FROM (
          SELECT count(*) FILTER (WHERE NOT is_correct) AS incorrect FROM feedback) WHERE incorrect >= 50""")
    c.add("t03_scheduled_runs", _scheduled, """
        SELECT CAST(incorrect >= 50 AS BIGINT) AS n_exports, CASE WHEN incorrect >= 50 THEN incorrect END AS last_export_count
        FROM (SELECT count(*) FILTER (WHERE NOT is_correct) AS incorrect FROM feedback)""")
    c.add("t04_visitor_ingest", _ingested, INGEST_SQL)
    c.add("t05_live_totals", _live_totals, f"SELECT {TOTALS_SQL} FROM feedback")
    c.add("t05_live_breakdown", _live_breakdown, BREAKDOWN_SQL)
    c.add("t05_live_traffic", _live_traffic,
          "SELECT strftime(ts, '%Y-%m-%d') AS day, path, count(*) AS n_visits FROM visitors GROUP BY 1, 2")
    c.add("t05_live_traffic_retained", _live_recent, """
        SELECT strftime(ts, '%Y-%m-%d') AS day, path, count(*) AS n_visits FROM visitors
        WHERE date_trunc('day', ts) >= date_trunc('day', (SELECT max(ts) FROM events) - INTERVAL 9 DAY) GROUP BY 1, 2""")
    c.add("t07_retention", _kept_visits, f"""
        SELECT id, path FROM visitors WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY AND {VIEW_SQL}""")
    c.add("t08_sessions_stream", _live_sessions, f"SELECT ip_address, started_at, ended_at, n_visits FROM ({SESSIONS_SQL})")
    c.add("t06_daily_windows", lambda b: traffic.daily_windows(b.visitors),
          "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_visits FROM visitors GROUP BY 1")
    c.add("t06_trailing_windows", lambda b: traffic.trailing_windows(b.visitors), SLIDING_SQL)
    c.add("t06_sliding_stream", _live_windows, SLIDING_SQL)
