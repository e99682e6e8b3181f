"""Traffic and dashboards as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators import feedback as fb
from riskloom.operators import visitors as vs
from riskloom.session import scratch_path
from riskloom.streaming.common import change_log, compact, event_time, folders, remove, to_batches

REFRESH = "30 seconds"
RETENTION = "30 days"
TRAFFIC_KEYS = ("day", "path")


def ingest(requests: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append one parsed row per page view to a table partitioned by ``day`` and ``batch``.

    A batch that is run again overwrites its own partitions.  There is no sink
    log beside the table, so retention may remove partitions.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        _over_partitions(batch.withColumn("batch", F.lit(batch_id).cast("long")), path)

    rows = vs.ingest(requests).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return to_batches(rows, handle, checkpoint, every=every)


def _over_partitions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def feedback_dashboard(feedback: DataFrame, path: str, checkpoint: str, every: str | None = REFRESH) -> StreamingQuery:
    """Totals and counts per risk level, kept as one state row; a change log of that row, read with ``common.newest``."""
    counts = feedback.agg(*fb._totals(), *fb._risk_counts())
    return to_batches(counts, change_log(path), checkpoint, mode="complete", every=every)


def traffic_dashboard(visits: DataFrame, path: str, checkpoint: str, every: str | None = REFRESH) -> StreamingQuery:
    """Visits per day and path; read the change log with ``common.newest`` by ``TRAFFIC_KEYS``.

    Each batch writes the changed counts only; days older than the retention
    leave the state, and the table with ``compact_traffic``.
    """
    counts = event_time(visits).withWatermark("timestamp", RETENTION).groupBy(
        F.window("timestamp", "1 day").alias("w"), "path").agg(F.count("*").alias("n_visits"))
    flat = counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "path", "n_visits")
    return to_batches(flat, change_log(path), checkpoint, mode="update", every=every)


def compact_traffic(spark: SparkSession, path: str, oldest_day: str | None = None) -> int:
    """Fold the dashboard's change log; days before ``oldest_day`` leave the table."""
    return compact(spark, path, TRAFFIC_KEYS, None if oldest_day is None else F.col("day") >= oldest_day)


def drop_old_visits(spark: SparkSession, path: str, oldest: str) -> None:
    """Remove visits before the time ``oldest`` from a table partitioned by ``day``.

    Whole days go as partitions, unread.  Of the day that the cut falls into the
    later rows are written anew over that partition alone.
    """
    day = oldest[:10]
    days = folders(spark, path, "day")
    for name, at in days.items():
        if name < day:
            remove(spark, at)
    if day not in days:
        return
    kept = scratch_path(spark, "cut-day")
    table = spark.read.option("basePath", path).parquet(days[day]).withColumn("day", F.lit(day))
    table.where(F.col("timestamp") >= F.lit(oldest).cast("timestamp")).write.parquet(kept)
    rest = spark.read.schema(table.schema).parquet(kept)
    _over_partitions(rest, path)
    full = {str(r["batch"]) for r in rest.select("batch").distinct().collect()}  # batches of one day
    for name, at in folders(spark, days[day], "batch").items():
        if name not in full:
            remove(spark, at)


def daily_windows(visits: DataFrame) -> DataFrame:
    """Visits per tumbling day; batch or stream."""
    return event_time(visits).withWatermark("timestamp", RETENTION).groupBy(
        F.window("timestamp", "1 day").alias("w")
    ).agg(F.count("*").alias("n_visits")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n_visits")


def trailing_windows(visits: DataFrame, days: int = 7) -> DataFrame:
    """Trailing windows that slide by a day, built from the daily counts rather than from each visit ``days`` times."""
    daily = event_time(visits).withWatermark("timestamp", RETENTION).groupBy(
        F.window("timestamp", "1 day").alias("d")).agg(F.count("*").alias("n"))
    ends = F.sequence(F.lit(1), F.lit(days))
    spread = daily.select(F.explode(ends).alias("i"), F.col("d.start").alias("s"), "n")
    end = F.col("s") + F.make_dt_interval(days=F.col("i"))
    return spread.groupBy(F.date_format(end, "yyyy-MM-dd").alias("window_end")).agg(F.sum("n").alias("n_visits"))


def sliding_counts(visits: DataFrame, days: int = 7) -> DataFrame:
    """The same windows in one stateful aggregation, for a stream."""
    return event_time(visits).withWatermark("timestamp", RETENTION).groupBy(
        F.window("timestamp", f"{days} days", "1 day").alias("w")
    ).agg(F.count("*").alias("n_visits")).select(
        F.date_format("w.end", "yyyy-MM-dd").alias("window_end"), "n_visits")


def sessions(visits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits per address joined by pauses shorter than ``gap``; closed sessions leave the state."""
    return event_time(visits).withWatermark("timestamp", late).groupBy(
        "ip_address", F.session_window("timestamp", gap).alias("w")
    ).agg(F.count("*").alias("n_visits"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"))
