"""The correction monitor with keyed state: counts live in the state store, exports are events.

Feedback is counted per task and batch first, so the state's key gets a few rows
however many arrive.  The store keeps one version per batch: a batch that is run
again starts from the state before it, emits the same event and overwrites the
same export.  No folder is listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riskloom.operators.feedback import MIN_CORRECTIONS
from riskloom.sources import exports
from riskloom.streaming.common import change_log, settings, to_batches

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "source string, total long, incorrect long, exports long, newest timestamp_ntz"
_COUNTS = "source string, total long, incorrect long, newest timestamp_ntz"
_STATE = "total long, incorrect long, exported long, exports long, newest timestamp_ntz"


def partial_counts(feedback: DataFrame) -> DataFrame:
    """Per task and Arrow batch: rows, corrections and the newest correction's time, by ``source``."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            wrong = rows[rows["wrong"]]
            newest = wrong.groupby("source")["at"].max()
            sizes = rows.groupby("source").agg(total=("wrong", "size"), incorrect=("wrong", "sum")).reset_index()
            yield sizes.assign(newest=sizes["source"].map(newest).astype("datetime64[ns]"))

    rows = feedback.select("source", (~F.col("is_correct")).alias("wrong"), F.col("created_at").cast("timestamp_ntz").alias("at"))
    return rows.where(F.col("wrong").isNotNull()).mapInPandas(count, _COUNTS)


class ExportRule(StatefulProcessor):
    """Emits an event when there are enough corrections and more than at the event before."""

    def __init__(self, minimum: int) -> None:
        self.minimum = minimum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("counts", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the API
        before = self.known.get() if self.known.exists() else (0, 0, 0, 0, None)
        total, incorrect, exported, events, newest = before
        for r in rows:
            total, incorrect = total + r["total"], incorrect + r["incorrect"]
            newest = max((t for t in (newest, r["newest"]) if t is not None), default=None)
        due = incorrect >= self.minimum and incorrect > exported
        self.known.update((total, incorrect, incorrect if due else exported, events + due, newest))
        if due:
            yield Row(source=key[0], total=total, incorrect=incorrect, exports=events + 1, newest=newest)

    def close(self) -> None:
        pass


def export_events(feedback: DataFrame, minimum: int = MIN_CORRECTIONS) -> DataFrame:
    """The stream of exports that are due, one row each (``EVENT``); feedback has ``source, is_correct, created_at``."""
    return partial_counts(feedback).groupBy("source").transformWithState(
        ExportRule(minimum), EVENT, outputMode="Append", timeMode="None")


def start(feedback: DataFrame, stored: DataFrame, root: str, minimum: int = MIN_CORRECTIONS, every: str | None = None) -> StreamingQuery:
    """Run the monitor: events go to ``root/events``, the corrections each speaks of to ``root/exports``.

    ``stored`` is the feedback table itself, read anew for each export up to the event's newest correction.
    """
    log = change_log(f"{root}/events")

    def handle(batch: DataFrame, batch_id: int) -> None:
        events = batch.persist()
        log(events, batch_id)
        for e in events.collect():  # one row for each source at most
            wrong = stored.where((F.col("source") == e["source"]) & ~F.col("is_correct") & (F.col("created_at").cast("timestamp_ntz") <= F.lit(e["newest"]).cast("timestamp_ntz")))
            exports.export_corrections(wrong.drop("source"), f"{root}/exports", e["incorrect"], e["newest"].strftime("%Y%m%d_%H%M%S"))
        events.unpersist()

    with settings(feedback.sparkSession, {"spark.sql.streaming.stateStore.providerClass": ROCKS}):
        return to_batches(export_events(feedback, minimum), handle, f"{root}/checkpoint", every=every)
