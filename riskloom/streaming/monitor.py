"""Correction monitor: exports corrections when there are enough and more than last time.

State is a table, one row per micro-batch, written last.  A batch that is run
again finds the state of the batch before it, computes the same numbers and
overwrites the same paths, so nothing is exported twice under different names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.feedback import MIN_CORRECTIONS
from riskloom.sources import exports
from riskloom.streaming.common import exists, to_batches

STATE = (
    "total bigint, incorrect bigint, last_export_count bigint, last_export_batch bigint, newest timestamp, "
    "exported string, batch_id bigint"
)


@dataclass
class State:
    total: int = 0
    incorrect: int = 0
    last_export_count: int = 0
    last_export_batch: int = -1
    newest: object = None
    exported: str | None = None


class CorrectionMonitor:
    """``mode="full"`` exports all corrections each time, ``"delta"`` only those since the last export."""

    def __init__(self, spark: SparkSession, root: str, min_corrections: int = MIN_CORRECTIONS, mode: str = "full"):
        if mode not in ("full", "delta"):
            raise ValueError("mode must be 'full' or 'delta'")
        self.spark, self.root, self.min_corrections, self.mode = spark, root.rstrip("/"), min_corrections, mode

    # --- tables ---

    def _state_rows(self) -> DataFrame:
        return self._stored("state", STATE)

    def _stored(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def state_before(self, batch_id: int) -> State:
        previous = f"{self.root}/state/batch_id={batch_id - 1}"
        if exists(self.spark, previous + "/_SUCCESS"):  # the usual case: one small file
            schema = self._state_rows().schema
            row = self.spark.read.schema(schema).option("basePath", f"{self.root}/state").parquet(previous).first()
        else:
            row = self._state_rows().where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()
        if row is None:
            return State()
        return State(**{k: v for k, v in row.asDict().items() if k not in ("batch_id", "exported")})

    def exported_batches(self) -> DataFrame:
        return self._state_rows().where(F.col("exported").isNotNull()).select("batch_id", "last_export_count", "exported")

    # --- one micro-batch ---

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"feedback-{batch_id}")
        watched = batch.observe(
            seen, F.count("*").alias("total"), F.count_if(~F.col("is_correct")).alias("incorrect"),
            F.max(F.when(~F.col("is_correct"), F.col("created_at").cast("timestamp"))).alias("newest"))
        # counting and storing are one pass; the stored rows are what later exports read
        watched.where(~F.col("is_correct")).write.mode("overwrite").parquet(f"{self.root}/corrections/batch_id={batch_id}")
        counts, before = seen.get, self.state_before(batch_id)
        state = State(
            before.total + counts["total"], before.incorrect + counts["incorrect"],
            before.last_export_count, before.last_export_batch,
            max((t for t in (before.newest, counts["newest"]) if t is not None), default=None))
        if state.incorrect >= self.min_corrections and state.incorrect > state.last_export_count:
            stored = self.spark.read.parquet(f"{self.root}/corrections").where(F.col("batch_id") <= batch_id)
            if self.mode == "delta":
                stored = stored.where(F.col("batch_id") > before.last_export_batch)
            stamp = state.newest.strftime("%Y%m%d_%H%M%S")
            state.exported = exports.export_corrections(
                stored.drop("batch_id"), f"{self.root}/exports", state.incorrect, stamp)
            state.last_export_count, state.last_export_batch = state.incorrect, batch_id
        row = (state.total, state.incorrect, state.last_export_count, state.last_export_batch, state.newest,
               state.exported, batch_id)
        self.spark.createDataFrame([row], STATE).drop("batch_id").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/state/batch_id={batch_id}")

    def start(self, feedback: DataFrame, every: str | None = None):
        """Run on what has arrived and stop (call it at start-up and daily), or keep running every interval."""
        return to_batches(feedback, self.handle, f"{self.root}/checkpoint", every=every)
