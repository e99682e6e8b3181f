"""Scoring queue: texts in, analysis documents out, looked up later by task id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions import lexicon as lx
from riskloom.operators import corpus, scoring
from riskloom.streaming.common import event_time, to_parquet


def score_stream(tasks: DataFrame, lexicon: lx.Lexicon = lx.Lexicon(), **model: str) -> DataFrame:
    """The batch projection, unchanged, on a stream; blank texts are refused."""
    return scoring.analyze(corpus.non_blank(tasks), lexicon, **model)


def drop_resent(tasks: DataFrame, task_id: str = "task_id", time: str = "submitted_at", within: str = "1 hour") -> DataFrame:
    """Tasks sent again within ``within`` count once; state is dropped after that."""
    return event_time(tasks, time).withWatermark(time, within).dropDuplicatesWithinWatermark([task_id])


def start(tasks: DataFrame, path: str, checkpoint: str, lexicon: lx.Lexicon = lx.Lexicon(),
          every: str | None = None, task_id: str = "task_id", time: str | None = None) -> StreamingQuery:
    """One result per task; with ``time``, the column a task was sent at, tasks sent again are dropped.

    The files carry a Bloom filter on the task id, so a lookup skips row groups
    although ids arrive in no order.
    """
    fresh = drop_resent(tasks, task_id, time) if time else tasks
    return to_parquet(score_stream(fresh, lexicon), path, checkpoint, every=every, bloom=task_id)


def result_of(spark: SparkSession, path: str, task_id, key: str = "task_id") -> DataFrame:
    """Result document of one task; empty while it is pending.  The filter is pushed to the files."""
    return spark.read.parquet(path).where(F.col(key) == task_id)
