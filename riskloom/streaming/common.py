"""Stream sources, runs and published tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream: a folder of files, or one file, taken from its folder by name."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def event_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Watermarks need a time-zoned type; zoneless times are read as UTC session time."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None,
               every: str | None = None, bloom: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once; all that is there now, or every interval.

    ``bloom`` names a column whose values get a Bloom filter in each row group.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if not bloom:
        return _triggered(writer, every).start()
    # A stream's files are written with its session's settings, which are fixed at its start.  A column chunk that is
    # all dictionary gets no filter, and a dictionary of unique ids is as large as they are.
    with settings(stream.sparkSession, {f"parquet.bloom.filter.enabled#{bloom}": "true", f"parquet.enable.dictionary#{bloom}": "false"}):
        return _triggered(writer, every).start()


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a stream's start."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append", every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return _triggered(writer, every).start()


def _triggered(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def change_log(path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler that appends a batch's rows under its id and touches nothing else.

    What a batch writes depends on its own rows only, and a batch that is run
    again overwrites what it wrote.  Read the table with ``newest``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
    return handle


def folders(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """The folders ``name=<value>`` right below ``path``, by value."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [e.getPath() for e in files.listStatus(root)] if files.exists(root) else []
    return {p.getName().split("=", 1)[1]: p.toString() for p in found if p.getName().startswith(f"{name}=")}


def _numbered(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Finished folders ``name=<number>`` below ``path``."""
    return {int(n): at for n, at in folders(spark, path, name).items() if exists(spark, f"{at}/_SUCCESS")}


def _parts(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The last batch that was compacted, and the compacted rows with all later changes, each with its batch id."""
    bases = _numbered(spark, f"{path}/base", "upto")
    upto = max(bases, default=-1)
    frames = [spark.read.parquet(bases[upto]).withColumn("_batch", F.lit(upto).cast("long"))] if bases else []
    later = [p for n, p in sorted(_numbered(spark, f"{path}/log", "batch_id").items()) if n > upto]
    if later:
        log = spark.read.option("basePath", f"{path}/log").parquet(*later)
        frames.append(log.withColumnRenamed("batch_id", "_batch").withColumn("_batch", F.col("_batch").cast("long")))
    whole = frames[0] if frames else None
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return upto, whole


def newest(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key of a change log; combined on the map side, so old versions are not shuffled."""
    _, rows = _parts(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no finished batch below {path}")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
    return last.select(*keys, "_row.*")


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = (), keep: Column | None = None) -> int:
    """Fold the log so far into one base table, a job of its own; returns the last batch it holds.

    ``keep`` drops rows for good, such as days past their retention.  Readers see
    the old base until the new one is finished.  Batches that are in a base
    before this one and older bases are removed; those of this one stay for
    readers that have begun, until the next compaction.
    """
    before, rows = _parts(spark, path)
    logged = _numbered(spark, f"{path}/log", "batch_id")
    upto = max([before, *logged])
    if rows is None or upto == before:
        return before
    kept = newest(spark, path, keys)
    (kept if keep is None else kept.where(keep)).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    for number, old in logged.items():
        if number <= before:
            remove(spark, old)
    for number, old in _numbered(spark, f"{path}/base", "upto").items():
        if number < before:
            remove(spark, old)
    return upto


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
