"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas
from riskloom.session import materialize

CORRUPT = "_corrupt_record"


def read_corpus_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.CORPUS, mode: str = "FAILFAST"
) -> DataFrame:
    """Labelled corpus from CSV: header, quoted multi-line texts, doubled quotes, strings as declared.

    A malformed row is an error; read again with ``read_corpus_tolerant`` to leave such rows out.  Multi-line CSV cannot be
    split, so one file is one task: store a large corpus as Parquet once.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
        .option("escape", '"').option("mode", mode).csv(path)
    )


def read_corpus_tolerant(spark: SparkSession, path: str, schema: T.StructType = schemas.CORPUS) -> DataFrame:
    """The same, with malformed lines skipped."""
    return _with_corrupt(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_quarantine(spark: SparkSession, path: str, schema: T.StructType = schemas.CORPUS) -> DataFrame:
    """The malformed lines that the tolerant reader skips."""
    return _with_corrupt(spark, path, schema).where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def _with_corrupt(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with their malformed line.  A line is judged by all its columns, so none may be pruned."""
    wide = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    read = (
        spark.read.schema(wide).option("header", True).option("multiLine", True).option("quote", '"')
        .option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False).csv(path)
    )
    return read.where(F.length(F.concat_ws("", *schema.fieldNames())) >= 0)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def read_split_indices(spark: SparkSession, path: str) -> DataFrame:
    """``split, row_id`` from a split-index document."""
    document = spark.read.schema(schemas.SPLIT_FILE).option("multiLine", True).json(path)
    parts = [
        document.select(F.lit(name).alias("split"), F.explode(f"{name}_indices").alias("row_id"))
        for name in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_split_sizes(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.schema(schemas.SPLIT_FILE).option("multiLine", True).json(path)
    return document.select("total_samples", "train_size", "val_size", "test_size", "random_seed")


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str],
    column: str, lower: int, upper: int, partitions: int = 64,
) -> DataFrame:
    """A database table read in parallel ranges of ``column``; filters are pushed to the database.

    ``lower`` and ``upper`` are the smallest and largest value; rows outside would all fall to the first or last range.
    """
    options = {
        "url": normalize_url(url), "dbtable": table, "partitionColumn": column, "lowerBound": str(lower),
        "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": "10000", **properties}
    return spark.read.format("jdbc").options(**options).load()


def normalize_url(url: str) -> str:
    """JDBC form of a database URL; ``postgres://`` is accepted for ``postgresql://``."""
    if url.startswith("postgres://"):
        url = "postgresql://" + url[len("postgres://"):]
    return url if url.startswith("jdbc:") else "jdbc:" + url


def read_results_document(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation result documents (one JSON object per file), nested as declared."""
    return spark.read.schema(schemas.RESULTS_DOCUMENT).option("multiLine", True).json(path)


#: Files whose offsets (about 150 bytes each) are broadcast.
MOST_FILES = 200_000


def parquet_positions(stored: DataFrame, out: str = "row_id") -> DataFrame:
    """Dense row positions of a stored Parquet table: file order, then place in the file.

    Rows are counted per file, which reads no column; the running totals become
    offsets, one row per file, stored and counted.  Rows look their file's offset
    up where they are, neither sorted nor shuffled; with more than ``MOST_FILES``
    files the offsets are joined as the planner sees fit.  Positions stay valid
    until the files are rewritten, so keep them only next to the files; across
    rewrites use a key column.
    """
    file = F.col("_metadata.file_path").alias("_file")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = stored.select(file).groupBy("_file").agg(F.count("*").alias("_n"))
    offsets = materialize(sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    small = offsets.count() <= MOST_FILES
    placed = stored.select("*", file, F.col("_metadata.row_index").alias("_i"))
    return placed.join(F.broadcast(offsets) if small else offsets, "_file").withColumn(out, F.col("_before") + F.col("_i")).drop("_file", "_i", "_before")
