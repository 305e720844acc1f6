"""What several of the operators need: tables written to the shared folder, plain texts, folds."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import sparkveil
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sparkveil.session import configure, run_dir

#: The ASCII white space that separates words: [\x20\x09-\x0D].
SPACES = "[\\x20\\x09-\\x0D]+"

#: Column that tells the rows of a stage's input apart, whatever their doc_ids.
ROW_KEY = "__row_key"

#: Spark drops the shuffle files of a query as it ends, instead of whenever the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and a place where local Python workers find it if it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(sparkveil.__file__))))
    return configure(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to a new folder below spark.checkpoint.dir and read it back.

    Cuts the lineage: a lost executor costs its running tasks only, and later plans read a table. Nothing
    reads the shuffles of the write again, so their files go with it.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_row_keys(docs: DataFrame) -> DataFrame:
    """`docs` with ROW_KEY, a long that no two rows share and that rises with doc_id, null ids last.

    It is the doc_id where no row repeats one or is without; for this only the ids are counted. Otherwise the
    rows are sorted by doc_id, then by their place in the scan, and written once with a key, so that every later
    read finds the same one; a repeated id is spread over the sort's ranges.
    """
    own = F.col("doc_id").cast("long")
    repeated = docs.groupBy(own.alias("own")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR own IS NULL")
    if repeated.isEmpty():
        return docs.withColumn(ROW_KEY, own)
    placed = docs.withColumn(ROW_KEY, F.monotonically_increasing_id()).orderBy(own.asc_nulls_last(), ROW_KEY)
    return materialize(placed.withColumn(ROW_KEY, F.monotonically_increasing_id()), "row-keys")


def plain_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *carried): the two columns the scans read, null text as empty. Other columns stay behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)


def in_training_fold(key: str = "doc_id") -> Column:
    """True for rows labels may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Each Arrow batch of (doc_id, text) with both columns as lists."""
    for batch in batches:
        yield batch, batch.column(0).to_pylist(), batch.column(1).to_pylist()
