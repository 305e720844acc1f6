"""Tables that grow by batches, each of which is added once however often it is delivered.

A batch is a folder of its own below `data`, written by dynamic partition overwrite: a repeat replaces the batch by
itself. Every delivery marks its rows, and is then entered in `commits` with its mark, its number of rows and its
schema. Readers see the rows of entered deliveries only, so what a failed job left behind is invisible.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

BATCH, DELIVERY = "_batch", "_delivery"
_COMMIT = "rows bigint, schema string, committed_at timestamp, _delivery string, _batch string"


def append(df: DataFrame, path: str, batch: str) -> int:
    """Add the rows of `df` as `batch` and give their number. The same batch again adds nothing."""
    if {BATCH, DELIVERY} & set(df.columns):
        raise ValueError(f"{BATCH} and {DELIVERY} cannot be columns of the rows")
    spark, delivery = df.sparkSession, uuid.uuid4().hex
    _overwrite(df.withColumns({DELIVERY: F.lit(delivery), BATCH: F.lit(batch)}), f"{path}/data")
    # Counted from the marks, a column of one value: no rows leave the folder of an earlier delivery as it was.
    marks = spark.read.schema(f"{DELIVERY} string, {BATCH} string").parquet(f"{path}/data")
    n = marks.where((F.col(BATCH) == batch) & (F.col(DELIVERY) == delivery)).count()
    entry = spark.range(1).select(
        F.lit(n).cast("bigint").alias("rows"), F.lit(df.schema.json()).alias("schema"), F.current_timestamp().alias("committed_at"),
        F.lit(delivery).alias(DELIVERY), F.lit(batch).alias(BATCH),
    )
    _overwrite(entry, f"{path}/commits")
    return n


def _overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(rows, schema, committed_at, _delivery, _batch) per batch."""
    return spark.read.schema(_COMMIT).parquet(f"{path}/commits")


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """Columns of all batches: those of the first, then what later ones added; a handful of different schemas reach the driver."""
    firsts = commits(spark, path).groupBy("schema").agg(F.min(F.struct("committed_at", BATCH)).alias("first")).orderBy("first").select("schema")
    fields: dict[str, T.StructField] = {}
    for row in firsts.collect():
        for field in T.StructType.fromJson(json.loads(row.schema)).fields:
            fields.setdefault(field.name, field)
    return T.StructType(list(fields.values()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches with the batch they came in; columns a batch does not have are NULL."""
    fields = schema_of(spark, path).fields
    stored = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in (DELIVERY, BATCH)]])
    known = commits(spark, path).where("rows > 0").select(DELIVERY, BATCH)
    rows = spark.read.schema(stored).parquet(f"{path}/data").join(known, [BATCH, DELIVERY], "left_semi")
    return rows.select(*[F.col(f"`{f.name}`") for f in fields], BATCH)


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, job: str, body: Callable[[DataFrame, int], DataFrame] | None = None, every: str | None = None
) -> StreamingQuery:
    """Append every micro-batch under the job's name and its number, so a replayed one adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        append(batch if body is None else body(batch, number), path, f"{job}-{number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
