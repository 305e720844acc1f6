"""Windowed counts of a stream that account for every row: counted, or late and written aside.

A row is late where its window had closed before its micro-batch began, that is, where the greatest event time of
all earlier batches less the delay has passed the window's end. (Spark's own watermark may lag a batch behind.) Each
batch adds partial counts, its late rows and one line of progress, each once however often it is delivered, so
there is no state but these tables and totals are sums of the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkveil.sources import appends


def start_windows(
    stream: DataFrame, event_time: str, width: str, delay: str, keys: tuple[str, ...], path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Count rows per window and keys below `path`; rows without an event time are late as well."""
    at = F.col(event_time).cast("timestamp")

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{number:012d}"
        closed = watermark(spark, path, delay, name)
        kept = batch.persist()  # a micro-batch is bounded by its trigger and read three times
        try:
            rows = kept.withColumn("__w", F.window(at, width))  # rows without a time have no window and are not in here
            late = F.lit(False) if closed is None else F.col("__w.end") <= F.lit(closed).cast("timestamp")
            aside = rows.where(late).drop("__w").union(kept.where(at.isNull()))
            counts = rows.where(~late).groupBy(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *keys).agg(F.count("*").alias("n"))
            appends.append(counts, f"{path}/counts", name)
            n_late = appends.append(aside, f"{path}/late", name)
            line = kept.agg(F.count("*").alias("rows"), F.max(at).alias("newest")).select("rows", F.lit(n_late).cast("bigint").alias("late"), "newest")
            appends.append(line, f"{path}/progress", name)
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def watermark(spark: SparkSession, path: str, delay: str, before: str | None = None) -> str | None:
    """Time up to which windows are closed, after the batches before the named one; None where none has run."""
    try:
        lines = progress(spark, path)
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if before is not None:
        lines = lines.where(F.col(appends.BATCH) < before)
    return lines.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).cast("string").alias("t")).first().t


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(rows, late, newest, _batch) per micro-batch."""
    return appends.read(spark, f"{path}/progress")


def counted(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(window_start, window_end, *keys, n) over all batches."""
    parts = appends.read(spark, f"{path}/counts")
    return parts.groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, as they came."""
    return appends.read(spark, f"{path}/late").drop(appends.BATCH)
