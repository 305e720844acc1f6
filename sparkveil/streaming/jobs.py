"""The record flow on streams: same projections as on tables, plus the stateful parts.

Sinks are files below the shared folder. A replayed micro-batch overwrites its own folder, so
at-least-once delivery has an exactly-once effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sparkveil.config import Anonymization
from sparkveil.operators import flow
from sparkveil.session import run_dir


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, form: str = "parquet", files_per_trigger: int | None = None,
    names: str | None = None,
) -> DataFrame:
    """Files of a folder as a stream under an explicit schema; the trigger limit bounds a micro-batch."""
    reader = spark.readStream.format(form).schema(schema)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def _trigger(writer, every: str | None):
    """All available data and stop, or a processing-time interval."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


# ------------------------------------------------------------------------------------ sinks


def start_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start(path)


def start_batches(
    df: DataFrame, path: str, checkpoint: str, body: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append", every: str | None = None,
) -> StreamingQuery:
    """Apply `body` to every micro-batch and write it to a folder of its own, with its size next to it.

    The size is observed while the batch is written; the batch is not read twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        size = Observation()
        out = batch if body is None else body(batch, batch_id)
        out.observe(size, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")
        counted = spark.range(1).select(F.lit(int(size.get["n"])).cast("bigint").alias("batch_size"))
        counted.write.mode("overwrite").parquet(f"{path}/sizes/batch_id={batch_id}")

    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def collect_table(df: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all available data and give its output table."""
    spark, base = df.sparkSession, run_dir(df.sparkSession, label)
    finish(start_table(df, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def collect_batches(
    df: DataFrame, label: str, body: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append"
) -> tuple[DataFrame, DataFrame]:
    """Run a stream by micro-batches over all available data: (rows with batch_id, batch sizes)."""
    spark, base = df.sparkSession, run_dir(df.sparkSession, label)
    finish(start_batches(df, f"{base}/out", f"{base}/checkpoint", body, mode))
    return spark.read.parquet(f"{base}/out/data"), spark.read.parquet(f"{base}/out/sizes")


def collect_latest(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an updating aggregate over all available data and give the last value per key."""
    rows, _ = collect_batches(df, label, mode="update")
    values = [c for c in df.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


# -------------------------------------------------------------------------------- operators


def check(
    stream: DataFrame, data_type: str, settings: Anonymization, processed_at: Column, key: str = "id",
    secret: bytes = b"", seed: str = "",
) -> DataFrame:
    """Stateless check and conditional anonymization, the same plan as for a table."""
    return flow.process(stream, data_type, settings, "stream", processed_at, key, secret, seed)


def batch_body(
    data_type: str, settings: Anonymization, processed_at: Column, key: str = "id", secret: bytes = b"", seed: str = ""
) -> Callable[[DataFrame, int], DataFrame]:
    """Body for `start_batches`: the buffered batch path of the hybrid processor."""

    def body(batch: DataFrame, batch_id: int) -> DataFrame:
        return flow.process(batch, data_type, settings, "batch", processed_at, key, secret, seed)

    return body


def running_metrics(checked: DataFrame, *keys: str) -> DataFrame:
    """Processed and violating records so far; one state row per key."""
    return checked.groupBy(*(keys or (F.lit("all").alias("scope"),))).agg(
        F.count("*").alias("processed"), F.count_if("has_violations").alias("violating"),
        F.sum(F.size("violations")).cast("bigint").alias("violations"),
    )


def observed(checked: DataFrame, name: str = "compliance") -> DataFrame:
    """Per-batch metrics without state; a listener reads them from the progress events."""
    return checked.observe(name, F.count("*").alias("processed"), F.count_if("has_violations").alias("violating"))


def with_event_time(stream: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp; a zoneless one is read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def deduplicate(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """First copy of a record within the watermark; state older than the delay is dropped."""
    return with_event_time(stream, event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, event_time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Counts per event-time window; late rows count until the watermark passes the window."""
    windowed = with_event_time(stream, event_time).withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def latest_consent(changes: DataFrame, subject: str, at: str, withdrawn: str) -> DataFrame:
    """Newest consent state per subject, unique by subject."""
    newest = F.max_by(F.struct(F.col(withdrawn).alias("w"), F.col(at).alias("t")), F.struct(at, withdrawn))
    return changes.groupBy(subject).agg(newest.alias("c")).select(
        subject, F.col("c.w").alias("consent_withdrawn"), F.col("c.t").alias("consent_changed_at")
    )


def block_withdrawn(stream: DataFrame, consent: DataFrame, subject: str, event_time: str) -> DataFrame:
    """Events with a `blocked` flag: true after their subject withdrew consent.

    Stream-static left join on the subject: the stream is the preserved side, so a hot
    subject needs no state and no grouping, and the trigger limit bounds what one batch joins.
    """
    joined = stream.join(consent, subject, "left")
    after = F.col(event_time) >= F.col("consent_changed_at")
    return joined.select(
        *[F.col(c) for c in stream.columns], F.coalesce(F.col("consent_withdrawn") & after, F.lit(False)).alias("blocked")
    )


def reopen(finished: DataFrame, consent: DataFrame, subject: str, event_time: str) -> DataFrame:
    """Finished rows that a late withdrawal turns into blocked ones (batch side of the same rule)."""
    again = block_withdrawn(finished.drop("blocked"), consent, subject, event_time)
    return again.filter("blocked").join(finished.filter("blocked").select(subject, event_time).distinct(), [subject, event_time], "left_anti")
