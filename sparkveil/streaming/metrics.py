"""Latency as mergeable histograms, and what a listener keeps of a running query.

A histogram has a bucket per value below 8 and eight buckets per power of two above, found by whole-number
arithmetic, so histograms of batches, tasks and queries add up exactly and a quantile read from one is at most an
eighth above the true value.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sparkveil.sources import appends


def bucket(value: Column) -> Column:
    """Bucket of a value of zero or more; negative values count as zero."""
    n = F.greatest(value.cast("bigint"), F.lit(0).cast("bigint"))
    power = F.length(F.bin(n)) - 1
    inside = F.call_function("shiftright", n, (power - 3).cast("int")).bitwiseAND(F.lit(7).cast("bigint"))
    return F.when(n < 8, n.cast("int")).otherwise(((power - 2) * 8 + inside).cast("int"))


def upper_bound(number: Column) -> Column:
    """Greatest value of a bucket."""
    power, inside = F.floor(number / 8).cast("int") + 2, (number % 8).cast("bigint")
    end = F.call_function("shiftleft", inside + F.lit(9).cast("bigint"), (power - 3).cast("int")) - 1
    return F.when(number < 8, number.cast("bigint")).otherwise(end)


def histogram(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(*keys, bucket, n, total): counts per bucket, combined map-side; `total` is the sum of the values."""
    rows = df.select(*keys, value.cast("bigint").alias("__v")).where("__v IS NOT NULL")
    return rows.groupBy(*keys, bucket(F.col("__v")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("__v").alias("total"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Histograms of the same keys added up."""
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def quantiles(histograms: DataFrame, shares: tuple[float, ...], *keys: str) -> DataFrame:
    """(*keys, records, mean, p<share> ..): upper ends of the buckets that hold the shares; a few hundred buckets per key."""
    along = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    cut = histograms.select("*", F.sum("n").over(along).alias("__upto"), F.sum("n").over(whole).alias("__all"))
    names = [f"p{round(share * 100)}" for share in shares]
    reached = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__all") * F.lit(share)), upper_bound(F.col("bucket")))).alias(n) for share, n in zip(shares, names)]
    return cut.groupBy(*keys).agg(F.sum("n").alias("records"), (F.sum("total") / F.sum("n")).alias("mean"), *reached)


def start_latency(stream: DataFrame, value: Column, keys: tuple[str, ...], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the histogram of every micro-batch below `path`, each once."""
    return appends.append_stream(stream, path, checkpoint, "latency", lambda batch, _: histogram(batch, value, *keys), every)


class ProgressLog(StreamingQueryListener):
    """Keeps the last `size` progress reports of all queries: rows, time in and around the batch, and observed metrics."""

    COLUMNS = "query string, batch bigint, rows bigint, batch_ms bigint, trigger_ms bigint, overhead double, metrics map<string,bigint>"

    def __init__(self, size: int = 10_000):
        self.entries: deque = deque(maxlen=size)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        inside, around = p.durationMs.get("addBatch", 0), p.durationMs.get("triggerExecution", 0)
        observed = {f"{name}.{key}": int(value) for name, row in p.observedMetrics.items() for key, value in row.asDict().items() if isinstance(value, (int, bool))}
        share = (around - inside) / around if around else 0.0
        self.entries.append((str(p.id), int(p.batchId), int(p.numInputRows), int(inside), int(around), float(share), observed))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """The reports as a table: latency of a batch, and the share of its trigger spent around it."""
        return spark.createDataFrame(list(self.entries), self.COLUMNS)
