"""Spread a small scan over all cores before CPU-heavy projections."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, min_rows: int = 50_000) -> DataFrame:
    """Repartition a file scan that has fewer partitions than there are cores.

    A file with one row group is read by one task, and tokens, edit distances or text patterns
    then run on one core. A scan with enough partitions, the normal case on big data, is
    returned as it is: no shuffle is added. The row count is read from file footers.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores or scan.count() < min_rows:
        return scan
    return scan.repartition(cores)
