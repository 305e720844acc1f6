"""Late rows are written aside, partial counts add up, latency histograms merge, and a listener keeps what was observed."""

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from sparkveil.streaming import jobs, late, metrics


def _write(spark, path, *rows):
    df = spark.createDataFrame([(t, k) for t, k in rows], "at string, k string").select(F.to_timestamp("at").alias("at"), "k")
    df.coalesce(1).write.mode("append").parquet(path)


def test_every_row_is_counted_or_late(spark, tmp_path):
    rng, source, path = random.Random(4), str(tmp_path / "in"), str(tmp_path / "w")
    total, want, newest = 0, Counter(), None
    for number in range(6):
        rows = [(f"2024-01-01 {max(0, min(23, number * 4 + rng.randrange(-6, 4))):02d}:{rng.randrange(60):02d}:00", rng.choice("ab")) for _ in range(40)]
        _write(spark, source, *rows, *([(None, "a")] if number == 2 else []))
        total += 40 + (number == 2)
        for at, key in rows:
            hour = int(at[11:13])
            if newest is None or (hour + 1) * 60 > newest - 30:  # minutes of the day
                want[hour, key] += 1
        newest = max([newest or 0] + [int(at[11:13]) * 60 + int(at[14:16]) for at, _ in rows])
    schema = spark.createDataFrame([], "at timestamp, k string").schema

    def stream():
        return jobs.file_stream(spark, source, schema, files_per_trigger=1)

    late.start_windows(stream(), "at", "1 hour", "30 minutes", ("k",), path, str(tmp_path / "c")).awaitTermination()
    counted = late.counted(spark, path, "k")
    aside = late.late_rows(spark, path)
    assert counted.agg(F.sum("n")).first()[0] + aside.count() == total and aside.where("at IS NULL").count() == 1 and aside.count() > 5
    lines = late.progress(spark, path).collect()
    assert sum(r.rows for r in lines) == total and sum(r.late for r in lines) == aside.count()
    assert {(r.window_start.hour, r.k): r.n for r in counted.collect()} == want
    before, n_aside = {tuple(r) for r in counted.collect()}, aside.count()
    late.start_windows(stream(), "at", "1 hour", "30 minutes", ("k",), path, str(tmp_path / "again")).awaitTermination()  # delivered once more
    assert {tuple(r) for r in late.counted(spark, path, "k").collect()} == before and late.late_rows(spark, path).count() == n_aside


def test_histograms_merge_and_bound_quantiles(spark):
    rng = random.Random(6)
    values = [int(10 ** rng.uniform(0, 9)) for _ in range(2000)] + [0, 1, 7, 8, 9, 15, 16, 2**40, -5]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v long, part int")
    whole = {(r.bucket, r.n) for r in metrics.histogram(df, F.col("v")).collect()}
    parts = metrics.merged(metrics.histogram(df, F.col("v"), "part").drop("part"))
    assert {(r.bucket, r.n) for r in parts.collect()} == whole
    for v, b, end in df.select("v", metrics.bucket(F.col("v")), metrics.upper_bound(metrics.bucket(F.col("v")))).collect():
        v = max(v, 0)
        assert v <= end <= max(v * 1.125, v) and (v >= 8 or b == v)
    row = metrics.quantiles(metrics.histogram(df, F.col("v")), (0.5, 0.95, 0.99)).first()
    ordered = sorted(max(v, 0) for v in values)
    for share, got in ((0.5, row.p50), (0.95, row.p95), (0.99, row.p99)):
        exact = ordered[math.ceil(len(ordered) * share) - 1]
        assert exact <= got <= exact * 1.125
    assert metrics.quantiles(metrics.histogram(df.limit(0), F.col("v")), (0.5,)).first().records is None


def test_listener_keeps_what_was_observed(spark, tmp_path):
    log, source = metrics.ProgressLog(), str(tmp_path / "in")
    spark.range(50).repartition(5).write.parquet(source)
    spark.streams.addListener(log)
    try:
        stream = jobs.file_stream(spark, source, spark.range(1).schema, files_per_trigger=1).observe("m", F.count("*").alias("n"), F.max("id").alias("top"))
        jobs.finish(jobs.start_table(stream, str(tmp_path / "o"), str(tmp_path / "c")))
        for _ in range(50):  # reports come a little after the query has ended
            if sum(e[2] for e in log.entries) >= 50:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = [r for r in log.table(spark).collect() if r.rows]
    assert sum(r.metrics["m.n"] for r in rows) == 50 and len({r.batch for r in rows}) == 5 and max(r.metrics["m.top"] for r in rows) == 49
    assert all(0 <= r.overhead <= 1 and r.batch_ms <= r.trigger_ms for r in rows)
