"""Streams give what the batch form gives, also over several micro-batches, restarts and copies."""

import pytest
from pyspark.sql import functions as F

from sparkveil import config
from sparkveil.operators import flow, generate as gen
from sparkveil.streaming import jobs
from sparkveil.views import stream_view, table, view

SECRET = bytes(range(64))


def at():
    return F.lit("2024-01-01 12:00:00")


@pytest.fixture()
def split_orders(spark, sf, tmp_path):
    folder = str(tmp_path / "orders")
    table(spark, sf, "orders").repartition(5).write.parquet(folder)
    return folder


def text(df):
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j"))


def test_check_over_micro_batches_equals_batch(spark, sf, split_orders):
    stream = stream_view(spark, sf, "v_fin", "orders", files_per_trigger=2, folder=split_orders)
    out = jobs.collect_table(jobs.check(stream, "financial", config.tokenization(256), at(), secret=SECRET), "t1")
    batch = flow.process(view(spark, sf, "v_fin"), "financial", config.tokenization(256), "stream", at(), secret=SECRET)
    assert text(out).exceptAll(text(batch)).count() == 0 and out.count() == batch.count()


def test_restart_continues_and_adds_nothing_twice(spark, sf, split_orders, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = stream_view(spark, sf, "v_fin", "orders", folder=split_orders)
        checked = jobs.check(stream, "financial", config.k_anonymity(5), at())
        jobs.finish(jobs.start_batches(checked, out, checkpoint))
        return spark.read.parquet(f"{out}/data").count()

    n = table(spark, sf, "orders").count()
    assert run() == n
    assert run() == n
    table(spark, sf, "orders").limit(7).write.mode("append").parquet(split_orders)
    assert run() == n + 7


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    body_calls = []
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    for attempt in range(2):  # two checkpoints: the second run delivers the same batch again
        stream = jobs.file_stream(spark, path, spark.range(1).schema)
        jobs.finish(jobs.start_batches(stream, str(tmp_path / "out"), str(tmp_path / f"c{attempt}"), lambda b, i: body_calls.append(i) or b))
    assert spark.read.parquet(str(tmp_path / "out" / "data")).count() == 10
    assert spark.read.parquet(str(tmp_path / "out" / "sizes")).agg(F.sum("batch_size")).first()[0] == 10
    assert body_calls == [0, 0]


def test_running_metrics_over_batches(spark, sf, split_orders):
    stream = stream_view(spark, sf, "v_fin", "orders", files_per_trigger=1, folder=split_orders)
    checked = jobs.check(stream, "financial", config.tokenization(128), at(), secret=SECRET)
    out = jobs.collect_latest(jobs.running_metrics(checked, "is_compliant"), ["is_compliant"], "t5")
    batch = flow.process(view(spark, sf, "v_fin"), "financial", config.tokenization(128), "stream", at(), secret=SECRET)
    assert out.exceptAll(jobs.running_metrics(batch, "is_compliant")).count() == 0 and out.count() == 2


def test_duplicates_across_batches_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    events = spark.range(100).select("id", F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("at"))
    events.coalesce(1).write.parquet(path)
    events.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, events.schema, files_per_trigger=1)
    assert jobs.collect_table(jobs.deduplicate(stream, "id", "at"), "t7").count() == 100


def test_late_rows_count_until_the_watermark_closes_a_window(spark, tmp_path):
    path = str(tmp_path / "in")

    def write(*times):
        rows = spark.createDataFrame([(t,) for t in times], "at string").select(F.to_timestamp("at").alias("at"))
        rows.coalesce(1).write.mode("append").parquet(path)

    checkpoint, out = str(tmp_path / "c"), str(tmp_path / "o")

    def run():
        schema = spark.createDataFrame([], "at timestamp").schema
        counts = jobs.tumbling_counts(jobs.file_stream(spark, path, schema), "at", "1 hour", "30 minutes")
        jobs.finish(jobs.start_table(counts, out, checkpoint))
        return {str(r["window_start"]): r["n"] for r in spark.read.parquet(out).collect()}

    write("2024-01-01 00:10:00", "2024-01-01 01:05:00")
    assert run() == {}
    write("2024-01-01 00:50:00", "2024-01-01 01:40:00")  # late, but within 30 minutes of 01:05
    assert run() == {"2024-01-01 00:00:00": 2}
    write("2024-01-01 00:55:00", "2024-01-01 03:00:00")  # too late: its window is closed
    assert run() == {"2024-01-01 00:00:00": 2, "2024-01-01 01:00:00": 2}


def test_withdrawn_consent_blocks_later_events(spark, tmp_path):
    events = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("c", 5)], "s string, at int")
    changes = spark.createDataFrame([("a", 0, False), ("a", 3, True), ("b", 2, True), ("b", 4, False)], "s string, at int, w boolean")
    consent = jobs.latest_consent(changes, "s", "at", "w")
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), events.schema)
    out = jobs.collect_table(jobs.block_withdrawn(stream, consent, "s", "at"), "t9")
    assert sorted((r["s"], r["at"]) for r in out.filter("blocked").collect()) == [("a", 5)]
    later = jobs.latest_consent(changes.union(spark.createDataFrame([("c", 4, True)], changes.schema)), "s", "at", "w")
    assert [(r["s"], r["at"]) for r in jobs.reopen(out, later, "s", "at").collect()] == [("c", 5)]


def test_rate_limited_records(spark, tmp_path):
    stream = gen.record_stream(spark, "healthcare", 50)
    query = jobs.start_table(stream, str(tmp_path / "out"), str(tmp_path / "c"), every="500 milliseconds")
    try:
        query.awaitTermination(6)
    finally:
        query.stop()
    df = spark.read.parquet(str(tmp_path / "out"))
    assert df.count() > 0 and df.select("id").distinct().count() == df.count()


def test_observed_metrics(spark, sf, tmp_path):
    stream = stream_view(spark, sf, "v_pat", "customer")
    checked = jobs.observed(jobs.check(stream, "healthcare", config.k_anonymity(3), at()))
    query = jobs.start_table(checked, str(tmp_path / "o"), str(tmp_path / "c"))
    jobs.finish(query)
    seen = [p["observedMetrics"]["compliance"] for p in query.recentProgress if "compliance" in p.get("observedMetrics", {})]
    assert sum(s["processed"] for s in seen) == table(spark, sf, "customer").count()
