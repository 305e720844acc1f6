"""Batches that are delivered once, twice, in part, or with other columns."""

import pytest

from sparkveil.sources import appends
from sparkveil.streaming import jobs


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.createDataFrame([(1, "a"), (1, "a")], "n int, t string"), spark.createDataFrame([(2, None)], "n int, t string")
    assert appends.append(one, path, "01") == 2 and appends.append(two, path, "a/b c") == 1 and appends.append(one, path, "01") == 2
    assert _rows(appends.read(spark, path).drop("_batch")) == [(1, "a"), (1, "a"), (2, None)]
    assert {(r["_batch"], r.rows) for r in appends.commits(spark, path).collect()} == {("01", 2), ("a/b c", 1)}


def test_uncommitted_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "n int")
    assert appends.append(df.limit(0), path, "none") == 0
    assert appends.read(spark, path).columns == ["n", "_batch"] and appends.read(spark, path).count() == 0
    appends.append(df, path, "good")
    appends._overwrite(df.selectExpr("n", "'x' AS _delivery", "'failed' AS _batch"), f"{path}/data")  # a job that died before its commit
    assert _rows(appends.read(spark, path)) == [(1, "good")]
    appends.append(df.limit(0), path, "good")  # delivered again, now without rows
    assert appends.read(spark, path).count() == 0


def test_later_batches_may_have_more_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    appends.append(spark.createDataFrame([(1,)], "n int"), path, "a")
    appends.append(spark.createDataFrame([("x", 2)], "t string, n int"), path, "b")
    assert appends.read(spark, path).columns == ["n", "t", "_batch"] and _rows(appends.read(spark, path)) == [(1, None, "a"), (2, "x", "b")]
    with pytest.raises(ValueError):
        appends.append(spark.range(1).selectExpr("id AS _batch"), path, "c")


def test_a_stream_that_starts_over_adds_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    spark.range(60).repartition(6).write.parquet(source)
    for attempt in range(2):
        stream = jobs.file_stream(spark, source, spark.range(1).schema, files_per_trigger=1)
        appends.append_stream(stream, path, str(tmp_path / f"c{attempt}"), "job").awaitTermination()
    assert sorted(r.id for r in appends.read(spark, path).collect()) == list(range(60)) and appends.commits(spark, path).count() == 6
