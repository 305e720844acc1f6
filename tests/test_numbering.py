"""Numbers and running sums along an order: results, and what the plan may not hold."""

import random

import pytest
from pyspark.sql import functions as F

from sparkveil.plans.numbering import batch_numbers, row_numbers, running_sum


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [0, 1, 5, 3000])
@pytest.mark.parametrize("ranges", [2, 7, 300])
def test_numbers_for_any_size_and_ranges(spark, rows, ranges):
    df = spark.range(rows).select((F.col("id") * 7919 % 100003).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("t"))
    got = [(r.k, r.n) for r in row_numbers(df, ["k"], "n", ranges).collect()]
    assert sorted(n for _, n in got) == list(range(1, rows + 1)) and [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)


def test_equal_first_keys_nulls_and_texts(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.1 else "same" if rng.random() < 0.6 else rng.choice("abc"), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b int").repartition(5)
    got = [(r.a, r.b) for r in row_numbers(df, ["a", "b"], "n", 9).orderBy("n").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [r.p for r in batch_numbers(df, ["a", "b"], 300, "p").orderBy("a", "b").collect()] == [i // 300 + 1 for i in range(2000)]


def test_one_key_with_most_rows_is_spread(spark):
    """Keys are unique within a partition only, and one partition holds nearly all rows."""
    df = spark.range(4000).select(F.when(F.col("id") < 3800, 1).otherwise(F.col("id")).alias("p"), F.col("id").alias("o"), F.lit(2).alias("v"))
    out = running_sum(df, ["o"], {"s": F.col("v")}, ("p",), ranges=8)
    assert out.where("p = 1").agg(F.max("s"), F.countDistinct("s")).first()[:] == (7600, 3800)
    assert out.where("p <> 1 AND s <> 2").count() == 0


def test_no_job_before_the_action_and_no_top_n(spark):
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("numbering", "plan only")
    before = len(tracker.getJobIdsForGroup("numbering"))
    out = row_numbers(spark.range(1000).withColumnRenamed("id", "k"), ["k"])
    assert len(tracker.getJobIdsForGroup("numbering")) == before
    plan = _plan(out)
    assert "TakeOrdered" not in plan and "CollectLimit" not in plan and "GlobalLimit" not in plan
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.agg(F.max("row_number")).first()[0] == 1000
