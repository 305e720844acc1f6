import random

import pytest
from pyspark.sql import Window, functions as F

from sparkveil import config
from sparkveil.operators import anonymize as an, privacy as pr
from sparkveil.plans.numbering import running_sum

QI = ["age", "gender"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all records share one group; some quasi-identifiers are NULL."""
    return spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, 40).when(F.col("id") % 50 == 1, None).otherwise(18 + F.col("id") % 71).cast("int").alias("age"),
        F.when(F.col("id") % 3 == 0, "M").otherwise(F.element_at(F.array(F.lit("F"), F.lit("Other")), (F.col("id") % 2 + 1).cast("int"))).alias("gender"),
        (F.col("id") % 4).cast("string").alias("diagnosis"),
    )


def sizes(df, columns):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*columns).count().collect()}


def test_suppressed_set_has_k(skewed):
    for k in (2, 20, 60):
        groups = sizes(skewed, QI)
        kept = pr.suppress(skewed, QI, k)
        assert kept.count() == sum(n for n in groups.values() if n >= k)
        assert all(n >= k for n in sizes(kept, QI).values())
        assert pr.completeness(skewed, QI, k).first()["retained"] == kept.count()


@pytest.mark.parametrize("bits", [64, 640, 1 << 22])
def test_suppression_is_the_same_with_any_number_of_bits(skewed, bits):
    kept = pr.suppress(skewed, QI, 20, bits)
    assert kept.columns == skewed.columns
    assert sorted(r["id"] for r in kept.collect()) == sorted(
        r["id"] for r in skewed.join(skewed.groupBy(*QI).count().where("count >= 20").select(
            F.struct(*QI).alias("q")), F.struct(*QI) == F.col("q"), "left_semi").collect()
    )


def test_only_possible_members_of_small_groups_are_flagged(spark):
    """Big groups of 1,000 records and 300 small ones: no member is missed, few others are flagged."""
    df = spark.range(300_300).select(
        F.when(F.col("id") < 300_000, F.col("id") % 300).otherwise(F.col("id")).alias("a"), F.lit(None).cast("string").alias("b"), "id")
    small = pr.group_sizes(df, ["a", "b"]).where("group_size < 5").select(F.struct(F.col("a").cast("string").alias("a"), "b").alias("__qi"))
    flagged = pr.flag_possible(df, ["a", "b"], small, 1 << 16, "maybe")
    counts = flagged.groupBy("maybe", F.expr("id >= 300000").alias("member")).count().collect()
    got = {(r["maybe"], r["member"]): r["count"] for r in counts}
    assert got[True, True] == 300 and (False, True) not in got
    assert got.get((True, False), 0) <= 10_000  # 300 of 65,536 bits are set: about 1.4 of 300 big groups by chance
    plan = pr.suppress(df, ["a", "b"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "Union" in plan


def test_suppression_without_records(spark):
    empty = spark.createDataFrame([], "age int, gender string")
    assert pr.suppress(empty, QI, 5).collect() == []


def test_suppression_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "M", "w", 7, True, 1.0)] * 3 + [(2, "F", "x", 8, False, 2.0)],
                               "age int, gender string, __word string, __bit int, __maybe boolean, `__set` double")
    kept = pr.suppress(df, QI, 2)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "M", "w", 7, True, 1.0)] * 3


def test_lowest_level_is_chosen(skewed):
    levels = pr.ladder_levels(skewed.schema, QI)
    raw, at = pr.generalize_to_k(skewed, levels, 2, 0.05)
    assert at == 0
    general, at = pr.generalize_to_k(skewed, levels, 100, 0.05)
    assert at > 0 and min(sizes(general, QI).values()) >= 100
    assert set(general.columns) == set(skewed.columns)


def test_level_report_matches_single_levels(skewed):
    levels = pr.ladder_levels(skewed.schema, QI)
    for row in pr.level_report(skewed, levels, 30).collect():
        one = skewed.select(*[v.alias(c) for c, v in levels[row["level"]].items()])
        groups = sizes(one, QI)
        assert (row["groups"], row["k_level"], row["records"]) == (len(groups), min(groups.values()), 3000)
        assert row["suppressed"] == sum(n for n in groups.values() if n < 30)


def test_risk(skewed):
    groups = sizes(skewed, QI)
    row = pr.reidentification_risk(skewed, QI).first()
    assert row["max_risk"] == pytest.approx(1 / min(groups.values()))
    assert row["mean_risk"] == pytest.approx(len(groups) / 3000)


def test_linkage_by_hand(spark):
    released = spark.createDataFrame([("20-29", "M"), ("20-29", "M"), ("30-39", "F"), (None, "F")], "age string, gender string")
    known = spark.createDataFrame([("20-29", "M"), ("30-39", "F"), ("30-39", "F"), (None, "F")], "age string, gender string")
    row = pr.linkage_rate(released, known, QI).first()
    assert (row["records"], row["linked"], row["linkage_rate"]) == (4, 3, 0.75)


def test_attribute_inference_by_hand(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "q string, s string")
    row = pr.attribute_inference(df, ["q"], "s").first()
    assert row["accuracy"] == pytest.approx(0.75) and row["baseline_accuracy"] == pytest.approx(0.5)


def test_membership_against_brute_force(spark):
    rng = random.Random(5)
    released = [rng.randrange(0, 40000) for _ in range(120)] + [777] * 60
    candidates = [(rng.randrange(-500, 41000), rng.random() < 0.5) for _ in range(400)] + [(777 + 25, True), (777 - 26, False)]
    row = pr.membership_inference(
        spark.createDataFrame(candidates, "v long, m boolean"), spark.createDataFrame([(v,) for v in released], "v long"), "v", "m", 25
    ).first()
    guess = [(any(abs(v - r) <= 25 for r in released), m) for v, m in candidates]
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == tuple(
        sum(g == a and m == b for g, m in guess) for a, b in ((True, True), (True, False), (False, True), (False, False))
    )


@pytest.mark.parametrize("ranges", [2, 5, 16])
def test_budget_with_a_hot_subject(spark, ranges):
    spending = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise((F.col("id") % 20).cast("string")).alias("subject"),
        ((F.col("id") * 7919) % 2003).alias("at"), F.lit(0.1).alias("eps"),
    )
    out = pr.budget_ledger(spending, "subject", ["at", "id"], F.col("eps"), 30.0, ranges)
    w = Window.partitionBy("subject").orderBy("at", "id")
    expected = spending.select("id", (F.row_number().over(w) * F.lit(0.1).cast("decimal(18,6)")).alias("e"))
    assert out.join(expected, "id").filter("spent <> e OR over_budget <> (e > 30)").count() == 0
    assert out.count() == 2000


def test_exclusive_running_sum(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(50)], "k int, v int")
    rows = running_sum(df, ["k"], {"before": F.col("v")}, ranges=4, inclusive=False).orderBy("k").collect()
    assert [r["before"] for r in rows] == [sum(range(0, 10 * i, 10)) for i in range(50)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert running_sum(empty, ["k"], {"s": F.col("v")}).count() == 0
    assert pr.suppress(spark.createDataFrame([], "age string, gender string"), QI, 3).count() == 0


def test_utilization(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("b", 0.5)], "s string, e double")
    rows = {r["s"]: r for r in pr.budget_use(df, "s", F.col("e"), 2.0).collect()}
    assert rows["a"]["utilization"] == pytest.approx(1.75) and float(rows["a"]["conserved"]) == 0
    assert float(rows["b"]["conserved"]) == 1.5


def test_generalized_records_reach_the_ladder_values(skewed):
    out = an.anonymize(skewed, config.k_anonymity(15), fields=("age",))
    assert set(r["age"] for r in out.select("age").distinct().collect()) == {"0-29", "30-59", "60-89", None}


def test_many_ranges_use_blocks_of_limits(spark):
    """More limits than one comparison tree takes: the two-level lookup gives the same sums."""
    df = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("k"), (F.col("id") % 5).alias("v"))
    out = running_sum(df, ["k"], {"s": F.col("v")}, ranges=400)
    expected = df.select("k", F.sum("v").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert out.select("k", "s").exceptAll(expected).count() == 0 and out.count() == 3000


def test_left_join_to_many(spark):
    from sparkveil.plans.joins import left_join_many

    few = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    many = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, v int")
    rows = left_join_many(few, many, "k").select("k", "t", "v").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "a", 10), (1, "a", 11), (2, "b", None)]


def test_group_stats_keep_null_groups(spark):
    from sparkveil.plans.joins import with_group_stats

    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (None, 5)], "g string, v int")
    rows = with_group_stats(df, ["g"], n=F.count("*")).collect()
    assert sorted((r["v"], r["n"]) for r in rows) == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)]
