import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from sparkveil import config
from sparkveil.functions import hashing, noise
from sparkveil.operators import anonymize as an, utility as ut
from sparkveil.plans.numbering import row_numbers

SECRET = bytes(range(1, 65))


@pytest.fixture(scope="module")
def person(spark):
    return spark.createDataFrame(
        [("12345", "John Doe", "123-45-6789", "555-123-4567", "john.doe@email.com", 35, "diabetes", "Austin, TX"),
         ("2", "", "", None, "", 0, None, ""), ("3", None, None, "", None, None, "Rash", "Boston")],
        "id string, patient_name string, ssn string, phone string, email string, age int, diagnosis string, location string",
    )


@pytest.mark.parametrize("k,expected", [
    (3, ("30-39", "123-4****", "555-12****", "chronic_condition", "Austin")),
    (5, ("20-39", "123******", "555*******", "medical_condition", "Region_Generalized")),
    (10, ("20-39", "123******", "555*******", "medical_condition", "Region_Generalized")),
    (15, ("30-59", "***-**-****", "***-***-****", "medical_condition", "Region_Generalized")),
])
def test_ladders(person, k, expected):
    row = an.anonymize(person, config.k_anonymity(k)).filter("id = '12345'").first()
    assert (row["age"], row["ssn"], row["phone"], row["diagnosis"], row["location"]) == expected
    assert row["email"] == "john.doe@email.com"


def test_missing_values_stay(person):
    for settings in (config.k_anonymity(3), config.tokenization(256)):
        row = an.anonymize(person, settings, secret=SECRET).filter("id = '2'").first()
        assert (row["patient_name"], row["ssn"], row["phone"], row["email"], row["location"]) == ("", "", None, "", "")
    noisy = an.anonymize(person, config.differential_privacy(0.1), seed="s").orderBy("id").collect()
    assert [r["age"] for r in noisy][1:] == [0, None]
    assert noisy[2]["ssn"] is None and noisy[2]["phone"].startswith("DP_STRONG_")


@pytest.mark.parametrize("bits,length", [(128, 8), (256, 12), (512, 16)])
def test_tokens_equal_python_hmac(person, bits, length):
    row = an.anonymize(person, config.tokenization(bits), secret=SECRET).filter("id = '12345'").first()
    digest = hmac.new(SECRET[: bits // 8], b"john.doe@email.com", hashlib.sha256).hexdigest()
    assert row["email"] == f"EMAIL_{bits}_{digest[:length]}@tokenized.com"


def test_tokens_join_across_jobs_and_partitions(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("acc"), F.col("id")).alias("account_number"))
    once = an.anonymize(df, config.tokenization(512), secret=SECRET)
    again = an.anonymize(df.repartition(7), config.tokenization(512), secret=SECRET)
    assert once.exceptAll(again).count() == 0
    assert once.select("account_number").distinct().count() == 2000


def test_short_secret_and_missing_parameter():
    with pytest.raises(ValueError):
        an.token(F.lit("x"), 256, b"short")
    with pytest.raises(ValueError):
        config.Anonymization(config.TOKENIZATION)
    with pytest.raises(ValueError):
        config.differential_privacy(0.0)
    assert len(config.grid()) == 11


def test_laplace_moments(spark):
    u = hashing.hash_uniform(F.lit("seed"), F.col("id").cast("string"))
    row = spark.range(60000).select(u.alias("u")).select("u", noise.laplace(F.col("u"), 2.0).alias("x")).agg(
        F.avg("u"), F.avg("x"), F.var_samp("x"), F.min("u"), F.max("u")
    ).first()
    assert abs(row[0] - 0.5) < 0.01 and 0 <= row[3] and row[4] < 1
    assert abs(row[1]) < 0.05
    assert abs(row[2] - 8.0) < 0.4  # 2 b^2


@pytest.mark.parametrize("epsilon", [0.1, 1.0, 2.0])
def test_randomized_response_is_truthful_more_often_with_more_epsilon(spark, epsilon):
    df = spark.range(30000).select(F.col("id").cast("string").alias("id"), F.lit("F").alias("gender"))
    out = an.anonymize(df, config.differential_privacy(epsilon), seed="s").groupBy("gender").count()
    share = {r["gender"]: r["count"] / 30000 for r in out.collect()}
    truth = math.exp(epsilon) / (math.exp(epsilon) + 2)
    assert abs(share["F"] - truth) < 0.02
    assert abs(share["M"] - share["Other"]) < 0.02


def test_noise_bounds(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 100 + 1).cast("int").alias("age"), F.lit(1.0).alias("transaction_amount"))
    row = an.anonymize(df, config.differential_privacy(0.1), seed="s").agg(F.min("age"), F.max("age"), F.min("transaction_amount")).first()
    assert row[0] == 0 and row[1] <= 120 and row[2] == 0.0


def test_conditional_and_custom_method(person):
    out = an.anonymize(person, config.k_anonymity(3), where=F.col("id") == "3").orderBy("id").collect()
    assert out[0]["age"] == "35" and out[0]["ssn"] == "123-45-6789"
    assert out[2]["diagnosis"] == "other_condition"
    an.register_method("upper", lambda schema, settings: {"patient_name": F.upper("patient_name")})
    row = an.anonymize(person, config.Anonymization("upper")).filter("id = '12345'").first()
    assert row["patient_name"] == "JOHN DOE"


def test_loss_by_hand(spark):
    df = spark.createDataFrame([("1", 20, "Flu"), ("2", 40, None), ("3", 0, "x")], "id string, age int, diagnosis string")
    loss = {r["id"]: r["information_loss"] for r in ut.record_loss(df, config.k_anonymity(3)).collect()}
    # '20' -> '20-29': 3 edits over 2 characters is capped at 1; 'Flu' -> 'respiratory_infection' is capped at 1.
    assert loss == pytest.approx({"1": 2 / 3, "2": 1 / 3, "3": 1 / 3})
    joined = ut.joined_loss(df, an.anonymize(df, config.k_anonymity(3)), "id")
    assert {r["id"]: r["information_loss"] for r in joined.collect()} == pytest.approx(loss)


def test_loss_of_a_whole_set(spark):
    df = spark.createDataFrame([("1", 20), ("2", 40)], "id string, age int")
    row = ut.dataset_loss(df, config.k_anonymity(15)).first()
    assert (row["records"], row["information_loss"], row["privacy_level"]) == (2, 0.5, pytest.approx(14 / 15))


def test_numeric_loss_uses_the_range(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, None), (4.0, -100.0)], "a double, b double")
    rows = df.select(ut.field_loss(F.col("a"), df.schema["a"].dataType, F.col("b"), df.schema["b"].dataType, F.lit(10.0)).alias("l")).collect()
    assert [r["l"] for r in rows] == pytest.approx([0.1, 1.0, 0.0, 1.0])


def test_privacy_levels():
    assert ut.privacy_level(config.k_anonymity(5)) == pytest.approx(0.8)
    assert ut.privacy_level(config.differential_privacy(1.0)) == pytest.approx(1 - math.exp(-1))
    assert ut.corrected_privacy_level(config.differential_privacy(0.1)) > ut.corrected_privacy_level(config.differential_privacy(2.0))
    assert ut.privacy_level(config.tokenization(1024)) == 1.0


def test_batch_numbers(spark):
    from sparkveil.plans.numbering import batch_numbers

    df = spark.range(2500).select((F.lit(5000) - F.col("id")).alias("k"))
    sizes = batch_numbers(df, ["k"], 1000).groupBy("processing_batch").agg(F.count("*").alias("n"), F.min("k").alias("lo")).orderBy("processing_batch").collect()
    assert [(r["n"]) for r in sizes] == [1000, 1000, 500]
    assert sizes[0]["lo"] == 2501


def test_row_numbers_match_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id").cast("string")).alias("b"), "id")
    expected = df.withColumn("rn", F.row_number().over(Window.orderBy("a", "b", "id")).cast("bigint"))
    assert row_numbers(df, ["a", "b", "id"], "rn").exceptAll(expected).count() == 0
