from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import compliance as co, flow


def found(df, data_type, **kwargs):
    """Violation fields per record, in record order."""
    rows = df.select("n", co.violations(df, data_type, **kwargs).alias("v")).orderBy("n").collect()
    return [[v["field"] for v in r["v"]] for r in rows]


def test_phi(spark):
    df = spark.createDataFrame(
        [
            (1, "123-45-6789", "(555) 123-4567", "a.b@c.org", "MRN123456"),
            (2, "***-**-6789", "555-123-4567", "***@***.com", "MRN12345"),
            (3, None, None, None, None),
            (4, "x 123-45-6789 ***", "(555)123-4567", "nobody", ""),
        ],
        "n int, ssn string, phone string, email string, medical_record_number string",
    )
    assert found(df, "healthcare") == [["ssn", "phone", "email", "medical_record_number"], [], [], ["phone"]]


def test_consent_and_retention_boundaries(spark):
    df = spark.createDataFrame(
        [(1, True, False, "active", 365), (2, None, True, "active", 366), (3, False, True, "done", None), (4, True, None, None, 400)],
        "n int, consent_given boolean, consent_withdrawn boolean, processing_status string, data_retention_days int",
    )
    assert found(df, "financial") == [
        [], ["consent_given", "processing_status", "data_retention_days"], ["consent_given"], ["data_retention_days"]
    ]
    text = df.select(F.explode(co.violations(df, "financial")).alias("v")).filter("v.field = 'data_retention_days'").first()
    assert text["v"]["description"] == "Data retained for 366 days, exceeds limit of 365"
    assert found(df, "financial", book=co.RuleBook(retention_days=366))[1] == ["consent_given", "processing_status"]


def test_card_is_anchored(spark):
    df = spark.createDataFrame(
        [(1, "4000-1234-5678-9010"), (2, "4000123456789010 extra"), (3, "no 4000123456789010"), (4, "4000-1234-5678-9010*"), (5, None)],
        "n int, credit_card string",
    )
    assert found(df, "ecommerce") == [["credit_card"], ["credit_card"], [], [], []]


@pytest.mark.parametrize("lat,lng,hit", [(40.123, -74.0, True), (40.12, -74.01, False), (140.0, 12.0, False), (0.0, 1.2345, False), (1e-5, 1.0, True), (None, 1.234, False)])
def test_location(spark, lat, lng, hit):
    df = spark.createDataFrame([(1, lat, lng)], "n int, location_lat double, location_lng double")
    assert found(df, "iot") == [["location_lat,location_lng"] if hit else []]


def test_alias_unknown_type_and_custom_rule(spark):
    df = spark.createDataFrame([(1, "4000123456789010", False)], "n int, credit_card_number string, consent_marketing boolean")
    assert found(df, "ecommerce") == [[]]
    aliases = {"credit_card": "credit_card_number", "consent_given": "consent_marketing"}
    assert found(df, "ecommerce", aliases=aliases) == [["credit_card", "consent_given"]]
    assert found(df, "no such type", aliases=aliases) == [["consent_given", "credit_card"]]
    rule = co.Rule("odd", "insufficient_anonymization", "n", "low", "BOTH", ("n",), lambda c: c["n"] % 2 == 1, "odd number")
    book = co.RuleBook().register(rule, "ecommerce")
    assert found(df, "ecommerce", book=book) == [["n"]]
    assert "n" in found(df, "all", book=book)[0]


def test_severity_flags_and_empty_set(spark):
    df = spark.createDataFrame([(1, True, 400), (2, False, 1), (3, True, 1)], "n int, consent_given boolean, data_retention_days int")
    rows = co.enrich(df, "financial").orderBy("n").collect()
    assert [r["violation_severity"] for r in rows] == ["medium", "critical", "none"]
    assert [r["has_consent_violation"] for r in rows] == [False, True, False]
    bare = spark.createDataFrame([(1,)], "n int")
    assert found(bare, "financial") == [[]]
    assert bare.select(co.violates(bare, "financial").alias("v")).first()["v"] is False
    assert co.summarize(bare, "financial").count() == 0


def test_quick_check_agrees_with_details(spark, sf):
    from sparkveil.views import view

    for name, kind in (("v_fin", "financial"), ("v_pat", "healthcare"), ("v_ecom", "ecommerce"), ("v_iot", "iot")):
        df = view(spark, sf, name)
        both = df.select(co.violates(df, kind).alias("a"), co.violations(df, kind).alias("v"), co.violation_count(df, kind).alias("n"))
        assert both.filter("a <> (size(v) > 0) OR n <> size(v)").count() == 0


def test_second_catalogue_smoke_record(spark):
    now = datetime(2025, 7, 1)
    df = spark.createDataFrame(
        [("12345", "123-45-6789", False, now - timedelta(days=800), now - timedelta(days=1200), 1095),
         ("2", "", True, now - timedelta(days=730), now - timedelta(days=1095), None),
         ("3", None, True, now - timedelta(days=731), now, 1)],
        "patient_id string, ssn string, consent_status boolean, consent_date timestamp, created_timestamp timestamp, data_retention_days int",
    )
    rows = co.evaluate(df, F.lit(now)).orderBy("patient_id").collect()
    details = {r["record_id"]: [v["violation_details"] for v in r["violations"]] for r in rows}
    assert details["12345"] == [
        "Consent not provided or withdrawn", "Data retention period exceeded (1095 days)", "Exposed PHI fields: ssn"
    ]
    assert details["2"] == []
    assert details["3"] == ["Consent expired (>2 years old)"]


def test_rule_as_batch_function(spark):
    df = spark.createDataFrame([(i, "ab" * i) for i in range(5)], "n int, t string")

    def longest(batch):
        return batch.assign(hit=batch["t"].str.len() > 4)[["n", "hit"]]

    rows = flow.map_records(df, longest, "n int, hit boolean").orderBy("n").collect()
    assert [r["hit"] for r in rows] == [False, False, False, True, True]
