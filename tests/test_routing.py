from pyspark.sql import functions as F

from sparkveil.operators import compliance as co, governance as gv, routing as ro
from sparkveil import schemas as sc

NOW = "2024-01-01 12:00:00"


def decisions(df, column):
    return [(r["d"]["route"], r["d"]["reason"]) for r in df.select("n", column.alias("d")).orderBy("n").collect()]


def test_amount_and_deadline_boundaries(spark):
    df = spark.createDataFrame(
        [(1, "a", 10000.0, "2024-01-02 12:00:00"), (2, "b", 10000.01, "2024-01-02 12:00:00"), (3, "c", 1.0, "2024-01-02 11:59:59"), (4, None, 1.0, None)],
        "n int, id string, amount double, compliance_deadline string",
    )
    rules = ro.adaptive_rules(df.schema, "financial", NOW, ("id", "amount"))
    assert decisions(df, ro.decide(df, rules)) == [
        ("batch", "default_batch_routing"), ("stream", "high_value_transaction"), ("stream", "compliance_deadline_urgent"), ("batch", "incomplete_data")
    ]
    busy = ro.adaptive_rules(df.schema, "financial", NOW, ("id", "amount"), queue_size=1001)
    assert decisions(df, ro.decide(df, busy))[0] == ("stream", "batch_queue_overload")


def test_missing_column_counts_as_incomplete_and_size_rule(spark):
    df = spark.createDataFrame([(1, "x" * 600), (2, "y")], "n int, id string")
    assert decisions(df, ro.decide(df, ro.adaptive_rules(df.schema, "healthcare", NOW, ("id", "timestamp"))))[1] == ("batch", "incomplete_data")
    rules = ro.adaptive_rules(df.schema, "healthcare", NOW, ("id",))
    assert decisions(df, ro.decide(df, rules)) == [("batch", "large_record_size"), ("batch", "default_batch_routing")]


def test_emergency_words(spark):
    df = spark.createDataFrame([(1, "TRUE", None), (2, "no", "Critical"), (3, None, "low")], "n int, emergency_flag string, priority string")
    rules = ro.adaptive_rules(df.schema, "healthcare", NOW, ("n",))
    assert [d[1] for d in decisions(df, ro.decide(df, rules))] == ["healthcare_emergency", "healthcare_emergency", "default_batch_routing"]


def test_regulatory_layer_comes_first_and_can_be_switched_off(spark):
    df = spark.createDataFrame(
        [(1, None, "EU-DE", "payment", True, None), (2, "contract", "FR", "biometric", True, "aes"), (3, None, "US", "payment", True, None), (4, None, "IE", None, False, None)],
        "n int, legal_basis string, data_subject_country string, category string, contains_phi boolean, encryption string",
    )
    default = [ro.RouteRule("default", "true", ro.BATCH, 999)]
    assert [d[1] for d in decisions(df, ro.decide(df, ro.regulatory_rules(NOW), default))] == ["G1", "G2", "H1", "G1"]
    off = ro.decide(df, ro.regulatory_rules(NOW, gdpr=False, hipaa=False), default)
    assert {d[1] for d in decisions(df, off)} == {"default"}
    assert decisions(df, ro.decide(df, []))[0] == ("stream", "fallback")


def test_tree_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b" * 1200)], "n int, note string")
    traits = ro.decide_by_tree(df, co.violations(df, "healthcare"), "n").orderBy("n").collect()
    assert [(r["decision"]["route"], r["decision"]["reason"]) for r in traits] == [("stream", "realtime_processing"), ("batch", "large_record")]
    wide = df.select("*", *[F.lit("x").alias(f"date_{i}") for i in range(3)])
    row = ro.decide_by_tree(wide, co.violations(wide, "healthcare"), "n").first()
    assert row["decision"]["reason"] == "high_complexity" and row["decision"]["characteristics"]["complexity_score"] == 1.4


def test_statistics_add_up(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, ro._to("stream", "a")).otherwise(ro._to("batch", "b")).alias("decision"))
    rows = ro.statistics(df).collect()
    assert sum(r["records"] for r in rows) == 1000 and abs(sum(r["percent"] for r in rows) - 100) < 1e-9


def test_detection_of_schemas():
    assert sc.detect(["patient_name", "diagnosis", "treatment_date"]) == "healthcare"
    assert sc.detect(["name", "email"]) == "customer"
    assert sc.detect(["name"]) is None
    assert sc.detect(["transaction_amount", "transaction_date", "x"]) is None  # 0.533 is not above 0.6
    assert sc.choose("/in/Medical_2024.csv") == "healthcare" and sc.choose("/in/payment_users.csv") == "financial"
    assert sc.choose("/x.csv", sc.FINANCIAL.names) == "financial"
    assert sc.data_type(["sensor_type"]) == "iot" and sc.data_type([]) == "healthcare"
    assert sc.HEALTHCARE.json()["required"] == ["id"] and sc.IOT.pandas()["location_lat"] == "float64"
    assert sc.CUSTOMER.spark()["date_of_birth"].metadata == {"sensitive": True, "rules": ["PII"]}


def test_permissions_and_redaction(spark):
    users = spark.createDataFrame([(1, "u", 1, True), (2, "v", 5, True), (3, "w", 1, False)], "user_id int, username string, role_id int, is_active boolean")
    grants = gv.role_permissions(spark)
    assert grants.count() == 16 + 6 + 6 + 7 + 4 + 6
    assert [r["user_id"] for r in gv.users_allowed(users, grants, "audit", "write").collect()] == [1]
    df = spark.createDataFrame([("admin",), ("security_manager",), ("viewer",), ("data_analyst",), ("guest",)], "role string").select("role", F.lit("Ann-1234").alias("ssn"))
    shown = {r["role"]: r["ssn"] for r in gv.redacted_view(df, sc.HEALTHCARE, F.col("role")).collect()}
    assert shown == {"admin": "Ann-1234", "security_manager": "****1234", "viewer": None, "data_analyst": "Xxx-nnnn", "guest": None}


def test_erasure_and_breach_clock(spark):
    records = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, n int")
    requests = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-02-01"), ("z", "2024-01-01")], "s string, requested_at string").withColumn(
        "requested_at", F.to_date("requested_at"))
    assert [r["n"] for r in gv.erase(records, requests, "s").collect()] == [3]
    row = gv.erasure_status(records, requests, "s", F.lit("2024-01-31").cast("date")).collect()
    assert [(r["s"], r["stored_records"], r["age_days"], r["overdue"]) for r in row] == [("a", 2, 30, False)]
    found = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("y", "2024-01-01 00:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("detected_at"))
    told = spark.createDataFrame([("x", "2024-01-04 00:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("notified_at"))
    rows = {r["k"]: r["overdue"] for r in gv.breach_clock(found, told, "k", F.lit("2024-01-05").cast("timestamp")).collect()}
    assert rows == {"x": False, "y": True}


def test_learned_route_recovers_a_threshold(spark):
    df = spark.range(600).select((F.col("id") % 100).cast("double").alias("size"), F.lit(1.0).alias("other")).withColumn(
        "label", (F.col("size") > 60).cast("double"))
    scored = ro.learned_route(df, ["size", "other"], "label", 100).transform(df)
    wrong = scored.filter("prediction <> label")
    assert wrong.count() <= 18 and wrong.filter("abs(size - 60) > 3").count() == 0


def test_learned_route_scores_records_without_features(spark):
    rows = [(float(i), float(i % 3), float(i > 50)) for i in range(100)] + [(None, 1.0, None), (float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, "size double, other double, label double")
    scored = ro.learned_route(df, ["size", "other"], "label").transform(df)
    assert scored.count() == len(rows) and scored.where("prediction IS NULL").count() == 0


def test_rules_in_error_take_the_fallback(spark):
    df = spark.createDataFrame(
        [("a", "n/a", "5"), ("b", "0", "bad"), ("c", "3", "bad"), ("d", "", "20000"), ("e", None, None), ("f", " 2 ", "20000")],
        "id string, days_to_deadline string, amount string",
    ).withColumn("type", F.lit("financial"))
    layer = ro.operational_rules(df.schema, ("id",))
    got = {r.id: (r.d.route, r.d.reason) for r in df.select("id", ro.decide(df, layer, fallback="review").alias("d")).collect()}
    assert got == {
        "a": ("review", "rule_error"), "b": ("stream", "urgent_deadline"), "c": ("review", "rule_error"),
        "d": ("stream", "high_value_transaction"), "e": ("batch", "default"), "f": ("stream", "high_value_transaction"),
    }
    errors = {r.id: [tuple(x) for x in r.e] for r in df.select("id", ro.rule_errors(df, layer).alias("e")).collect()}
    assert errors["a"] == [("urgent_deadline", "days_to_deadline", "n/a")] and errors["b"] == errors["c"] == [("high_value_transaction", "amount", "bad")]
    assert errors["d"] == errors["e"] == errors["f"] == []
    assert {r.rule: r.hits for r in ro.rule_hits(df, layer).collect()}["urgent_deadline"] == 1


def test_typed_inputs_are_not_tested_again(spark):
    df = spark.createDataFrame([(1, 2.0, True)], "id int, amount double, audit_required boolean").withColumn("type", F.lit("financial"))
    rules = [*ro.operational_rules(df.schema), *ro.regulatory_rules("2024-01-01 00:00:00")]
    assert all(not r.misread(df) for r in rules if r.applies(df))
    late = spark.createDataFrame([("soon",), ("2024-01-01 03:00:00",), ("2030-01-01",)], "compliance_deadline string")
    adaptive = ro.adaptive_rules(late.schema, "other", "2024-01-01 00:00:00", ())
    assert [r.d.reason for r in late.select(ro.decide(late, adaptive).alias("d")).collect()] == ["rule_error", "compliance_deadline_urgent", "default_batch_routing"]
