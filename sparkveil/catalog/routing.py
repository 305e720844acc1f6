"""Routing decisions and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkveil.catalog.anonymization import _H52, k_sql, token_sql
from sparkveil.catalog.core import _COUNT_FIN, _PHI, TEST_SECRET, _phi_sql, EMAIL, PHONE
from sparkveil.catalog.registry import query
from sparkveil.config import k_anonymity, tokenization
from sparkveil.operators import anonymize as an, compliance as co, routing as ro
from sparkveil.views import table, view

BASE_TIME = "2024-01-01 12:00:00"


def _notes(spark, sf_dir):
    """Free-text records: the whole text stands in the fields the rules look at."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("patient_name"), F.col("text").alias("email"), F.col("text").alias("phone")
    )


_NOTES = f"""notes AS (SELECT doc_id AS id, source AS patient_name, text AS email, text AS phone FROM documents),
traits AS (SELECT id, length(email) AS n,
  4 * 0.1 + CASE WHEN length(patient_name) > 50 THEN 0.2 ELSE 0 END + CASE WHEN length(email) > 50 THEN 0.4 ELSE 0 END AS complexity,
  (CASE WHEN {_phi_sql('phone', PHONE)} THEN 1 ELSE 0 END) + (CASE WHEN {_phi_sql('email', EMAIL)} THEN 1 ELSE 0 END) AS violations FROM notes)"""


@query("r2_complexity", (), f"WITH {_NOTES} SELECT id, CAST(round(complexity, 1) AS DOUBLE) AS complexity FROM traits")
def complexity(spark, sf_dir):
    df = _notes(spark, sf_dir)
    return df.select("id", F.round(ro.complexity(df), 1).alias("complexity"))


@query("r3_characteristics", ("v_pat",), f"""
SELECT id, CAST(round(1.1, 1) AS DOUBLE) AS complexity, ({' OR '.join(p[0] for p in _PHI)}) AS has_violations, true AS sized FROM v_pat""")
def characteristics(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    found = df.select("*", co.violations(df, "healthcare").alias("v"))
    traits = found.select("id", ro.characteristics(df, F.col("v")).alias("t"))
    return traits.select(
        "id", F.round("t.complexity_score", 1).alias("complexity"), F.col("t.has_violations").alias("has_violations"),
        (F.col("t.size_estimate") > 100).alias("sized"),
    )


# The violation text of two hits is longer than 200 characters, that of one hit is not.
@query("r4_tree", (), f"""
WITH sizes AS (SELECT doc_id AS id, source AS patient_name, text AS email, text AS phone,
  length(CAST(to_json({{'id': doc_id, 'patient_name': source, 'email': text, 'phone': text}}) AS VARCHAR)) AS size FROM documents),
d AS (SELECT id, size, (CASE WHEN {_phi_sql('phone', PHONE)} THEN 1 ELSE 0 END) + (CASE WHEN {_phi_sql('email', EMAIL)} THEN 1 ELSE 0 END) AS violations FROM sizes)
SELECT CAST(id AS VARCHAR) AS record_id, CASE WHEN size > 1000 THEN 'batch' ELSE 'stream' END AS route,
  CASE WHEN size > 1000 THEN 'large_record' WHEN violations > 1 THEN 'urgent_violation' ELSE 'realtime_processing' END AS reason FROM d""")
def tree(spark, sf_dir):
    df = _notes(spark, sf_dir)
    decided = ro.decide_by_tree(df, co.violations(df, "healthcare"), "id")
    return decided.select("decision.record_id", "decision.route", "decision.reason")


@query("r4_tree_financial", ("v_fin",), """
SELECT 'batch' AS route, 'financial_data' AS reason, CAST(count(*) AS BIGINT) AS records FROM v_fin""")
def tree_financial(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin").select("id", "customer_name", "account_number", "transaction_amount", "consent_given")
    decided = ro.decide_by_tree(df, co.violations(df, "financial"), "id")
    return decided.groupBy("decision.route", "decision.reason").agg(F.count("*").alias("records"))


_D = f"({_H52.format(v="id || '_42'")} % 1000)"
_DEADLINE = f"CASE WHEN {_D} % 100 < 20 THEN TIMESTAMP '{BASE_TIME}' + to_hours(CAST({_D} % 23 + 1 AS INTEGER)) ELSE TIMESTAMP '{BASE_TIME}' + to_days(CAST({_D} % 28 + 2 AS INTEGER)) END"


@query("r11_routing_fields", ("v_pat",), f"""
SELECT id, {_DEADLINE} AS compliance_deadline, CASE WHEN {_D} % 100 < 10 THEN 'true' END AS emergency_flag,
  CASE WHEN {_D} % 100 < 10 THEN 'urgent' END AS priority FROM v_pat""")
def routing_fields(spark, sf_dir):
    out = ro.with_routing_fields(view(spark, sf_dir, "v_pat"), "id", "healthcare", BASE_TIME)
    return out.select("id", "compliance_deadline", "emergency_flag", "priority")


@query("r5_adaptive", ("v_fin",), f"""
WITH d AS (SELECT *, {_DEADLINE} AS deadline FROM v_fin)
SELECT id, CASE WHEN deadline < TIMESTAMP '{BASE_TIME}' + INTERVAL 24 HOUR OR transaction_amount > 10000 THEN 'stream' ELSE 'batch' END AS route,
  CASE WHEN deadline < TIMESTAMP '{BASE_TIME}' + INTERVAL 24 HOUR THEN 'compliance_deadline_urgent'
    WHEN transaction_amount > 10000 THEN 'high_value_transaction' ELSE 'default_batch_routing' END AS reason FROM d""")
def adaptive(spark, sf_dir):
    df = ro.with_routing_fields(view(spark, sf_dir, "v_fin"), "id", "financial", BASE_TIME)
    rules = ro.adaptive_rules(df.schema, "financial", BASE_TIME, ("id", "transaction_amount"))
    decided = df.select("id", ro.decide(df, rules).alias("d"))
    return decided.select("id", "d.route", "d.reason")


@query("r5_adaptive_healthcare", ("v_pat",), f"""
WITH d AS (SELECT *, {_DEADLINE} AS deadline, {_D} % 100 < 10 AS alarm FROM v_pat),
r AS (SELECT CASE WHEN deadline < TIMESTAMP '{BASE_TIME}' + INTERVAL 24 HOUR THEN 'compliance_deadline_urgent'
  WHEN alarm THEN 'healthcare_emergency' WHEN coalesce(ssn, '') = '' THEN 'incomplete_data' ELSE 'default_batch_routing' END AS reason FROM d)
SELECT CASE WHEN reason IN ('compliance_deadline_urgent', 'healthcare_emergency') THEN 'stream' ELSE 'batch' END AS route, reason,
  CAST(count(*) AS BIGINT) AS records FROM r GROUP BY 1, 2""")
def adaptive_healthcare(spark, sf_dir):
    df = ro.with_routing_fields(view(spark, sf_dir, "v_pat"), "id", "healthcare", BASE_TIME)
    rules = ro.adaptive_rules(df.schema, "healthcare", BASE_TIME, ("id", "ssn"))
    decided = df.select(ro.decide(df, rules).alias("d"))
    return decided.groupBy("d.route", "d.reason").agg(F.count("*").alias("records"))


def _operational(spark, sf_dir):
    """Transactions with the inputs of the operational and regulatory rules."""
    return view(spark, sf_dir, "v_fin").select(
        "id", F.lit("financial").alias("type"), F.col("transaction_amount").alias("amount"),
        F.expr("cast(id as bigint) % 10").alias("days_to_deadline"),
        F.expr("CASE WHEN cast(id as bigint) % 17 = 0 THEN 'True' END").alias("emergency_flag"),
        F.expr("CASE WHEN consent_given THEN 'contract' END").alias("legal_basis"),
        F.expr("CASE WHEN location IN ('FRANCE', 'GERMANY', 'ROMANIA') THEN 'EU-' || location WHEN location = 'UNITED KINGDOM' THEN 'GB' ELSE location END").alias("data_subject_country"),
        F.expr("CASE cast(id as bigint) % 19 WHEN 0 THEN 'health' WHEN 1 THEN 'biometric' ELSE 'payment' END").alias("category"),
        F.expr("transaction_date + interval 730 days").alias("consent_expiry"),
        F.expr("timestampadd(DAY, data_retention_days, transaction_date)").alias("retention_date"),
        F.expr("cast(id as bigint) % 23 = 0").alias("contains_phi"),
        F.expr("CASE WHEN cast(id as bigint) % 2 = 0 THEN 'aes' END").alias("encryption"),
        F.expr("cast(id as bigint) % 29 = 0").alias("audit_required"),
        F.expr("cast(id as bigint) % 31 = 0").alias("breach_suspected"),
    )


_OPS = """o AS (SELECT id, CAST(id AS BIGINT) AS i, transaction_amount AS amount, consent_given, location, transaction_date, data_retention_days FROM v_fin)"""
_OP_REASON = "CASE WHEN i % 10 < 1 THEN 'urgent_deadline' WHEN amount > 10000 THEN 'high_value_transaction' WHEN i % 17 = 0 THEN 'emergency_flag' ELSE 'default' END"
_ROUTE_OF = "CASE WHEN reason IN ('G3', 'G4', 'default', 'incomplete_data') THEN 'batch' ELSE 'stream' END"
_REG_REASON = f"""CASE
  WHEN NOT consent_given AND location IN ('FRANCE', 'GERMANY', 'ROMANIA') THEN 'G1'
  WHEN i % 19 IN (0, 1) THEN 'G2'
  WHEN transaction_date + INTERVAL 730 DAY < TIMESTAMP '1998-01-01' THEN 'G3'
  WHEN transaction_date + to_days(CAST(data_retention_days AS INTEGER)) < TIMESTAMP '1998-01-01' + INTERVAL 7 DAY THEN 'G4'
  WHEN i % 23 = 0 AND i % 2 <> 0 THEN 'H1' WHEN i % 29 = 0 THEN 'H2' WHEN i % 31 = 0 THEN 'H3' ELSE {_OP_REASON} END"""


@query("r6_rules", ("v_fin",), f"""
WITH {_OPS}, r AS (SELECT id, {_OP_REASON} AS reason FROM o)
SELECT id, {_ROUTE_OF} AS route, reason FROM r""")
def rules(spark, sf_dir):
    df = _operational(spark, sf_dir).select("id", "type", "amount", "days_to_deadline", "emergency_flag")
    decided = df.select("id", ro.decide(df, ro.operational_rules(df.schema, ("id", "amount"))).alias("d"))
    return decided.select("id", "d.route", "d.reason")


@query("r7_regulatory", ("v_fin",), f"""
WITH {_OPS}, r AS (SELECT id, {_REG_REASON} AS reason FROM o)
SELECT id, {_ROUTE_OF} AS route, reason FROM r""")
def regulatory(spark, sf_dir):
    df = _operational(spark, sf_dir)
    operational = [r for r in ro.operational_rules(df.schema, ("id", "amount")) if r.id != "large_record_size"]
    decided = df.select("id", ro.decide(df, ro.regulatory_rules("1998-01-01 00:00:00"), operational).alias("d"))
    return decided.select("id", "d.route", "d.reason")


@query("r8_fallback", ("v_fin",), f"""
WITH {_OPS}, r AS (SELECT CASE WHEN i % 13 = 0 THEN 'rule_error' WHEN i % 23 = 0 AND i % 2 <> 0 THEN 'H1' WHEN i % 29 = 0 THEN 'H2' WHEN i % 31 = 0 THEN 'H3' ELSE 'fallback' END AS reason FROM o)
SELECT 'stream' AS route, reason, CAST(count(*) AS BIGINT) AS records FROM r GROUP BY reason""")
def fallback(spark, sf_dir):
    """GDPR rules switched off; records with an input that is not as declared, and undecided ones, go to the stream."""
    dirty = F.expr("CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'n/a' ELSE CAST(contains_phi AS STRING) END")
    df = _operational(spark, sf_dir).withColumn("contains_phi", dirty)
    decision = ro.decide(df, ro.regulatory_rules("1998-01-01 00:00:00", gdpr=False))
    return df.select(decision.alias("d")).groupBy("d.route", "d.reason").agg(F.count("*").alias("records"))


def _dirty_inputs(spark, sf_dir):
    """Rule inputs as text, some of them not of the declared type, on different places of the chain."""
    return _operational(spark, sf_dir).withColumns({
        "days_to_deadline": F.expr("CASE WHEN CAST(id AS BIGINT) % 37 = 0 THEN 'n/a' WHEN CAST(id AS BIGINT) % 41 = 0 THEN '' ELSE CAST(days_to_deadline AS STRING) END"),
        "amount": F.expr("CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'unknown' ELSE CAST(amount AS STRING) END"),
        "consent_expiry": F.expr("CASE WHEN CAST(id AS BIGINT) % 43 = 0 THEN 'soon' ELSE CAST(consent_expiry AS STRING) END"),
    }).drop("retention_date", "contains_phi", "audit_required", "breach_suspected")


_DIRTY_REASON = """CASE
  WHEN NOT consent_given AND location IN ('FRANCE', 'GERMANY', 'ROMANIA') THEN 'G1' WHEN i % 19 IN (0, 1) THEN 'G2'
  WHEN i % 43 = 0 THEN 'rule_error' WHEN transaction_date + INTERVAL 730 DAY < TIMESTAMP '1998-01-01' THEN 'G3'
  WHEN i % 37 = 0 THEN 'rule_error' WHEN i % 41 <> 0 AND i % 10 < 1 THEN 'urgent_deadline'
  WHEN i % 7 = 0 THEN 'rule_error' WHEN amount > 10000 THEN 'high_value_transaction' WHEN i % 17 = 0 THEN 'emergency_flag' ELSE 'default' END"""


@query("r8_rule_errors", ("v_fin",), f"""
WITH {_OPS}, r AS (SELECT id, {_DIRTY_REASON} AS reason FROM o)
SELECT id, {_ROUTE_OF} AS route, reason FROM r""")
def routed_errors(spark, sf_dir):
    """Both layers over inputs that cannot always be read: a rule in error sends its record to the fallback, unless an earlier one hits."""
    df = _dirty_inputs(spark, sf_dir)
    operational = [r for r in ro.operational_rules(df.schema, ("id",)) if r.id != "large_record_size"]
    return df.select("id", ro.decide(df, ro.regulatory_rules("1998-01-01 00:00:00"), operational).alias("d")).select("id", "d.route", "d.reason")


@query("r8_error_list", ("v_fin",), f"""
WITH {_OPS} SELECT 'high_value_transaction' AS rule, 'amount' AS "column", 'unknown' AS value, CAST(count(*) AS BIGINT) AS records FROM o WHERE i % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'urgent_deadline', 'days_to_deadline', 'n/a', count(*) FROM o WHERE i % 37 = 0 HAVING count(*) > 0
UNION ALL SELECT 'G3', 'consent_expiry', 'soon', count(*) FROM o WHERE i % 43 = 0 HAVING count(*) > 0""")
def error_list(spark, sf_dir):
    """Which rule could not read which value of which column, and how often."""
    df = _dirty_inputs(spark, sf_dir)
    errors = ro.rule_errors(df, ro.regulatory_rules("1998-01-01 00:00:00"), ro.operational_rules(df.schema, ("id",)))
    return df.select(F.inline(errors)).groupBy("rule", "column", "value").agg(F.count("*").alias("records"))


@query("r9_split", ("v_fin",), f"""
WITH {_OPS}, r AS (SELECT id, {_OP_REASON} AS reason FROM o)
SELECT f.id, CASE WHEN r.reason = 'default' THEN 'batch' ELSE 'stream' END AS processed_via,
  CASE WHEN r.reason = 'default' THEN {k_sql(5)['age']} ELSE CAST(f.age AS STRING) END AS age,
  CASE WHEN r.reason = 'default' THEN f.account_number ELSE {token_sql('account_number', 256)} END AS account_number
FROM v_fin f JOIN r ON f.id = r.id""")
def split(spark, sf_dir):
    """One plan: records of the stream route get tokens, those of the batch route are generalized."""
    df = view(spark, sf_dir, "v_fin").select(
        "id", "age", "account_number", F.lit("financial").alias("type"), F.col("transaction_amount").alias("amount"),
        F.expr("cast(id as bigint) % 10").alias("days_to_deadline"),
        F.expr("CASE WHEN cast(id as bigint) % 17 = 0 THEN 'True' END").alias("emergency_flag"),
    )
    via = ro.decide(df, ro.operational_rules(df.schema, ("id", "amount")))["route"]
    routed = df.select("id", "age", "account_number", via.alias("processed_via"))
    batch = an.anonymize(routed, k_anonymity(5), where=F.col("processed_via") == ro.BATCH)
    return an.anonymize(batch, tokenization(256), secret=TEST_SECRET, where=F.col("processed_via") == ro.STREAM)


@query("r10_routing_stats", ("v_fin",), f"""
WITH {_OPS}, r AS (SELECT id, {_REG_REASON} AS reason FROM o)
SELECT {_ROUTE_OF} AS route, reason, CAST(count(*) AS BIGINT) AS records,
  round(count(*) * 100.0 / (SELECT count(*) FROM r), 6) AS percent FROM r GROUP BY 1, 2""")
def routing_stats(spark, sf_dir):
    df = _operational(spark, sf_dir)
    operational = [r for r in ro.operational_rules(df.schema, ("id", "amount")) if r.id != "large_record_size"]
    decided = df.select(ro.decide(df, ro.regulatory_rules("1998-01-01 00:00:00"), operational).alias("decision"))
    return ro.statistics(decided).withColumn("percent", F.round("percent", 6))


@query("r12_rule_hits", ("v_fin",), f"""
WITH {_OPS} SELECT rule, CAST(hits AS BIGINT) AS hits, round(hits / CAST((SELECT count(*) FROM o) AS DOUBLE), 6) AS hit_rate FROM (
SELECT 'G1' AS rule, count(*) AS hits FROM o WHERE NOT consent_given AND location IN ('FRANCE', 'GERMANY', 'ROMANIA')
UNION ALL SELECT 'G2', count(*) FROM o WHERE i % 19 IN (0, 1)
UNION ALL SELECT 'G3', count(*) FROM o WHERE transaction_date + INTERVAL 730 DAY < TIMESTAMP '1998-01-01'
UNION ALL SELECT 'G4', count(*) FROM o WHERE transaction_date + to_days(CAST(data_retention_days AS INTEGER)) < TIMESTAMP '1998-01-01' + INTERVAL 7 DAY
UNION ALL SELECT 'H1', count(*) FROM o WHERE i % 23 = 0 AND i % 2 <> 0
UNION ALL SELECT 'H2', count(*) FROM o WHERE i % 29 = 0
UNION ALL SELECT 'H3', count(*) FROM o WHERE i % 31 = 0) x""")
def hits(spark, sf_dir):
    out = ro.rule_hits(_operational(spark, sf_dir), ro.regulatory_rules("1998-01-01 00:00:00"))
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@query("r12_sla", ("v_audit",), """
SELECT CAST(count(*) FILTER (action_type = 'error') AS BIGINT) AS urgent, CAST(count(*) FILTER (action_type = 'error' AND detail / 20 <= 2.0) AS BIGINT) AS within_limit,
  round(count(*) FILTER (action_type = 'error' AND detail / 20 <= 2.0) / CAST(count(*) FILTER (action_type = 'error') AS DOUBLE), 6) AS sla_share FROM v_audit""")
def sla(spark, sf_dir):
    out = ro.sla_share(view(spark, sf_dir, "v_audit"), F.col("action_type") == "error", F.col("detail") / 20)
    return out.withColumn("sla_share", F.round("sla_share", 6))


@query("r13_sensitivity", ("v_pat",), """
WITH n AS (SELECT id, CASE WHEN coalesce(ssn, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(phone, '') <> '' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(medical_record_number, '') <> '' THEN 1 ELSE 0 END AS filled FROM v_pat)
SELECT id, CASE WHEN filled >= 3 THEN 'batch' ELSE 'stream' END AS route FROM n""")
def sensitivity(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    route = ro.sensitivity_route(df, ["ssn", "phone", "medical_record_number"], 3)
    return df.select("id", route["route"].alias("route"))


@query("r13_volume", ("v_jobs",), """
SELECT job_id, CASE WHEN count(*) OVER (PARTITION BY file_id) > 12 THEN 'batch' ELSE 'stream' END AS route FROM v_jobs""")
def volume(spark, sf_dir):
    return ro.volume_route(view(spark, sf_dir, "v_jobs"), "file_id", 12).select("job_id", "decision.route")


@query("r13_learned", ("v_jobs",))
def learned(spark, sf_dir):
    """Classifier trained on the amount rule; iterative, so it has no SQL twin."""
    df = view(spark, sf_dir, "v_jobs").select(
        "job_id", F.col("records_processed").cast("double").alias("size"),
        F.col("processing_time_seconds").cast("double").alias("seconds"),
        (F.col("records_processed") > 250000).cast("double").alias("label"),
    )
    model = ro.learned_route(df, ["size", "seconds"], "label")
    scored = model.transform(df)
    return scored.groupBy(F.when(F.col("prediction") == 1, ro.BATCH).otherwise(ro.STREAM).alias("route")).agg(
        F.count("*").alias("records"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 2).alias("agreement")
    )


@query("r14_severity", ("v_fin",), """
WITH s AS (SELECT CASE WHEN NOT coalesce(consent_given, false) OR coalesce(consent_withdrawn AND processing_status = 'active', false) THEN 'critical' ELSE 'other' END AS severity FROM v_fin)
SELECT 'stream' AS route, CASE severity WHEN 'critical' THEN 'critical_urgency' ELSE 'default' END AS reason, CAST(count(*) AS BIGINT) AS records FROM s GROUP BY 2""")
def by_severity(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    found = df.select("*", co.violations(df, "financial").alias("v"))
    decided = found.select(ro.severity_route(co.max_severity(F.col("v")), ro.complexity(df)).alias("d"))
    return decided.groupBy("d.route", "d.reason").agg(F.count("*").alias("records"))


@query("r15_violation_first", ("v_fin",), f"""
WITH s AS (SELECT {_COUNT_FIN} > 0 AS bad FROM v_fin)
SELECT CASE WHEN bad THEN 'stream' ELSE 'batch' END AS route, CASE WHEN bad THEN 'violation' ELSE 'high_complexity' END AS reason, CAST(count(*) AS BIGINT) AS records FROM s GROUP BY 1, 2""")
def violation_first(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    decided = df.select(ro.violation_route(co.violates(df, "financial"), ro.complexity(df)).alias("d"))
    return decided.groupBy("d.route", "d.reason").agg(F.count("*").alias("records"))
