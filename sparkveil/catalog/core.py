"""Compliance checks on the derived record sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkveil.catalog.registry import query
from sparkveil.config import tokenization
from sparkveil.operators import anonymize as an, compliance as co
from sparkveil.views import view

# Test secret of the registered queries; a release passes its own.
TEST_SECRET = bytes(range(64))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check, tokenize the violating records, and count by kind in one scan and one aggregate."""
    fin = view(spark, sf_dir, "v_fin", heavy=True)
    found = fin.select("*", co.violations(fin, "financial").alias("violations"))
    violating = F.size("violations") > 0
    safe = an.anonymize(found, tokenization(256), secret=TEST_SECRET, where=violating)
    rows = safe.select("account_number", F.inline("violations"))
    return rows.groupBy("regulation", "severity", "type").agg(
        F.count("*").alias("violations"), F.countDistinct("account_number").alias("accounts")
    )


query("flagship_financial", ("v_fin",), """
SELECT regulation, severity, type, CAST(count(*) AS BIGINT) AS violations, CAST(count(DISTINCT account_number) AS BIGINT) AS accounts
FROM (
  SELECT account_number, 'GDPR' AS regulation, 'critical' AS severity, 'missing_consent' AS type FROM v_fin WHERE NOT consent_given
  UNION ALL
  SELECT account_number, 'GDPR', 'critical', 'unauthorized_access' FROM v_fin WHERE consent_withdrawn AND processing_status = 'active'
  UNION ALL
  SELECT account_number, 'GDPR', 'medium', 'data_retention' FROM v_fin WHERE data_retention_days > 365) x
GROUP BY regulation, severity, type
""")(flagship)

SSN, PHONE = r"\d{3}-\d{2}-\d{4}", r"\(\d{3}\)\s?\d{3}-\d{4}"
EMAIL, MRN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"MRN\d{6,}"
CARD = r"\d{4}-?\d{4}-?\d{4}-?\d{4}"


def _rule_flag(data_type: str, key: str, rule_name: str):
    """Query: record key and whether one rule hits."""

    def build(spark, sf_dir, view_name):
        df = view(spark, sf_dir, view_name)
        rules, columns = co.DEFAULT_BOOK.applicable(df, data_type)
        rule = next(r for r in rules if r.name == rule_name)
        return df.select(key, rule.hits(columns).alias("hit"))

    return build


def _phi_sql(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, '{pattern}') AND NOT contains({column}, '***'), false)"


@query("c1_phi_exposure", ("v_pat",), f"""
SELECT id, {_phi_sql('ssn', SSN)} AS ssn_hit, {_phi_sql('phone', PHONE)} AS phone_hit,
  {_phi_sql('email', EMAIL)} AS email_hit, {_phi_sql('medical_record_number', MRN)} AS medical_record_number_hit
FROM v_pat""")
def phi_exposure(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    columns = {c: F.col(c) for c in df.columns}
    return df.select("id", *[r.hits(columns).alias(f"{r.field}_hit") for r in co.PHI_RULES])


@query("c5_consent", ("v_fin",), "SELECT id, NOT coalesce(consent_given, false) AS hit FROM v_fin")
def consent(spark, sf_dir):
    return _rule_flag("financial", "id", "consent_missing")(spark, sf_dir, "v_fin")


@query("c6_withdrawal", ("v_fin",), """
SELECT id, coalesce(consent_withdrawn AND processing_status = 'active', false) AS hit FROM v_fin""")
def withdrawal(spark, sf_dir):
    return _rule_flag("financial", "id", "consent_withdrawn")(spark, sf_dir, "v_fin")


@query("c7_retention", ("v_fin",), """
SELECT id, CASE WHEN data_retention_days > 365 THEN
  'Data retained for ' || CAST(data_retention_days AS STRING) || ' days, exceeds limit of 365' END AS description FROM v_fin""")
def retention(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    rule, columns = co.retention_rule(), {c: F.col(c) for c in df.columns}
    return df.select("id", F.when(rule.hits(columns), rule.violation(columns)["description"]).alias("description"))


@query("c8_pci", ("v_ecom",), f"""
SELECT order_id, coalesce(regexp_matches(credit_card, '^{CARD}') AND NOT contains(credit_card, '*'), false) AS hit FROM v_ecom""")
def pci(spark, sf_dir):
    return _rule_flag("ecommerce", "order_id", "pci_card")(spark, sf_dir, "v_ecom")


_PRECISE = "(abs({c} * 100 - round({c} * 100)) > 1e-6)"
_LOCATION = (
    "coalesce(location_lat <> 0 AND location_lng <> 0 AND ("
    + _PRECISE.format(c="location_lat") + " OR " + _PRECISE.format(c="location_lng") + "), false)"
)


@query("c9_location", ("v_iot",), f"SELECT reading_id, {_LOCATION} AS hit FROM v_iot")
def location(spark, sf_dir):
    return _rule_flag("iot", "reading_id", "location")(spark, sf_dir, "v_iot")


def _violation_sql(view_name: str, key: str, branches: list[tuple[str, str, str, str, str, str]]) -> str:
    """UNION ALL over (condition, type, field, description SQL, severity, regulation)."""
    parts = [
        f"SELECT {key}, '{kind}' AS type, '{field}' AS field, {text} AS description, "
        f"'{severity}' AS severity, '{law}' AS regulation FROM {view_name} WHERE {condition}"
        for condition, kind, field, text, severity, law in branches
    ]
    return " UNION ALL ".join(parts)


_CONSENT = (
    "NOT coalesce(consent_given, false)", "missing_consent", "consent_given",
    "'Processing personal data without explicit consent'", "critical", "GDPR",
)
_WITHDRAWN = (
    "consent_withdrawn AND processing_status = 'active'", "unauthorized_access", "processing_status",
    "'Processing data after consent withdrawal'", "critical", "GDPR",
)
_RETENTION = (
    "data_retention_days > 365", "data_retention", "data_retention_days",
    "'Data retained for ' || CAST(data_retention_days AS STRING) || ' days, exceeds limit of 365'", "medium", "GDPR",
)
_PHI = [
    (_phi_sql(c, p), "phi_exposure", c, f"'Exposed {label}'", severity, "HIPAA")
    for c, p, label, severity in (
        ("ssn", SSN, "Social Security Number in XXX-XX-XXXX format", "critical"),
        ("phone", PHONE, "Phone number in (XXX) XXX-XXXX format", "high"),
        ("email", EMAIL, "Email address in standard format", "high"),
        ("medical_record_number", MRN, "Medical Record Number", "critical"),
    )
]
_PCI = (
    f"regexp_matches(credit_card, '^{CARD}') AND NOT contains(credit_card, '*')", "phi_exposure", "credit_card",
    "'Exposed credit card number violates PCI-DSS'", "critical", "PCI-DSS",
)
_LOC = (
    _LOCATION, "unauthorized_access", "location_lat,location_lng",
    "'Precise location data without proper anonymization'", "high", "GDPR",
)

_SETS = {
    "healthcare": ("v_pat", "id", _PHI),
    "financial": ("v_fin", "id", [_CONSENT, _WITHDRAWN, _RETENTION]),
    "ecommerce": ("v_ecom", "order_id", [_PCI, _CONSENT, _RETENTION]),
    "iot": ("v_iot", "reading_id", [_LOC, _CONSENT, _RETENTION]),
}
for _type, (_view, _key, _branches) in _SETS.items():

    def _rows(spark, sf_dir, data_type=_type, name=_view, key=_key):
        return co.violation_rows(view(spark, sf_dir, name, heavy=True), data_type, [key])

    query(f"c11_violations_{_type}", (_view,), _violation_sql(_view, _key, _branches))(_rows)

# Any violation without building structs, all rules by the fallback set.
query("c12_quick_check", ("v_fin",), """
SELECT id, (NOT coalesce(consent_given, false) OR coalesce(consent_withdrawn AND processing_status = 'active', false)
  OR coalesce(data_retention_days > 365, false)) AS violating FROM v_fin""")(
    lambda spark, sf_dir: view(spark, sf_dir, "v_fin").transform(
        lambda df: df.select("id", co.violates(df, "unknown-type").alias("violating"))
    )
)


@query("c13_detailed_check", ("v_pat",), f"""
SELECT p.id, CAST(count(v.type) AS BIGINT) AS violations, count(v.type) = 0 AS compliant,
  coalesce(string_agg(v.field, ',' ORDER BY CASE v.field WHEN 'ssn' THEN 1 WHEN 'phone' THEN 2 WHEN 'email' THEN 3 ELSE 4 END), '') AS fields
FROM v_pat p LEFT JOIN ({_violation_sql('v_pat', 'id', _PHI)}) v ON p.id = v.id GROUP BY p.id""")
def detailed_check(spark, sf_dir):
    found = co.detect(view(spark, sf_dir, "v_pat"), "healthcare")
    return found.select(
        "id", F.size("violations").cast("bigint").alias("violations"), "compliant",
        F.array_join(F.transform("violations", lambda v: v["field"]), ",").alias("fields"),
    )


@query("c14_summary", ("v_fin",), f"""
WITH v AS ({_violation_sql('v_fin', 'id', [_CONSENT, _WITHDRAWN, _RETENTION])})
SELECT 'severity' AS dimension, severity AS value, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY severity
UNION ALL SELECT 'regulation', regulation, count(*) FROM v GROUP BY regulation
UNION ALL SELECT 'type', type, count(*) FROM v GROUP BY type
UNION ALL SELECT 'total', 'all', count(*) FROM v""")
def summary(spark, sf_dir):
    return co.summarize(view(spark, sf_dir, "v_fin"), "financial")


@query("c14_breakdown_healthcare", ("v_pat",), f"""
SELECT regulation, severity, type, CAST(count(*) AS BIGINT) AS n FROM ({_violation_sql('v_pat', 'id', _PHI)}) v
GROUP BY regulation, severity, type""")
def summary_healthcare(spark, sf_dir):
    return co.breakdown(view(spark, sf_dir, "v_pat"), "healthcare")


@query("c15_enriched", ("v_pat",), f"""
WITH v AS ({_violation_sql('v_pat', 'id', _PHI)})
SELECT p.id, CAST(count(v.type) AS BIGINT) AS compliance_violations, count(v.type) = 0 AS is_compliant,
  coalesce(bool_or(v.type = 'phi_exposure'), false) AS has_phi_exposure,
  coalesce(bool_or(v.type = 'missing_consent'), false) AS has_consent_violation,
  CASE max(CASE v.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END)
    WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS violation_severity
FROM v_pat p LEFT JOIN v ON p.id = v.id GROUP BY p.id""")
def enriched(spark, sf_dir):
    out = co.enrich(view(spark, sf_dir, "v_pat"), "healthcare")
    return out.select(
        "id", F.col("compliance_violations").cast("bigint").alias("compliance_violations"), "is_compliant",
        "has_phi_exposure", "has_consent_violation", "violation_severity",
    )


@query("c16_max_severity", ("v_fin",), f"""
WITH s AS (SELECT id, CASE
  WHEN NOT coalesce(consent_given, false) OR coalesce(consent_withdrawn AND processing_status = 'active', false) THEN 'critical'
  WHEN coalesce(data_retention_days > 365, false) THEN 'medium' ELSE 'none' END AS severity FROM v_fin)
SELECT severity, CAST(count(*) AS BIGINT) AS records FROM s GROUP BY severity""")
def by_max_severity(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    found = df.select(co.violations(df, "financial").alias("v"))
    return found.groupBy(co.max_severity(F.col("v")).alias("severity")).agg(F.count("*").alias("records"))


_COUNT_FIN = """(CAST(NOT coalesce(consent_given, false) AS INT)
  + CAST(coalesce(consent_withdrawn AND processing_status = 'active', false) AS INT)
  + CAST(coalesce(data_retention_days > 365, false) AS INT))"""


@query("c17_totals", ("v_fin",), f"""
SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS violating_records,
  CAST(sum(v) AS BIGINT) AS violations, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS violation_rate
FROM (SELECT {_COUNT_FIN} AS v FROM v_fin) x""")
def check_totals(spark, sf_dir):
    out = co.totals(view(spark, sf_dir, "v_fin"), "financial")
    return out.withColumn("violation_rate", F.round("violation_rate", 6))


@query("c18_has_pii", ("v_pat",), """
SELECT id, coalesce(ssn, '') <> '' OR coalesce(phone, '') <> '' OR coalesce(email, '') <> ''
  OR coalesce(patient_name, '') <> '' OR coalesce(medical_record_number, '') <> '' AS has_pii FROM v_pat""")
def pii(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    return df.select("id", co.has_pii(df).alias("has_pii"))


@query("c19_violation_types", ("v_fin",), """
SELECT id, CASE
  WHEN NOT coalesce(consent_given, false) THEN 'missing_consent'
  WHEN coalesce(consent_withdrawn AND processing_status = 'active', false) OR data_retention_days > 365 THEN 'compliance_violation'
  ELSE '' END AS stored_types FROM v_fin""")
def types_of_record(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    found = df.select("id", co.violations(df, "financial").alias("v"))
    return found.select("id", F.array_join(co.stored_violation_types(F.col("v")), ",").alias("stored_types"))


@query("c20_score", ("v_fin",), f"SELECT id, round(1.0 - {_COUNT_FIN} / 5.0, 6) AS score FROM v_fin")
def record_score(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    return df.select("id", F.round(co.score(co.violation_count(df, "financial")), 6).alias("score"))


@query("c21_report", ("v_fin",), f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid_records,
  CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_records,
  round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS violation_rate
FROM (SELECT {_COUNT_FIN} AS v FROM v_fin) x""")
def check_report(spark, sf_dir):
    out = co.totals(view(spark, sf_dir, "v_fin"), "financial")
    return out.select(
        F.col("records").alias("total"),
        (F.col("records") - F.col("violating_records")).alias("valid_records"),
        F.col("violating_records").alias("invalid_records"),
        F.round(F.col("violations") / F.col("records"), 6).alias("violation_rate"),
    )


@query("c21_violation_sample", ("v_fin",), f"""
SELECT * FROM ({_violation_sql('v_fin', 'id', [_CONSENT, _WITHDRAWN, _RETENTION])}) v ORDER BY id, type, field LIMIT 10""")
def sample(spark, sf_dir):
    return co.violation_sample(view(spark, sf_dir, "v_fin"), "financial", "id")


@query("c22_dataset_flags", ("v_fin",), f"""
SELECT id, true AS compliance_checked, TIMESTAMP '2024-01-01 12:00:00' AS compliance_timestamp, {_COUNT_FIN} > 0 AS has_violations FROM v_fin""")
def dataset_flags(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    return co.flag_dataset(df, "financial", at).select(
        "id", "compliance_checked", "compliance_timestamp", "has_violations"
    )


# ---- second catalogue; the reference time is the newest date of the table

def _consent_view(spark, sf_dir):
    df = view(spark, sf_dir, "v_consent", heavy=True)
    newest = df.agg(F.max("treatment_date").alias("t")).scalar()
    return df, newest


_REF = "(SELECT max(treatment_date) FROM v_consent)"
_C28 = f"""CASE WHEN NOT coalesce(consent_status, false) THEN 'Consent not provided or withdrawn'
  WHEN consent_date < {_REF} - INTERVAL 730 DAY THEN 'Consent expired (>2 years old)' END"""
_C29 = f"""CASE WHEN {_REF} > coalesce(created_timestamp, treatment_date) + to_days(CAST(coalesce(data_retention_days, 1095) AS INTEGER))
  THEN 'Data retention period exceeded (' || CAST(coalesce(data_retention_days, 1095) AS STRING) || ' days)' END"""
_ANY = "|".join(f"(?:{p})" for p in (SSN, PHONE, EMAIL))
_C30_LIST = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN regexp_matches({c}, '{_ANY}') THEN '{c}' END" for c in ("ssn", "phone", "email", "medical_record_number")
) + ")"
_C30 = f"CASE WHEN {_C30_LIST} <> '' THEN 'Exposed PHI fields: ' || {_C30_LIST} END"


@query("c28_consent_expiry", ("v_consent",), f"SELECT order_key, {_C28} AS detail FROM v_consent")
def consent_expiry(spark, sf_dir):
    df, newest = _consent_view(spark, sf_dir)
    return df.select("order_key", co.consent_validity(df, newest).alias("detail"))


@query("c29_retention_age", ("v_consent",), f"SELECT order_key, {_C29} AS detail FROM v_consent")
def retention_age(spark, sf_dir):
    df, newest = _consent_view(spark, sf_dir)
    return df.select("order_key", co.retention_by_age(df, newest).alias("detail"))


@query("c30_phi_cross", ("v_consent",), f"SELECT order_key, {_C30} AS detail FROM v_consent")
def phi_cross(spark, sf_dir):
    df = view(spark, sf_dir, "v_consent")
    return df.select("order_key", co.phi_cross_scan(df).alias("detail"))


def _catalogue_sql(entries) -> str:
    record = "coalesce(patient_id, customer_id) AS record_id, order_key"
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT {record}, '{rule}' AS rule, '{law}' AS regulation, '{text}' AS description, {detail} AS violation_details FROM v_consent) x WHERE violation_details IS NOT NULL"
        for rule, law, text, detail in entries
    )


_ENTRIES = [
    ("consent_validity", "GDPR", "Check if consent is valid and not expired", _C28),
    ("data_retention", "GDPR", "Check if data retention period is exceeded", _C29),
    ("phi_exposure", "HIPAA", "Check for exposed PHI identifiers", _C30),
]
for _law, _chosen in (("both", _ENTRIES), ("gdpr", _ENTRIES[:2]), ("hipaa", _ENTRIES[2:])):

    def _evaluate(spark, sf_dir, law=_law):
        df, newest = _consent_view(spark, sf_dir)
        return co.evaluate(df, newest, law).select("record_id", "order_key", F.inline("violations"))

    query(f"c31_by_regulation_{_law}", ("v_consent",), _catalogue_sql(_chosen))(_evaluate)


@query("c32_declared_rules", ("v_consent",), """
SELECT rule, regulation, CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS hits
FROM v_consent, (VALUES ('data_minimization', 'GDPR'), ('cross_border_transfer', 'GDPR'), ('minimum_necessary', 'HIPAA'), ('access_controls', 'HIPAA')) r(rule, regulation)
GROUP BY rule, regulation""")
def declared_rules(spark, sf_dir):
    """Rules declared without a check: listed with the records they would cover and no hits."""
    listed = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(law).alias("regulation"))
        for n, law, _ in co.CATALOGUE if n in co.DECLARED_ONLY
    ])
    counted = view(spark, sf_dir, "v_consent").agg(F.count("*").alias("records"))
    return counted.select("records", F.inline(listed)).select(
        "rule", "regulation", "records", F.lit(0).cast("bigint").alias("hits")
    )
