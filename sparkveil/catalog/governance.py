"""Free text, schema detection, permissions, masking, transfers, erasure and breach clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkveil import schemas as sc
from sparkveil.catalog.core import CARD, EMAIL, MRN, PHONE, SSN
from sparkveil.catalog.registry import query
from sparkveil.functions import text as tx
from sparkveil.functions.patterns import SAFE_HARBOR_PATTERNS
from sparkveil.operators import compliance as co, governance as gv
from sparkveil.plans.spread import spread
from sparkveil.views import table, view

_P = {"ssn": SSN, "phone": PHONE, "email": EMAIL, "medical_record_number": MRN, "credit_card": CARD}


def _hits(column: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS INTEGER)"


# ----------------------------------------------------------------------------- free text

for _table, _key, _column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):

    def _scan(spark, sf_dir, name=_table, key=_key, column=_column):
        return tx.scan(spread(table(spark, sf_dir, name), 1000), column, [key])

    query(f"c23_text_phi_{_table}", (), f"SELECT {_key}, " + ", ".join(
        f"{_hits(_column, p)} AS {n}_hits" for n, p in _P.items()
    ) + f" FROM {_table}")(_scan)


@query("c23_text_phi_conversations", (), " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, CAST(count(*) FILTER (h > 0) AS BIGINT) AS records, CAST(sum(h) AS BIGINT) AS hits FROM (SELECT {_hits('text', p)} AS h FROM conversations) x" for n, p in _P.items()))
def conversations(spark, sf_dir):
    return tx.pattern_totals(table(spark, sf_dir, "conversations"), "text")


@query("c23_text_matches", (), " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for n, p in _P.items()))
def matches(spark, sf_dir):
    return tx.matches(spread(table(spark, sf_dir, "documents"), 1000), "text", ["doc_id"])


def _mask_sql(column: str) -> str:
    for n, p in _P.items():
        column = f"regexp_replace({column}, '{p}', '[{n.upper()}]', 'g')"
    return column


@query("c23_text_masked", (), f"SELECT doc_id, sha256({_mask_sql('text')}) AS masked_hash, CAST(length({_mask_sql('text')}) AS INTEGER) AS masked_length FROM documents")
def masked(spark, sf_dir):
    df = spread(table(spark, sf_dir, "documents"), 1000).select("doc_id", tx.mask(F.col("text")).alias("m"))
    return df.select("doc_id", F.sha2("m", 256).alias("masked_hash"), F.length("m").alias("masked_length"))


_SH = {"date": r"\b\d{4}-\d{2}-\d{2}\b", "url": r"https?://[^\s\"''<>]+", "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"}


@query("c24_safe_harbor_scan", (), " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, CAST(count(*) FILTER (h > 0) AS BIGINT) AS records, CAST(sum(h) AS BIGINT) AS hits FROM (SELECT {_hits('html', p)} AS h FROM pages) x" for n, p in _SH.items()))
def safe_harbor_scan(spark, sf_dir):
    return tx.pattern_totals(table(spark, sf_dir, "pages"), "html", SAFE_HARBOR_PATTERNS)


@query("c24_safe_harbor", ("v_pat",), """
SELECT id, CASE WHEN age > 89 THEN '90+' ELSE CAST(age AS VARCHAR) END AS age, substr(lpad(id, 5, '0'), 1, 3) AS zip3,
  CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN substr(lpad(id, 5, '0'), 1, 3) ELSE '000' END AS zip3_small,
  'seen ' || CAST(2000 + CAST(id AS BIGINT) % 20 AS VARCHAR) || ' at [URL] from [IP_ADDRESS]' AS note FROM v_pat""")
def safe_harbor(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    number = F.col("id").cast("bigint")
    note = F.concat(
        F.lit("seen "), (number % 20 + 2000).cast("string"), F.lit("-03-15 at https://h.example/p?x="), F.col("id"),
        F.lit(" from 10.0.0."), (number % 250).cast("string"),
    )
    zip_code, population = F.lpad("id", 5, "0"), F.when(number % 3 == 0, 50000).otherwise(1000)
    return df.select(
        "id", tx.capped_age(F.col("age")).alias("age"), tx.short_zip(zip_code).alias("zip3"),
        tx.short_zip(zip_code, population).alias("zip3_small"), tx.safe_harbor(note).alias("note"),
    )


# ------------------------------------------------------------------------- documented rules


@query("c25_minimization", ("v_fin",), """
SELECT 'consent_withdrawn' AS field, false AS is_sensitive, CAST(count(*) FILTER (consent_withdrawn) AS BIGINT) AS filled FROM v_fin
UNION ALL SELECT 'processing_status', false, count(*) FILTER (processing_status <> '') FROM v_fin
UNION ALL SELECT 'age', true, count(*) FILTER (age <> 0) FROM v_fin""")
def minimization(spark, sf_dir):
    return gv.minimization(view(spark, sf_dir, "v_fin"), sc.FINANCIAL, ("age", "ssn", "phone", "email"))


@query("c26_cross_border", ("v_fin",), """
WITH t AS (SELECT f.id, f.consent_given, a.n_regionkey AS r1, b.n_regionkey AS r2, CAST(f.id AS BIGINT) % 3 = 0 AS contract
  FROM v_fin f JOIN nation a ON f.location = a.n_name LEFT JOIN nation b ON b.n_nationkey = CAST(f.id AS BIGINT) % 25)
SELECT id FROM t WHERE r1 = 3 AND coalesce(r2, -1) <> 3 AND NOT consent_given AND NOT contract""")
def cross_border(spark, sf_dir):
    """Transfers out of one region; a third of them rest on a contract."""
    nation = table(spark, sf_dir, "nation")
    targets = nation.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("target"))
    df = view(spark, sf_dir, "v_fin").withColumn("k", F.col("id").cast("bigint") % 25).join(targets, "k")
    countries = nation.select(F.col("n_name").alias("country"), (F.col("n_regionkey") == 3).alias("protected"))
    basis = F.when(F.col("id").cast("bigint") % 3 == 0, "contract")
    return gv.cross_border(df, countries, "location", "target", F.col("consent_given"), basis).select("id")


def _requests(spark, sf_dir):
    """All requests of subjects; those for erasure are the ones that count."""
    return view(spark, sf_dir, "v_requests").where("kind = 'erasure'").select("customer_name", "requested_at")


_REQUESTS = "req AS (SELECT customer_name, min(requested_at) AS requested_at FROM v_requests WHERE kind = 'erasure' GROUP BY 1)"


@query("c27_erasure", ("v_fin", "v_requests"), f"WITH {_REQUESTS} SELECT id FROM v_fin WHERE customer_name NOT IN (SELECT customer_name FROM req)")
def erasure(spark, sf_dir):
    return gv.erase(view(spark, sf_dir, "v_fin"), _requests(spark, sf_dir), "customer_name").select("id")


@query("c27_erasure_status", ("v_fin", "v_requests"), f"""
WITH {_REQUESTS}, s AS (SELECT customer_name, count(*) AS n FROM v_fin GROUP BY 1)
SELECT r.customer_name, r.requested_at, CAST(s.n AS BIGINT) AS stored_records, CAST(date_diff('day', CAST(r.requested_at AS DATE), DATE '1998-01-01') AS INTEGER) AS age_days,
  date_diff('day', CAST(r.requested_at AS DATE), DATE '1998-01-01') > 30 AS overdue FROM req r JOIN s ON r.customer_name = s.customer_name""")
def erasure_status(spark, sf_dir):
    at = F.lit("1998-01-01").cast("date")
    return gv.erasure_status(view(spark, sf_dir, "v_fin"), _requests(spark, sf_dir), "customer_name", at)


@query("x11_breach_clock", ("v_audit",), """
WITH d AS (SELECT user_id, min(created_at) AS detected_at FROM v_audit WHERE action_type = 'error' GROUP BY 1),
n AS (SELECT a.user_id, min(a.created_at) AS notified_at FROM v_audit a JOIN d ON a.user_id = d.user_id WHERE action_type = 'purchase' AND a.created_at >= d.detected_at GROUP BY 1)
SELECT d.user_id, d.detected_at, n.notified_at, round(date_sub('second', d.detected_at, coalesce(n.notified_at, TIMESTAMP '2024-02-01')) / 3600.0, 6) AS hours,
  date_sub('second', d.detected_at, coalesce(n.notified_at, TIMESTAMP '2024-02-01')) / 3600.0 > 72 AS overdue FROM d LEFT JOIN n ON d.user_id = n.user_id""")
def breach_clock(spark, sf_dir):
    audit = view(spark, sf_dir, "v_audit")
    found = audit.filter("action_type = 'error'").groupBy("user_id").agg(F.min("created_at").alias("detected_at"))
    notices = audit.filter("action_type = 'purchase'").select("user_id", F.col("created_at").alias("notified_at"))
    out = gv.breach_clock(found, notices, "user_id", F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.withColumn("hours", F.round("hours", 6))


# ------------------------------------------------------------------ permissions and masking

_GRANTS_SQL = "rp AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r}', '{p}', '{p.split('_')[0]}', '{p.split('_')[1]}')" for i, r in enumerate(gv.ROLES, 1) for p in gv.GRANTS[r]
) + ") t(role_id, role_code, permission_code, resource_type, action))"


@query("j1_permissions", ("v_users",), f"""
WITH {_GRANTS_SQL} SELECT u.user_id, u.username, rp.role_code, rp.permission_code, rp.resource_type, rp.action FROM v_users u JOIN rp ON u.role_id = rp.role_id WHERE u.is_active""")
def permissions(spark, sf_dir):
    return gv.user_permissions(view(spark, sf_dir, "v_users"), gv.role_permissions(spark))


@query("j9_user_roles", ("v_users",), "WITH r AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r}')" for i, r in enumerate(gv.ROLES, 1)) + """) t(role_id, role_code))
SELECT u.user_id, u.username, r.role_code FROM v_users u JOIN r ON u.role_id = r.role_id""")
def user_roles(spark, sf_dir):
    return gv.users_with_roles(view(spark, sf_dir, "v_users"), gv.roles(spark))


@query("j10_role_grants", ("v_users",), f"""
WITH {_GRANTS_SQL}, n AS (SELECT role_id, count(*) AS users FROM v_users GROUP BY 1)
SELECT rp.role_code, rp.permission_code, CAST(n.users AS BIGINT) AS users FROM rp JOIN n ON rp.role_id = n.role_id""")
def role_grants(spark, sf_dir):
    """Seeded grants with the users that hold them."""
    held = view(spark, sf_dir, "v_users").groupBy("role_id").agg(F.count("*").alias("users"))
    return gv.role_permissions(spark).join(held, "role_id").select("role_code", "permission_code", "users")


@query("j12_permission_check", ("v_users",), f"""
WITH {_GRANTS_SQL} SELECT user_id FROM v_users u WHERE is_active AND EXISTS (SELECT 1 FROM rp WHERE rp.role_id = u.role_id AND resource_type = 'audit' AND action IN ('read', 'admin'))""")
def permission_check(spark, sf_dir):
    return gv.users_allowed(view(spark, sf_dir, "v_users"), gv.role_permissions(spark), "audit", "read").select("user_id")


@query("v1_permission_counts", ("v_users",), f"""
WITH {_GRANTS_SQL} SELECT rp.role_code, rp.resource_type, CAST(count(DISTINCT u.user_id) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS grants
FROM v_users u JOIN rp ON u.role_id = rp.role_id WHERE u.is_active GROUP BY 1, 2""")
def permission_counts(spark, sf_dir):
    return gv.user_permissions(view(spark, sf_dir, "v_users"), gv.role_permissions(spark)).groupBy("role_code", "resource_type").agg(
        F.count_distinct("user_id").alias("users"), F.count("*").alias("grants")
    )


_ROLE = "CASE CAST(id AS BIGINT) % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(gv.ROLES)) + " END"
_LEVEL = f"CASE WHEN {_ROLE} IN ('admin', 'compliance_officer') THEN 'full' WHEN {_ROLE} = 'security_manager' THEN 'partial' WHEN {_ROLE} = 'viewer' THEN 'none' ELSE 'masked' END"


def _redact_sql(c: str) -> str:
    masked = f"regexp_replace(regexp_replace(regexp_replace({c}, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"
    return f"CASE {_LEVEL} WHEN 'full' THEN {c} WHEN 'partial' THEN '****' || right({c}, CAST(least(4, length({c}) // 2) AS INTEGER)) WHEN 'masked' THEN {masked} END"


def _reader(df):
    return F.expr(_ROLE)


@query("v2_masked_view", ("v_pat",), f"SELECT id, {_redact_sql('patient_name')} AS patient_name, {_redact_sql('ssn')} AS ssn, age FROM v_pat")
def masked_view(spark, sf_dir):
    """Each record as a reader of one of the six roles sees it."""
    df = view(spark, sf_dir, "v_pat")
    return gv.redacted_view(df, sc.HEALTHCARE, _reader(df)).select("id", "patient_name", "ssn", "age")


@query("v2_strict_view", ("v_pat",), f"SELECT id, {_redact_sql('patient_name')} AS patient_name, {_redact_sql('gender')} AS gender, {_redact_sql('location')} AS location FROM v_pat")
def strict_view(spark, sf_dir):
    """As above, with columns that no schema declares hidden like sensitive ones."""
    df = view(spark, sf_dir, "v_pat")
    return gv.redacted_view(df, sc.HEALTHCARE, _reader(df), strict=True).select("id", "patient_name", "gender", "location")


@query("v2_row_filter", ("v_files",), "SELECT file_id FROM v_files WHERE file_id % 6 IN (0, 2) OR coalesce(created_by = file_id, false)")
def row_filter(spark, sf_dir):
    df = view(spark, sf_dir, "v_files")
    role = F.expr(_ROLE.replace("CAST(id AS BIGINT)", "file_id"))
    return gv.row_filter(df, role, F.col("created_by"), F.col("file_id")).select("file_id")


@query("v4_audit_append", ("v_audit",), """
SELECT id, action_type, '{"user":' || CAST(user_id AS VARCHAR) || ',"action":"' || action_type || '"}' AS details FROM v_audit""")
def audit_append(spark, sf_dir):
    """Audit rows with JSON details, as they are appended."""
    df = view(spark, sf_dir, "v_audit")
    return df.select("id", "action_type", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("action_type").alias("action"))).alias("details"))


# ------------------------------------------------------------------------ schema detection


def _catalogue(spark, sf_dir):
    """Columns of the derived record sets, one row per record set and column, plus each table's record count."""
    parts = None
    for name in ("v_fin", "v_pat", "v_ecom", "v_iot", "v_users"):
        df = view(spark, sf_dir, name)
        names = F.array(*[F.lit(c) for c in df.columns])
        one = df.agg(F.count("*").alias("records")).select(F.lit(name).alias("table_name"), "records", F.explode(names).alias("column_name"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("m4_detect", ("v_fin", "v_pat", "v_ecom", "v_iot", "v_users"), """
WITH d AS (SELECT * FROM (VALUES ('v_fin', 'financial', 1.0), ('v_pat', 'healthcare', 0.666667), ('v_ecom', NULL, NULL), ('v_iot', NULL, NULL), ('v_users', NULL, NULL)) t(table_name, schema_name, score)),
n AS (SELECT 'v_fin' AS t, count(*) AS n FROM v_fin UNION ALL SELECT 'v_pat', count(*) FROM v_pat UNION ALL SELECT 'v_ecom', count(*) FROM v_ecom UNION ALL SELECT 'v_iot', count(*) FROM v_iot UNION ALL SELECT 'v_users', count(*) FROM v_users)
SELECT table_name, schema_name, CAST(score AS DOUBLE) AS score, CAST(n.n AS BIGINT) AS records FROM d JOIN n ON d.table_name = n.t""")
def detect(spark, sf_dir):
    columns = _catalogue(spark, sf_dir)
    sizes = columns.groupBy("table_name").agg(F.max("records").alias("records"))
    return sc.detect_in_catalogue(columns).join(sizes, "table_name")


@query("m5_path_schema", ("v_files",), """
WITH p AS (SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'in/Medical_' WHEN 1 THEN 'in/payments_' WHEN 2 THEN 'in/client_' WHEN 3 THEN 'in/patient_payment_' ELSE 'in/misc_' END || filename AS path FROM v_files)
SELECT file_id, CASE WHEN regexp_matches(lower(path), 'healthcare|medical|patient|hipaa') THEN 'healthcare' WHEN regexp_matches(lower(path), 'financial|transaction|payment|gdpr') THEN 'financial'
  WHEN regexp_matches(lower(path), 'customer|client|user') THEN 'customer' END AS schema_name FROM p""")
def path_schema(spark, sf_dir):
    head = "CASE file_id % 5 WHEN 0 THEN 'in/Medical_' WHEN 1 THEN 'in/payments_' WHEN 2 THEN 'in/client_' WHEN 3 THEN 'in/patient_payment_' ELSE 'in/misc_' END"
    df = view(spark, sf_dir, "v_files")
    return df.select("file_id", sc.path_schema(F.concat(F.expr(head), F.col("filename"))).alias("schema_name"))


@query("m6_data_types", ("v_fin", "v_pat", "v_ecom", "v_iot", "v_users"), """
SELECT 'v_fin' AS record_set, 'financial' AS data_type, 'financial' AS rule_set, CAST(count(*) AS BIGINT) AS records FROM v_fin
UNION ALL SELECT 'v_pat', 'healthcare', 'healthcare', count(*) FROM v_pat UNION ALL SELECT 'v_ecom', 'ecommerce', 'financial', count(*) FROM v_ecom
UNION ALL SELECT 'v_iot', 'iot', 'financial', count(*) FROM v_iot UNION ALL SELECT 'v_users', 'healthcare', 'financial', count(*) FROM v_users""")
def data_types(spark, sf_dir):
    out = None
    for name in ("v_fin", "v_pat", "v_ecom", "v_iot", "v_users"):
        df = view(spark, sf_dir, name)
        row = df.agg(F.count("*").alias("records")).select(
            F.lit(name).alias("record_set"), F.lit(sc.data_type(df.columns)).alias("data_type"), F.lit(sc.rule_set(df.columns)).alias("rule_set"), "records"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("m7_mixed_rules", ("v_pat", "v_fin"), """
SELECT 'healthcare' AS rule_set, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (has_violation OR medical_record_number IS NOT NULL) AS BIGINT) AS violating FROM v_pat
UNION ALL SELECT 'financial', count(*), count(*) FILTER (NOT consent_given OR data_retention_days > 365 OR (consent_withdrawn AND processing_status = 'active')) FROM v_fin""")
def mixed_rules(spark, sf_dir):
    """One mixed record set: the rule set is chosen per record by the patient name, and applies the rules of that kind's columns."""
    mixed, columns = co.mixed_union({"healthcare": view(spark, sf_dir, "v_pat"), "financial": view(spark, sf_dir, "v_fin")}, "source")
    kind = F.when(F.col("patient_name").isNotNull(), "healthcare").otherwise("financial")
    checked = mixed.select(kind.alias("rule_set"), co.mixed_violates(mixed, columns, kind).alias("v"))
    return checked.groupBy("rule_set").agg(F.count("*").alias("records"), F.count_if("v").alias("violating"))


@query("m7_mixed_counts", ("v_pat", "v_fin"), """
SELECT 'healthcare' AS rule_set, CAST(count(*) FILTER (has_violation) * 3 + count(*) FILTER (medical_record_number IS NOT NULL) AS BIGINT) AS violations FROM v_pat
UNION ALL SELECT 'financial', CAST(sum(CAST(NOT consent_given AS INT) + CAST(data_retention_days > 365 AS INT) + CAST(consent_withdrawn AND processing_status = 'active' AS INT)) AS BIGINT) FROM v_fin""")
def mixed_counts(spark, sf_dir):
    """Violations of the mixed set, all of them in one projection and one aggregate."""
    mixed, columns = co.mixed_union({"healthcare": view(spark, sf_dir, "v_pat"), "financial": view(spark, sf_dir, "v_fin")})
    found = mixed.select("rule_set", F.size(co.mixed_violations(mixed, columns, F.col("rule_set"))).alias("n"))
    return found.groupBy("rule_set").agg(F.sum("n").alias("violations"))


@query("m3_sensitive_fields", ("v_pat", "v_fin"), """
SELECT 'healthcare' AS schema_name, 'patient_name' AS field, CAST(count(patient_name) AS BIGINT) AS filled FROM v_pat
UNION ALL SELECT 'healthcare', 'ssn', count(ssn) FROM v_pat UNION ALL SELECT 'healthcare', 'phone', count(phone) FROM v_pat
UNION ALL SELECT 'healthcare', 'email', count(email) FROM v_pat UNION ALL SELECT 'healthcare', 'diagnosis', count(diagnosis) FROM v_pat
UNION ALL SELECT 'healthcare', 'medical_record_number', count(medical_record_number) FROM v_pat
UNION ALL SELECT 'financial', 'customer_name', count(customer_name) FROM v_fin UNION ALL SELECT 'financial', 'account_number', count(account_number) FROM v_fin
UNION ALL SELECT 'financial', 'credit_score', count(credit_score) FROM v_fin""")
def sensitive_fields(spark, sf_dir):
    """Filled values of the declared sensitive fields."""
    out = None
    for name, schema, label in (("v_pat", sc.HEALTHCARE, "healthcare"), ("v_fin", sc.FINANCIAL, "financial")):
        df = view(spark, sf_dir, name)
        fields = [c for c in schema.sensitive if c in df.columns]
        counts = df.agg(*[F.count(c).alias(c) for c in fields])
        rows = counts.select(F.inline(F.array(*[
            F.struct(F.lit(label).alias("schema_name"), F.lit(c).alias("field"), F.col(c).alias("filled")) for c in fields
        ])))
        out = rows if out is None else out.unionByName(rows)
    return out
