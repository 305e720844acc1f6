"""Loading, cleaning, sinks and generated records, all driven by the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkveil import schemas as sc
from sparkveil.catalog.anonymization import k_sql, token_sql
from sparkveil.catalog.core import _COUNT_FIN, TEST_SECRET
from sparkveil.catalog.registry import query
from sparkveil.config import k_anonymity, tokenization
from sparkveil.operators import flow, generate as gen
from sparkveil.session import run_dir
from sparkveil.sources import appends, files, sinks, topics
from sparkveil.views import stream_view, table, view

_AT = "2024-01-01 12:00:00"


def _at(kind: str = "timestamp_ntz"):
    return F.lit(_AT).cast(kind)


def _financial_file(spark, sf_dir):
    """v_fin in the declared financial columns, in another column order."""
    df = view(spark, sf_dir, "v_fin").select(
        "customer_name", "id", "account_number", "transaction_amount", "transaction_date", "location", "consent_given", "has_violation",
        F.when(F.col("has_violation"), "missing_consent").alias("violation_type"), F.col("transaction_date").alias("timestamp"),
        F.concat(F.lit("CUST"), F.col("id")).alias("customer_id"), "credit_score", "data_retention_days",
    )
    path = run_dir(spark, "financial-csv")
    sinks.write_csv(df, path)
    return path


_FILE_SQL = """SELECT id, customer_name, account_number, transaction_amount, location, consent_given, has_violation,
  CASE WHEN has_violation THEN 'missing_consent' END AS violation_type, transaction_date AS timestamp, credit_score, data_retention_days FROM v_fin"""
_FILE_COLUMNS = (
    "id", "customer_name", "account_number", "transaction_amount", "location", "consent_given", "has_violation", "violation_type",
    "timestamp", "credit_score", "data_retention_days",
)


@query("s1_csv_scan", ("v_fin",), _FILE_SQL)
def csv_scan(spark, sf_dir):
    """CSV written and read back under an explicit schema (no inference)."""
    path = _financial_file(spark, sf_dir)
    header = files.read_csv_text(spark, path).columns
    declared = {f.name: f for f in sc.FINANCIAL.spark().fields}
    schema = type(sc.FINANCIAL.spark())([declared[c] for c in header])
    return files.read_csv(spark, path, schema).select(*_FILE_COLUMNS)


@query("s2_text_scan", ("v_fin",), "SELECT id, CAST(consent_given AS VARCHAR) AS consent_given, CAST(data_retention_days AS VARCHAR) AS data_retention_days FROM v_fin")
def text_scan(spark, sf_dir):
    return files.read_csv_text(spark, _financial_file(spark, sf_dir)).select("id", "consent_given", "data_retention_days")


@query("s3_schema_load", ("v_fin",), _FILE_SQL)
def schema_load(spark, sf_dir):
    """Schema detected from path and header, columns reordered, types applied."""
    df, report = files.load_checked(spark, _financial_file(spark, sf_dir))
    if not report.matched:
        raise ValueError(f"schema not matched: {report}")
    return df.select(*_FILE_COLUMNS)


def _dirty_financial_file(spark, sf_dir):
    """The declared financial columns as text, with misfits in several of them and a missing key."""
    df = view(spark, sf_dir, "v_fin").withColumn("i", F.col("id").cast("bigint"))
    path = run_dir(spark, "financial-dirty")
    sinks.write_csv(df.select(
        F.when(F.col("i") % 101 != 0, F.col("id")).alias("id"), "customer_name", "account_number",
        F.when(F.col("i") % 7 == 0, "n/a").otherwise(F.col("transaction_amount").cast("string")).alias("transaction_amount"),
        F.when(F.col("i") % 11 == 0, "soon").otherwise(F.col("transaction_date").cast("string")).alias("transaction_date"), "location",
        F.when(F.col("i") % 13 == 0, "maybe").when(F.col("i") % 3 == 0, "1").otherwise(F.col("consent_given").cast("string")).alias("consent_given"),
        F.lit("False").alias("has_violation"), F.lit(None).cast("string").alias("violation_type"), F.col("transaction_date").alias("timestamp"),
        F.concat(F.lit("CUST"), F.col("id")).alias("customer_id"),
        F.when(F.col("i") % 17 == 0, "12.5").otherwise(F.col("credit_score").cast("string")).alias("credit_score"), "data_retention_days",
    ), path)
    return path


_DIRTY_KEY = "CASE WHEN CAST(id AS BIGINT) % 101 <> 0 THEN id END"


@query("s3_rejects", ("v_fin",), f"""
SELECT {_DIRTY_KEY} AS key, 'transaction_amount' AS "column", 'n/a' AS value, 'not a double' AS reason FROM v_fin WHERE CAST(id AS BIGINT) % 7 = 0
UNION ALL SELECT {_DIRTY_KEY}, 'transaction_date', 'soon', 'not a timestamp' FROM v_fin WHERE CAST(id AS BIGINT) % 11 = 0
UNION ALL SELECT {_DIRTY_KEY}, 'consent_given', 'maybe', 'not a boolean' FROM v_fin WHERE CAST(id AS BIGINT) % 13 = 0
UNION ALL SELECT {_DIRTY_KEY}, 'credit_score', '12.5', 'not a int' FROM v_fin WHERE CAST(id AS BIGINT) % 17 = 0
UNION ALL SELECT NULL, 'id', NULL, 'missing' FROM v_fin WHERE CAST(id AS BIGINT) % 101 = 0""")
def load_rejects(spark, sf_dir):
    """What a load could not read, value by value, next to the rows it gave."""
    _, report = files.load_checked(spark, _dirty_financial_file(spark, sf_dir))
    return report.rejects.select("key", "column", "value", "reason")


@query("s3_rows_kept", ("v_fin",), f"""
SELECT {_DIRTY_KEY} AS id, CASE WHEN CAST(id AS BIGINT) % 7 <> 0 THEN transaction_amount END AS transaction_amount, CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN NULL WHEN CAST(id AS BIGINT) % 3 = 0 THEN true ELSE consent_given END AS consent_given,
  CASE WHEN CAST(id AS BIGINT) % 17 <> 0 THEN credit_score END AS credit_score FROM v_fin""")
def load_rows(spark, sf_dir):
    rows, _ = files.load_checked(spark, _dirty_financial_file(spark, sf_dir))
    return rows.select("id", "transaction_amount", "consent_given", "credit_score")


@query("s4_coerce", ("v_fin",), "SELECT id, transaction_date AS timestamp, has_violation FROM v_fin")
def coerce(spark, sf_dir):
    raw = files.read_csv_text(spark, _financial_file(spark, sf_dir))
    return files.coerce(raw).select("id", "timestamp", "has_violation")


@query("s7_replay", ("v_fin",), f"""
SELECT id, TIMESTAMP '{_AT}' AS _ingestion_timestamp, CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) - 1 AS BIGINT) AS _record_index FROM v_fin""")
def replay(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin").withColumn("n", F.col("id").cast("bigint"))
    return topics.with_replay_fields(df, ["n"], _at()).select("id", "_ingestion_timestamp", "_record_index")


@query("s6_messages", ("v_jobs",), """
SELECT CAST(job_id AS VARCHAR) AS key, '{"job_id":' || CAST(job_id AS VARCHAR) || ',"pipeline_type":"' || pipeline_type || '"}' AS value FROM v_jobs""")
def messages(spark, sf_dir):
    return topics.as_messages(view(spark, sf_dir, "v_jobs").select("job_id", "pipeline_type"), "job_id")


@query("s9_result_csv", ("v_pat", "v_fin"), f"""
SELECT id, patient_name, CAST(NULL AS VARCHAR) AS account_number FROM v_pat UNION ALL SELECT id, NULL, {token_sql('account_number', 256)} FROM v_fin""")
def result_csv(spark, sf_dir):
    """Results with different columns in one CSV: the header is the union of the columns."""
    fin = flow.process(view(spark, sf_dir, "v_fin"), "financial", tokenization(256), "batch", _at(), secret=TEST_SECRET, unconditional=True)
    path = run_dir(spark, "result-csv")
    sinks.write_csv(sinks.union_results([
        view(spark, sf_dir, "v_pat").select("id", "patient_name"), fin.select("id", "account_number"),
    ]), path)
    return files.read_csv_text(spark, path).select("id", "patient_name", "account_number")


@query("s11_record_table", ("v_fin",), f"""
WITH n AS (SELECT *, CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS BIGINT) AS row_number, {_COUNT_FIN} AS v FROM v_fin)
SELECT 'job1_' || CAST(row_number - 1 AS VARCHAR) AS record_id, row_number, '{{"id":"' || id || '"}}' AS processed_data, true AS has_pii, v > 0 AS has_violations,
  round(1.0 - v / 5.0, 6) AS compliance_score FROM n""")
def record_table(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin").withColumn("n", F.col("id").cast("bigint"))
    out = sinks.record_table(df, "financial", "job1", "file1", ["n"], ["id"])
    return out.select(
        "record_id", "row_number", "processed_data", "has_pii", "has_violations", F.round("compliance_score", 6).alias("compliance_score")
    )


@query("s12_violation_table", ("v_ecom",), """
SELECT 'f1' AS file_id, order_id AS record_id, 'missing_consent' AS violation_type, 'GDPR' AS violation_category, 'critical' AS severity, 'open' AS status FROM v_ecom WHERE NOT consent_given
UNION ALL SELECT 'f1', order_id, 'phi_exposure', 'PCI-DSS', 'critical', 'open' FROM v_ecom WHERE credit_card NOT LIKE '%*%'
UNION ALL SELECT 'f1', order_id, 'data_retention', 'GDPR', 'medium', 'open' FROM v_ecom WHERE data_retention_days > 365""")
def violation_table(spark, sf_dir):
    return sinks.violation_table(view(spark, sf_dir, "v_ecom"), "ecommerce", "order_id", "f1").drop("description", "affected_columns")


@query("s12_violating_records", ("v_ecom",), """
SELECT 'f1' AS file_id, order_id AS record_id, CASE WHEN NOT consent_given THEN 'critical' ELSE 'medium' END AS severity,
  CAST(CAST(NOT consent_given AS INT) * 2 + CAST(data_retention_days > 365 AS INT) AS INTEGER) AS violations, 'open' AS status FROM v_ecom WHERE NOT consent_given OR data_retention_days > 365""")
def violating_records(spark, sf_dir):
    return sinks.violating_record_table(view(spark, sf_dir, "v_ecom"), "ecommerce", "order_id", "f1")


_RECORD_FIELDS = ("id", "customer_name", "account_number", "location", "consent_given", "consent_withdrawn", "processing_status", "data_retention_days")
_RECORD_JSON = "'{' || " + " || ',' || ".join(
    f"'\"{c}\":' || " + (f"'\"' || {c} || '\"'" if c in ("customer_name", "account_number", "location", "processing_status") else f"CAST({c} AS VARCHAR)") for c in _RECORD_FIELDS
) + " || '}'"
_RECORD_HASH = "sha256(concat_ws(chr(1), " + ", ".join(
    f"'{c}', CASE WHEN {c} IS NULL THEN 'N' ELSE 'V' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in sorted(_RECORD_FIELDS)
) + "))"


@query("s11_appended", ("v_fin",), f"""
WITH r AS (SELECT CAST(id AS BIGINT) AS id, customer_name, account_number, location, consent_given, consent_withdrawn, processing_status, data_retention_days, {_COUNT_FIN} AS v FROM v_fin),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS row_number FROM r), j AS (SELECT unnest(['job1', 'job2']) AS job_id)
SELECT job_id, 'file1' AS file_id, job_id || '_' || CAST(row_number - 1 AS VARCHAR) AS record_id, row_number, {_RECORD_JSON} AS original_data,
  '{{"id":' || CAST(id AS VARCHAR) || ',"account_number":"' || account_number || '"}}' AS processed_data, true AS has_pii, v > 0 AS has_violations,
  CASE WHEN v = 0 THEN '' WHEN NOT consent_given THEN 'missing_consent' ELSE 'compliance_violation' END AS violation_types,
  round(1.0 - v / 5.0, 6) AS compliance_score, {_RECORD_HASH} AS record_hash FROM n, j""")
def appended_records(spark, sf_dir):
    """The record table of two jobs, one of them appended twice, read back with every column."""
    df = view(spark, sf_dir, "v_fin").select(F.col("id").cast("bigint").alias("id"), *_RECORD_FIELDS[1:])
    path = run_dir(spark, "record-table")
    for job in ("job1", "job2", "job1"):
        appends.append(sinks.record_table(df, "financial", job, "file1", ["id"], ["id", "account_number"]), path, job)
    out = appends.read(spark, path).drop(appends.BATCH)
    return out.withColumns({"violation_types": F.array_join("violation_types", ","), "compliance_score": F.round("compliance_score", 6)})


@query("s12_appended", ("v_ecom",), """
SELECT 'f1' AS file_id, order_id AS record_id, 'missing_consent' AS violation_type, 'GDPR' AS violation_category, 'critical' AS severity,
  'Processing personal data without explicit consent' AS description, 'consent_given' AS affected_columns, 'open' AS status FROM v_ecom WHERE NOT consent_given
UNION ALL SELECT 'f1', order_id, 'phi_exposure', 'PCI-DSS', 'critical', 'Exposed credit card number violates PCI-DSS', 'credit_card', 'open' FROM v_ecom WHERE credit_card NOT LIKE '%*%'
UNION ALL SELECT 'f1', order_id, 'data_retention', 'GDPR', 'medium', 'Data retained for ' || CAST(data_retention_days AS VARCHAR) || ' days, exceeds limit of 365', 'data_retention_days', 'open' FROM v_ecom WHERE data_retention_days > 365""")
def appended_violations(spark, sf_dir):
    """Violations by regulation, each part appended twice, read back with every column."""
    found = sinks.violation_table(view(spark, sf_dir, "v_ecom"), "ecommerce", "order_id", "f1")
    path = run_dir(spark, "violation-table")
    for law in ("GDPR", "PCI-DSS") * 2:
        appends.append(found.where(F.col("violation_category") == law), path, law)
    return appends.read(spark, path).drop(appends.BATCH).withColumn("affected_columns", F.array_join("affected_columns", ","))


_LOG_DERIVED = {
    "experiment_id": "'run' || CAST(job_id AS VARCHAR)", "pipeline_type": "pipeline_type", "records_processed": "records_processed",
    "pure_processing_time_seconds": "CAST(processing_time_seconds AS DOUBLE)", "total_time_seconds": "CAST(processing_time_seconds + 1 AS DOUBLE)",
    "records_per_second": "round(CAST(records_processed AS DOUBLE) / processing_time_seconds, 6)",
    **{c: "round(processing_time_seconds * 1000.0 / records_processed, 6)" for c in ("avg_latency_ms", "max_latency_ms", "min_latency_ms")},
    "e2e_latency_ms": "round((processing_time_seconds + 1) * 1000.0 / records_processed, 6)", "success": "status = 'completed'",
}
_SQL_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@query("s15_appended", ("v_jobs",), "SELECT " + ", ".join(
    f"{_LOG_DERIVED[name]} AS {name}" if name in _LOG_DERIVED else f"CAST({'NULL' if default is None else repr(default)} AS {_SQL_KINDS[kind]}) AS {name}"
    for name, kind, default in sinks.EXPERIMENT_COLUMNS) + " FROM v_jobs")
def appended_log(spark, sf_dir):
    """The experiment log of each pipeline appended twice, read back with all 34 columns."""
    runs_df = view(spark, sf_dir, "v_jobs").select(
        F.concat(F.lit("run"), F.col("job_id").cast("string")).alias("experiment_id"), "pipeline_type", "records_processed",
        F.col("processing_time_seconds").cast("double").alias("pure_processing_time_seconds"),
        (F.col("processing_time_seconds") + 1).cast("double").alias("total_time_seconds"), (F.col("status") == "completed").alias("success"),
    )
    path = run_dir(spark, "experiment-log")
    for pipeline in ("batch", "stream", "hybrid") * 2:
        appends.append(sinks.experiment_log(runs_df.where(F.col("pipeline_type") == pipeline)), path, pipeline)
    out = appends.read(spark, path).drop(appends.BATCH)
    return out.withColumns({c: F.round(c, 6) for c in ("records_per_second", "avg_latency_ms", "max_latency_ms", "min_latency_ms", "e2e_latency_ms")})


@query("v4_audit_log", ("v_audit",), """
SELECT action_type, user_id, 'event' AS resource_type, created_at, '{"id":' || CAST(id AS VARCHAR) || ',"action_type":"' || action_type || '"}' AS details FROM v_audit""")
def audit_log(spark, sf_dir):
    """Audit events as a stream of five micro-batches appended to a log; the whole stream is then delivered again."""
    folder, path = run_dir(spark, "audit-events"), run_dir(spark, "audit-log")
    table(spark, sf_dir, "events").repartition(5, "event_id").write.parquet(folder)
    for attempt in range(2):
        stream = stream_view(spark, sf_dir, "v_audit", "events", files_per_trigger=1, folder=folder)
        rows = sinks.audit_rows(stream, F.col("action_type"), F.col("user_id"), F.col("created_at"), "event", ["id", "action_type"])
        appends.append_stream(rows, path, f"{path}/checkpoint-{attempt}", "audit").awaitTermination()
    return appends.read(spark, path).drop(appends.BATCH)


@query("s13_clean", ("v_audit",), """
SELECT id, CASE WHEN id % 5 IN (0, 1) THEN NULL ELSE detail END AS amount, CASE WHEN id % 7 = 0 THEN NULL ELSE action_type END AS label,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS at, CASE WHEN id % 5 IN (0, 1) THEN NULL ELSE detail END AS nested_amount FROM v_audit""")
def clean(spark, sf_dir):
    """Audit values with NaN, infinities and 'nan' put in, then cleaned through a nested struct."""
    dirty = view(spark, sf_dir, "v_audit").select(
        "id", F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 5 == 1, float("-inf")).otherwise(F.col("detail")).alias("amount"),
        F.when(F.col("id") % 7 == 0, "NaN").otherwise(F.col("action_type")).alias("label"), F.col("created_at").alias("at"),
    )
    nested = dirty.withColumn("nested", F.array(F.struct("amount", "label")))
    out = sinks.clean_records(nested)
    return out.select("id", "amount", "label", "at", F.col("nested")[0]["amount"].alias("nested_amount"))


@query("s14_runs", ("v_jobs",), """
SELECT 'size-run-' || CAST(1 + job_id % 3 AS VARCHAR) AS run, pipeline_type, CAST(count(*) AS BIGINT) AS rows, CAST(sum(records_processed) AS BIGINT) AS records FROM v_jobs GROUP BY 1, 2""")
def runs(spark, sf_dir):
    """Results written to three run folders and read back in one scan."""
    root = run_dir(spark, "runs")
    jobs = view(spark, sf_dir, "v_jobs")
    for i in range(3):
        part = jobs.filter(F.col("job_id") % 3 == i).select("job_id", "pipeline_type", "records_processed")
        sinks.write_csv(part, f"{root}/size-run-{i + 1}/results.csv")
    schema = jobs.select("job_id", "pipeline_type", "records_processed").schema
    good, _ = files.read_runs(spark, root, "results.csv/*.csv", schema)
    return good.groupBy("run", "pipeline_type").agg(F.count("*").alias("rows"), F.sum("records_processed").alias("records"))


@query("s15_experiment_log", ("v_jobs",), """
SELECT 'run' || CAST(job_id AS VARCHAR) AS experiment_id, pipeline_type, records_processed, round(CAST(records_processed AS DOUBLE) / processing_time_seconds, 6) AS records_per_second,
  round(processing_time_seconds * 1000.0 / records_processed, 6) AS avg_latency_ms, CAST(0 AS DOUBLE) AS e2e_latency_ms, status = 'completed' AS success, '' AS notes FROM v_jobs""")
def experiment_log(spark, sf_dir):
    runs_df = view(spark, sf_dir, "v_jobs").select(
        F.concat(F.lit("run"), F.col("job_id").cast("string")).alias("experiment_id"), "pipeline_type", "records_processed",
        F.col("processing_time_seconds").cast("double").alias("pure_processing_time_seconds"), (F.col("status") == "completed").alias("success"),
    )
    out = sinks.experiment_log(runs_df)
    return out.select(
        "experiment_id", "pipeline_type", "records_processed", F.round("records_per_second", 6).alias("records_per_second"),
        F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "e2e_latency_ms", "success", "notes",
    )


@query("s16_fingerprints")
def fingerprints(spark, sf_dir):
    """SHA-256 and size of every given file."""
    out = files.fingerprints(spark, sf_dir)
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "file_hash")


@query("s17_parquet_sink", ("v_fin",), f"SELECT id, {k_sql(5)['age']} AS age, data_retention_days FROM v_fin")
def parquet_sink(spark, sf_dir):
    """Result written as CSV and parquet; the parquet side is read back."""
    out = flow.process(view(spark, sf_dir, "v_fin"), "financial", k_anonymity(5), "batch", _at(), unconditional=True)
    path = run_dir(spark, "results")
    sinks.write_both(out.select("id", "age", "data_retention_days"), path)
    return spark.read.parquet(f"{path}/parquet")


# -------------------------------------------------------------------------- generators


def _draw(name: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha256('42|{name}|' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT) / pow(2, 52))"


def _int(name: str, key: str, low: int, high: int) -> str:
    return f"CAST(floor({_draw(name, key)} * {high - low + 1}) + {low} AS BIGINT)"


def _choice(name: str, key: str, options) -> str:
    return f"list_extract([{', '.join(repr(o) for o in options)}], {_int(name, key, 1, len(options))})"


def _digits(name: str, key: str, n: int) -> str:
    return f"lpad(CAST({_int(name, key, 0, 10**n - 1)} AS VARCHAR), {n}, '0')"


def _ssn_sql(name: str, key: str) -> str:
    return f"CAST({_int(name + '1', key, 100, 999)} AS VARCHAR) || '-' || CAST({_int(name + '2', key, 10, 99)} AS VARCHAR) || '-' || {_digits(name + '3', key, 4)}"


def _bad(rate: float, key: str) -> str:
    return f"{_draw('violation', key)} < {rate}"


@query("g1_healthcare", (), f"""
SELECT 'MRN' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS medical_record_number, {_choice('diagnosis', 'c_custkey', gen.DIAGNOSES)} AS diagnosis,
  CASE WHEN {_bad(0.2, 'c_custkey')} THEN {_ssn_sql('ssn', 'c_custkey')} ELSE '***-**-' || {_digits('ssn_tail', 'c_custkey', 4)} END AS ssn,
  {_bad(0.2, 'c_custkey')} AS has_violation FROM customer""")
def generated_healthcare(spark, sf_dir):
    """One generated patient per customer."""
    out = gen.healthcare(table(spark, sf_dir, "customer"), "c_custkey", _at())
    return out.select("medical_record_number", "diagnosis", "ssn", "has_violation")


@query("g2_financial", (), f"""
SELECT 'ACC' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS account_number, round({_draw('amount', 'o_orderkey')} * 4990.0 + 10, 2) AS transaction_amount,
  {_choice('city', 'o_orderkey', gen.CITIES)} AS location, NOT {_bad(0.15, 'o_orderkey')} AS consent_given, CAST({_int('score', 'o_orderkey', 300, 850)} AS INTEGER) AS credit_score FROM orders""")
def generated_financial(spark, sf_dir):
    out = gen.financial(table(spark, sf_dir, "orders"), "o_orderkey", _at())
    return out.select("account_number", "transaction_amount", "location", "consent_given", "credit_score")


@query("g3_ecommerce", (), f"""
SELECT 'ORD' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS order_id, {_choice('product', 'o_orderkey', gen.PRODUCTS)} AS product_name,
  CASE WHEN {_bad(0.1, 'o_orderkey')} THEN '4000-' || {_digits('card0', 'o_orderkey', 4)} || '-' || {_digits('card1', 'o_orderkey', 4)} || '-' || {_digits('card2', 'o_orderkey', 4)} ELSE '****-****-****-1234' END AS credit_card,
  CASE WHEN {_bad(0.1, 'o_orderkey')} THEN 'pci_dss_exposure' END AS violation_type FROM orders""")
def generated_ecommerce(spark, sf_dir):
    out = gen.ecommerce(table(spark, sf_dir, "orders"), "o_orderkey", _at())
    return out.select("order_id", "product_name", "credit_card", "violation_type")


@query("g4_iot", (), f"""
SELECT 'DEV' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS device_id, {_choice('sensor', 'event_id', gen.SENSORS)} AS sensor_type,
  CASE WHEN {_bad(0.15, 'event_id')} THEN round({_draw('lat', 'event_id')} + 40.0, 6) ELSE round({_draw('lat', 'event_id')} + 40.0, 2) END AS location_lat,
  TIMESTAMP '{_AT}' - to_seconds({_int('reading', 'event_id', 0, 86399)}) AS reading_timestamp FROM events""")
def generated_iot(spark, sf_dir):
    out = gen.iot(table(spark, sf_dir, "events"), "event_id", _at())
    return out.select("device_id", "sensor_type", "location_lat", "reading_timestamp")


@query("g6_setup_healthcare", (), f"""
WITH k AS (SELECT c_custkey, CASE WHEN {_bad(0.1, 'c_custkey')} THEN {_choice('kind', 'c_custkey', gen.HEALTH_VIOLATIONS)} END AS kind FROM customer)
SELECT 'MRN' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS medical_record_number, {_ssn_sql('ssn', 'c_custkey')} AS ssn, {_choice('icd', 'c_custkey', gen.ICD_CODES)} AS diagnosis_code,
  kind IS DISTINCT FROM 'expired_consent' AS consent_status, kind AS violation_type FROM k""")
def generated_setup_healthcare(spark, sf_dir):
    out = gen.setup_healthcare(table(spark, sf_dir, "customer"), "c_custkey", _at())
    return out.select("medical_record_number", "ssn", "diagnosis_code", "consent_status", "violation_type")


@query("g7_setup_financial", (), f"""
SELECT 'ACC' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS account_number, {_choice('merchant', 'o_orderkey', gen.MERCHANTS)} AS merchant_category,
  CAST({_int('ip0', 'o_orderkey', 1, 254)} AS VARCHAR) || '.' || CAST({_int('ip1', 'o_orderkey', 1, 254)} AS VARCHAR) || '.' || CAST({_int('ip2', 'o_orderkey', 1, 254)} AS VARCHAR) || '.' || CAST({_int('ip3', 'o_orderkey', 1, 254)} AS VARCHAR) AS ip_address,
  round({_draw('risk', 'o_orderkey')}, 9) AS risk_score FROM orders""")
def generated_setup_financial(spark, sf_dir):
    out = gen.setup_financial(table(spark, sf_dir, "orders"), "o_orderkey", _at())
    return out.select("account_number", "merchant_category", "ip_address", F.round("risk_score", 9).alias("risk_score"))
