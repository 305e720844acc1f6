"""Record sets derived from the given tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.plans.spread import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (tables read, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_fin": (("orders", "customer", "nation"), """
SELECT CAST(o.o_orderkey AS STRING) AS id, c.c_name AS customer_name,
  'ACC' || lpad(CAST(o.o_custkey AS STRING), 10, '0') AS account_number,
  o.o_totalprice AS transaction_amount, o.o_orderdate AS transaction_date, n.n_name AS location,
  (o.o_custkey % 8 <> 0) AS consent_given,
  (o.o_custkey % 40 = 0) AS consent_withdrawn,
  CASE WHEN o.o_orderstatus = 'O' THEN 'active' ELSE 'done' END AS processing_status,
  CAST(30 + (o.o_orderkey * 37) % 2527 AS INT) AS data_retention_days,
  CAST(18 + (o.o_custkey * 13) % 63 AS INT) AS age,
  CAST(300 + (o.o_custkey * 7) % 551 AS INT) AS credit_score,
  (o.o_custkey % 8 = 0) AS has_violation
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""),
    "v_pat": (("customer", "nation", "region"), """
SELECT CAST(c.c_custkey AS STRING) AS id, c.c_name AS patient_name,
  CASE c.c_custkey % 5
    WHEN 0 THEN CAST(100 + c.c_custkey % 900 AS STRING) || '-' || CAST(10 + c.c_custkey % 90 AS STRING) || '-' || lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0')
    WHEN 1 THEN NULL
    ELSE '***-**-' || lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0') END AS ssn,
  CASE WHEN c.c_custkey % 5 = 0 THEN '(' || CAST(200 + c.c_custkey % 700 AS STRING) || ') 555-' || lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0')
    ELSE '***-***-****' END AS phone,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'user' || CAST(c.c_custkey AS STRING) || '@example.com' ELSE '***@***.com' END AS email,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Diabetes' WHEN 'BUILDING' THEN 'Hypertension'
    WHEN 'FURNITURE' THEN 'Flu' WHEN 'MACHINERY' THEN 'Cold' ELSE 'Cancer' END AS diagnosis,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'MRN' || lpad(CAST(c.c_custkey AS STRING), 7, '0') END AS medical_record_number,
  CAST(18 + (c.c_custkey * 13) % 73 AS INT) AS age,
  CASE c.c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'Other' END AS gender,
  n.n_name || ',' || r.r_name AS location,
  (c.c_custkey % 5 = 0) AS has_violation
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""),
    "v_ecom": (("lineitem",), """
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS order_id,
  l.l_partkey AS part_id, l.l_extendedprice AS order_amount, l.l_shipdate AS order_date,
  CASE WHEN l.l_orderkey % 10 = 0 THEN '4000-1234-' || lpad(CAST(l.l_orderkey % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(l.l_partkey % 10000 AS STRING), 4, '0')
    ELSE '****-****-****-1234' END AS credit_card,
  (l.l_orderkey % 10 <> 0) AS consent_given,
  CAST(30 + l.l_suppkey % 700 AS INT) AS data_retention_days
FROM lineitem l
"""),
    "v_iot": (("events",), """
SELECT e.event_id AS reading_id, 'DEV' || lpad(CAST(e.user_id AS STRING), 4, '0') AS device_id,
  e.event_type AS sensor_type, e.ts AS reading_timestamp, e.value AS reading_value,
  CASE WHEN e.event_id % 7 = 0 THEN 40 + CAST((e.event_id * 7919) % 1000000 AS DOUBLE) / 1000000
    ELSE 40 + CAST(e.user_id % 100 AS DOUBLE) / 100 END AS location_lat,
  CASE WHEN e.event_id % 7 = 0 THEN -74 + CAST((e.event_id * 104729) % 1000000 AS DOUBLE) / 1000000
    ELSE -74 + CAST(e.user_id % 90 AS DOUBLE) / 100 END AS location_lng,
  (e.user_id % 9 <> 0) AS consent_given,
  CAST(30 + (e.user_id * 11) % 900 AS INT) AS data_retention_days
FROM events e
"""),
    "v_baseline": (("customer",), """
SELECT CAST(c_custkey AS STRING) AS record_id, c_name, c_nationkey, c_mktsegment FROM customer
"""),
    "v_current": (("customer",), """
SELECT CAST(c_custkey AS STRING) AS record_id, c_name, c_nationkey,
  CASE WHEN c_custkey % 20 = 1 THEN 'TAMPERED' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 50 <> 0
UNION ALL
SELECT 'N' || CAST(c_custkey AS STRING) AS record_id, c_name, c_nationkey, c_mktsegment
FROM customer WHERE c_custkey % 100 = 7
"""),
    "v_jobs": (("orders",), """
SELECT o_orderkey AS job_id, o_custkey AS file_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'batch' WHEN 1 THEN 'stream' ELSE 'hybrid' END AS pipeline_type,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(floor(o_totalprice) AS BIGINT) AS records_processed, o_orderdate AS created_at,
  CAST(1 + o_orderkey % 600 AS INT) AS processing_time_seconds
FROM orders
"""),
    "v_viol": (("lineitem", "orders"), """
SELECT l.l_orderkey AS job_id, o.o_custkey AS file_id, l.l_shipdate AS created_at,
  CASE l.l_returnflag WHEN 'A' THEN 'phi_exposure' WHEN 'N' THEN 'missing_consent' ELSE 'data_retention' END AS violation_type,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE l.l_linestatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""),
    "v_audit": (("events",), """
SELECT event_id AS id, event_type AS action_type, user_id, ts AS created_at, value AS detail FROM events
"""),
    # Users of the governance tables: every customer is a user with one of six roles.
    "v_users": (("customer",), """
SELECT c_custkey AS user_id, c_name AS username, CAST(1 + c_custkey % 6 AS INT) AS role_id,
  (c_custkey % 11 <> 0) AS is_active, c_nationkey AS nation_id
FROM customer
"""),
    # Files of the governance tables: one per customer, owned by another user (or none).
    "v_files": (("customer",), """
SELECT c_custkey AS file_id, 'file_' || CAST(c_custkey AS STRING) || '.csv' AS filename,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey - c_custkey % 4 END AS created_by,
  CAST(1 + c_custkey % 4 AS INT) AS file_type_id,
  CASE c_custkey % 3 WHEN 0 THEN 'processed' WHEN 1 THEN 'processing' ELSE 'uploaded' END AS file_status,
  CAST(floor(c_acctbal) AS BIGINT) AS total_records
FROM customer
"""),
    # Requests of data subjects: one per order, its kind told by the order's state.
    "v_requests": (("orders", "customer"), """
SELECT o.o_orderkey AS request_id, c.c_name AS customer_name, o.o_orderdate AS requested_at,
  CASE o.o_orderstatus WHEN 'F' THEN 'access' WHEN 'O' THEN 'rectification' ELSE 'erasure' END AS kind
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""),
    # Healthcare records with the consent columns of the second rule catalogue.
    "v_consent": (("orders", "customer"), """
SELECT CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE 'P' || CAST(o.o_custkey AS STRING) END AS patient_id,
  'C' || CAST(o.o_orderkey AS STRING) AS customer_id,
  o.o_orderkey AS order_key,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE (o.o_orderkey % 7 <> 0) END AS consent_status,
  o.o_orderdate AS consent_date,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderdate END AS created_timestamp,
  o.o_orderdate AS treatment_date,
  CASE o.o_orderkey % 4 WHEN 0 THEN 365 WHEN 1 THEN 1095 WHEN 2 THEN 2555 ELSE NULL END AS data_retention_days,
  CASE WHEN o.o_custkey % 5 = 0 THEN CAST(100 + o.o_custkey % 900 AS STRING) || '-' || CAST(10 + o.o_custkey % 90 AS STRING) || '-' || lpad(CAST(o.o_custkey % 10000 AS STRING), 4, '0') ELSE '' END AS ssn,
  CASE WHEN o.o_custkey % 6 = 0 THEN '(' || CAST(200 + o.o_custkey % 700 AS STRING) || ') 555-' || lpad(CAST(o.o_custkey % 10000 AS STRING), 4, '0') ELSE '***-***-****' END AS phone,
  CASE WHEN o.o_custkey % 7 = 0 THEN 'user' || CAST(o.o_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN o.o_custkey % 10 = 0 THEN '123-45-6789' ELSE 'MRN' || lpad(CAST(o.o_custkey AS STRING), 7, '0') END AS medical_record_number
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A derived record set; the joins inside are left to the optimizer's size estimates.

    `heavy` announces CPU-heavy work per record: a small scan of the driving table is spread.
    """
    tables, text = VIEWS[name]
    aliases = {t: table(spark, sf_dir, t) for t in tables}
    if heavy:
        aliases[tables[0]] = spread(aliases[tables[0]])
    return spark.sql(_bind(text, tables), **aliases)


def _bind(text: str, tables: tuple[str, ...]) -> str:
    """`FROM orders` -> `FROM {orders}`, the form `spark.sql` takes DataFrames in."""
    for name in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name}", f"{word} {{{name}}}")
    return text


def with_views(names: tuple[str, ...], body: str) -> str:
    """SQL text with the views as common table expressions in front."""
    heads = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in names)
    return f"WITH {heads} {body}"


def stream_view(
    spark: SparkSession, sf_dir: str, name: str, streaming: str, files_per_trigger: int | None = None, folder: str | None = None
) -> DataFrame:
    """A derived record set with one of its tables read as a stream, the others static.

    `folder` holds the table split into files; without it the table's own file is the stream.
    """
    from sparkveil.streaming.jobs import file_stream

    tables, text = VIEWS[name]
    aliases = {t: table(spark, sf_dir, t) for t in tables}
    aliases[streaming] = file_stream(
        spark, folder or sf_dir, aliases[streaming].schema, files_per_trigger=files_per_trigger,
        names="*.parquet" if folder else f"{streaming}.parquet",
    )
    return spark.sql(_bind(text, tables), **aliases)
