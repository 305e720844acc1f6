"""Baselines, change detection, drift and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkveil.catalog.registry import query
from sparkveil.operators import baselines as bl, history as hs, integrity as ig
from sparkveil.session import run_dir
from sparkveil.views import table, view

_FIELDS = ("c_mktsegment", "c_name", "c_nationkey", "record_id")


def hash_sql(alias: str = "") -> str:
    """Canonical hash of a v_baseline / v_current record."""
    p = f"{alias}." if alias else ""
    parts = ", ".join(f"'{c}', CASE WHEN {p}{c} IS NULL THEN 'N' ELSE 'V' || strlen(CAST({p}{c} AS VARCHAR)) || ':' || CAST({p}{c} AS VARCHAR) END" for c in _FIELDS)
    return f"sha256(concat_ws(chr(1), {parts}))"


@query("i1_hash", ("v_baseline",), f"SELECT record_id, {hash_sql()} AS record_hash FROM v_baseline")
def hashes(spark, sf_dir):
    return ig.record_hashes(view(spark, sf_dir, "v_baseline"))


_SCHEMA_TEXT = "record_id:string,c_name:string,c_nationkey:int,c_mktsegment:string"


@query("i2_baseline", ("v_baseline",), f"""
SELECT 'B1' AS baseline_id, record_id, {hash_sql()} AS record_hash, sha256('{_SCHEMA_TEXT}') AS schema_hash, '{_SCHEMA_TEXT}' AS columns, c_name FROM v_baseline""")
def baseline(spark, sf_dir):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    out = ig.baseline(view(spark, sf_dir, "v_baseline"), "B1", at)
    return out.select("baseline_id", "record_id", "record_hash", "schema_hash", "columns", "c_name")


def digest_sql(column: str) -> str:
    """SHA-256 over the number of hashes and the sums of their four 64-bit parts."""
    sums = ", ".join(f"CAST(sum(CAST(('0x' || substr({column}, {16 * i + 1}, 16)) AS UBIGINT)) AS VARCHAR)" for i in range(4))
    return f"sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {sums}))"


@query("i2_baseline_summary", ("v_baseline",), f"""
WITH h AS (SELECT {hash_sql()} AS x FROM v_baseline)
SELECT 'B1' AS baseline_id, CAST(count(*) AS BIGINT) AS total_records, sha256('{_SCHEMA_TEXT}') AS schema_hash, {digest_sql('x')} AS content_hash FROM h""")
def baseline_summary(spark, sf_dir):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return ig.baseline_summary(ig.baseline(view(spark, sf_dir, "v_baseline"), "B1", at))


_CHANGES = f"""j AS (SELECT coalesce(c.record_id, b.record_id) AS record_id, {hash_sql('b')} AS bh, {hash_sql('c')} AS ch,
  b.record_id AS bid, c.record_id AS cid, b.c_mktsegment AS old_segment, c.c_mktsegment AS new_segment
  FROM v_baseline b FULL OUTER JOIN v_current c ON b.record_id = c.record_id),
ev AS (SELECT record_id, CASE WHEN bid IS NULL THEN 'record_added' WHEN cid IS NULL THEN 'record_deleted' ELSE 'record_modified' END AS change_type,
  CASE WHEN bid IS NOT NULL THEN bh END AS old_hash, CASE WHEN cid IS NOT NULL THEN ch END AS new_hash, old_segment, new_segment
  FROM j WHERE bid IS NULL OR cid IS NULL OR bh <> ch)"""
_SEV = "CASE change_type WHEN 'record_modified' THEN 'high' WHEN 'record_added' THEN 'medium' ELSE 'critical' END"
_IMP = "CASE change_type WHEN 'record_modified' THEN 'medium' WHEN 'record_added' THEN 'low' ELSE 'high' END"


@query("i3_changes", ("v_baseline", "v_current"), f"""
WITH {_CHANGES} SELECT record_id, change_type, old_hash, new_hash, {_SEV} AS severity, {_IMP} AS compliance_impact,
  CASE change_type WHEN 'record_modified' THEN 'Record ' || record_id || ' was modified' WHEN 'record_added' THEN 'New record ' || record_id || ' was added'
    ELSE 'Record ' || record_id || ' was deleted' END AS description FROM ev""")
def changes(spark, sf_dir):
    out = ig.detect_changes(view(spark, sf_dir, "v_baseline"), view(spark, sf_dir, "v_current"), with_fields=False)
    return out.drop("affected_fields")


@query("j11_change_counts", ("v_baseline", "v_current"), f"""
WITH {_CHANGES} SELECT change_type, {_SEV} AS severity, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY change_type""")
def change_counts(spark, sf_dir):
    out = ig.detect_changes(view(spark, sf_dir, "v_baseline"), view(spark, sf_dir, "v_current"), with_fields=False)
    return out.groupBy("change_type", "severity").agg(F.count("*").alias("events"))


_RANGE_DIGITS = 1  # 16 ranges: the given tables are small


def _stored(spark, sf_dir, current: str):
    """Two stored baselines: the trusted set, and a current one in which only some ranges differ or many."""
    root = run_dir(spark, "baselines")
    for name in ("v_baseline", current):
        df = view(spark, sf_dir, name) if name != "few" else view(spark, sf_dir, "v_baseline").withColumn(
            "c_mktsegment", F.when(F.col("record_id").cast("bigint") % 301 == 0, "TAMPERED").otherwise(F.col("c_mktsegment"))
        ).where("CAST(record_id AS BIGINT) % 997 <> 0")
        bl.store(df, f"{root}/{name}", digits=_RANGE_DIGITS)
    return f"{root}/v_baseline", f"{root}/{current}"


@query("i2_range_digests", ("v_baseline",), f"""
WITH h AS (SELECT {hash_sql()} AS x, CAST(('0x' || substr(sha256(record_id), 1, {_RANGE_DIGITS})) AS INTEGER) AS node FROM v_baseline)
SELECT node, CAST(count(*) AS BIGINT) AS records, {digest_sql('x')} AS digest FROM h GROUP BY node""")
def range_digests(spark, sf_dir):
    """The leaves of the tree of digests that is stored with a baseline."""
    old, _ = _stored(spark, sf_dir, "few")
    return bl.tree(spark, old).where(f"level = {_RANGE_DIGITS}").select("node", "records", "digest")


@query("i3_by_ranges", ("v_baseline", "v_current"), f"""
WITH {_CHANGES} SELECT record_id, change_type, old_hash, new_hash, {_SEV} AS severity, {_IMP} AS compliance_impact, CAST(1 AS BIGINT) AS copies,
  CASE change_type WHEN 'record_modified' THEN 'c_mktsegment:' || old_segment || '>' || new_segment END AS fields FROM ev""")
def changes_by_ranges(spark, sf_dir):
    """The change events of two stored baselines, read from the ranges whose digests differ."""
    out = bl.changes(spark, *_stored(spark, sf_dir, "v_current"))
    shown = F.transform(F.map_entries("affected_fields"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["old"], F.lit(">"), e["value"]["new"]))
    return out.select(
        "record_id", "change_type", "old_hash", "new_hash", "severity", "compliance_impact", "copies", F.array_join(shown, ",").alias("fields")
    )


_FEW = f"""c AS (SELECT record_id, CAST(record_id AS BIGINT) % 301 = 0 AND CAST(record_id AS BIGINT) % 997 <> 0 AND c_mktsegment <> 'TAMPERED' AS modified, CAST(record_id AS BIGINT) % 997 = 0 AS gone,
  CAST(('0x' || substr(sha256(record_id), 1, {_RANGE_DIGITS})) AS INTEGER) AS node FROM v_baseline),
d AS (SELECT node, count(*) AS records, count(*) FILTER (NOT gone) AS kept, bool_or(modified OR gone) AS changed FROM c GROUP BY node)"""


@query("i3_range_report", ("v_baseline",), f"""
WITH {_FEW} SELECT CAST(count(*) AS BIGINT) AS ranges, CAST(count(*) FILTER (changed) AS BIGINT) AS changed_ranges, CAST(sum(records + kept) AS BIGINT) AS records,
  CAST(coalesce(sum(records + kept) FILTER (changed), 0) AS BIGINT) AS records_read FROM d""")
def range_report(spark, sf_dir):
    """How much of two baselines a comparison reads, told by their trees."""
    return bl.report(spark, *_stored(spark, sf_dir, "few"))


@query("i4_field_diff", ("v_baseline", "v_current"), f"""
WITH {_CHANGES} SELECT record_id, 'c_mktsegment' AS field, old_segment AS old, new_segment AS new FROM ev WHERE change_type = 'record_modified'""")
def field_diff(spark, sf_dir):
    out = ig.detect_changes(view(spark, sf_dir, "v_baseline"), view(spark, sf_dir, "v_current"))
    rows = out.select("record_id", F.explode("affected_fields").alias("field", "d"))
    return rows.select("record_id", "field", "d.old", "d.new")


@query("i5_count_drift", ("v_baseline", "v_current"), """
WITH n AS (SELECT (SELECT count(*) FROM v_baseline) AS old_count, (SELECT count(*) FROM v_current) AS new_count)
SELECT 'metadata_changed' AS change_type, 'high' AS severity, CAST(old_count AS BIGINT) AS old_count, CAST(new_count AS BIGINT) AS new_count,
  round(abs(new_count - old_count) / CAST(old_count AS DOUBLE) * 100, 6) AS change_percentage FROM n WHERE abs(new_count - old_count) / CAST(old_count AS DOUBLE) > 0.005""")
def count_drift(spark, sf_dir):
    """The tampered set lost about 1 % of its records; the threshold is set to half a percent."""
    out = ig.count_drift(view(spark, sf_dir, "v_baseline"), view(spark, sf_dir, "v_current"), 0.005)
    return out.select("change_type", "severity", "old_count", "new_count", F.round("change_percentage", 6).alias("change_percentage"))


@query("i6_escalated", ("v_baseline", "v_current"), f"""
WITH {_CHANGES} SELECT record_id, 'integrity' AS violation_type, 'unauthorized_change' AS violation_category, 'critical' AS severity,
  'Data integrity violation: Record ' || record_id || ' was deleted' AS description, 'restricted' AS data_classification FROM ev WHERE change_type = 'record_deleted'""")
def escalated(spark, sf_dir):
    out = ig.detect_changes(view(spark, sf_dir, "v_baseline"), view(spark, sf_dir, "v_current"), with_fields=False)
    return ig.escalated(out).select(
        "record_id", "violation_type", "violation_category", "severity", "description", "data_classification"
    )


@query("i7_history", ("v_viol",), """
SELECT file_id, severity, CAST(count(*) AS BIGINT) AS events, max(created_at) AS last_event,
  CAST(count(*) FILTER (status = 'open') AS BIGINT) AS open_events FROM v_viol GROUP BY file_id, severity""")
def history(spark, sf_dir):
    """Event history per file and severity."""
    return view(spark, sf_dir, "v_viol").groupBy("file_id", "severity").agg(
        F.count("*").alias("events"), F.max("created_at").alias("last_event"), F.count_if(F.col("status") == "open").alias("open_events")
    )


@query("i7_record_history", ("v_jobs", "v_users"), """
WITH c AS (SELECT file_id, job_id, status, created_at, file_id - file_id % 4 AS user_id FROM v_jobs),
v AS (SELECT *, CAST(row_number() OVER w AS BIGINT) AS version, created_at AS valid_from, lead(created_at) OVER w AS valid_to FROM c WINDOW w AS (PARTITION BY file_id ORDER BY created_at, job_id)),
n AS (SELECT user_id, username AS name, TIMESTAMP '1990-01-01' AS since FROM v_users WHERE user_id % 4 = 0
  UNION ALL SELECT user_id, username || ' II', TIMESTAMP '1995-06-17' FROM v_users WHERE user_id % 8 = 0)
SELECT v.file_id, v.job_id, v.status, v.version, v.valid_from, v.valid_to, n.name AS username FROM v ASOF LEFT JOIN n ON v.user_id = n.user_id AND v.created_at >= n.since""")
def record_history(spark, sf_dir):
    """Every version of every file's jobs, with the time it was valid and the user's name of that time."""
    changes = view(spark, sf_dir, "v_jobs").select(
        "file_id", "job_id", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"), (F.col("file_id") - F.col("file_id") % 4).alias("user_id")
    )
    users = view(spark, sf_dir, "v_users")
    since = lambda text: F.lit(text).cast("timestamp_ntz").alias("since")
    names = users.where("user_id % 4 = 0").select("user_id", F.col("username").alias("name"), since("1990-01-01"), F.lit(1).alias("name_id")).union(
        users.where("user_id % 8 = 0").select("user_id", F.concat("username", F.lit(" II")), since("1995-06-17"), F.lit(2))
    )
    out = hs.record_history(changes, names, "file_id", "created_at", "job_id", "user_id")
    return out.select("file_id", "job_id", "status", "version", "valid_from", "valid_to", "username")


@query("i8_resolve", ("v_jobs", "v_audit"), """
WITH res AS (SELECT id % (SELECT count(*) FROM v_jobs) AS event_id, CASE WHEN action_type = 'error' THEN 'investigating' ELSE 'resolved' END AS status,
  action_type AS notes, user_id AS resolved_by, created_at AS resolved_at FROM v_audit),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY resolved_at DESC, status DESC) AS rn FROM res) x WHERE rn = 1)
SELECT j.job_id AS event_id, coalesce(l.status, 'open') AS status, l.notes AS resolution_notes, l.resolved_by, l.resolved_at
FROM v_jobs j LEFT JOIN last l ON j.job_id = l.event_id""")
def resolve(spark, sf_dir):
    jobs = view(spark, sf_dir, "v_jobs")
    total = jobs.agg(F.count("*").alias("n")).scalar()
    events = jobs.select(F.col("job_id").alias("event_id"), F.lit("open").alias("status"))
    resolutions = view(spark, sf_dir, "v_audit").select(
        (F.col("id") % total).alias("event_id"),
        F.when(F.col("action_type") == "error", "investigating").otherwise("resolved").alias("status"),
        F.col("action_type").alias("notes"), F.col("user_id").alias("resolved_by"), F.col("created_at").alias("resolved_at"),
    )
    return ig.resolve(events, resolutions)


def _updates(spark, sf_dir):
    records = view(spark, sf_dir, "v_baseline")
    changed = view(spark, sf_dir, "v_current").filter("c_mktsegment = 'TAMPERED'")
    return records, changed


@query("i9_update_records", ("v_baseline", "v_current"), """
SELECT b.record_id, b.c_name, b.c_nationkey, coalesce(u.c_mktsegment, b.c_mktsegment) AS c_mktsegment
FROM v_baseline b LEFT JOIN (SELECT * FROM v_current WHERE c_mktsegment = 'TAMPERED') u ON b.record_id = u.record_id""")
def update_records(spark, sf_dir):
    return ig.apply_updates(*_updates(spark, sf_dir))[0]


@query("i9_change_rows", ("v_baseline", "v_current"), f"""
SELECT b.record_id, 'UPDATE' AS change_type, 'user' AS change_source, {hash_sql('b')} AS old_hash, {hash_sql('u')} AS new_hash,
  'c_mktsegment' AS changed FROM v_baseline b JOIN (SELECT * FROM v_current WHERE c_mktsegment = 'TAMPERED') u ON b.record_id = u.record_id""")
def change_rows(spark, sf_dir):
    out = ig.apply_updates(*_updates(spark, sf_dir))[1]
    return out.select(
        "record_id", "change_type", "change_source", "old_hash", "new_hash",
        F.array_join(F.map_keys("changed_fields"), ",").alias("changed"),
    )


@query("i10_expectations", (), """
SELECT 'row_count' AS expectation, CAST(count(*) AS BIGINT) AS observed, count(*) < 100 AS alert FROM orders
UNION ALL SELECT 'range_o_totalprice', count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 400000), count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 400000) > 0 FROM orders
UNION ALL SELECT 'null_o_custkey', count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_custkey IS NULL) > 0 FROM orders""")
def expectations(spark, sf_dir):
    return ig.expectations(table(spark, sf_dir, "orders"), 100, None, {"o_totalprice": (1000, 400000)}, ["o_custkey"])


@query("m8_schema_drift", (), """
SELECT 'schema_changed' AS change_type, 'critical' AS severity, 'c_segment' AS added, 'c_mktsegment' AS removed, CAST(count(*) AS BIGINT) AS records FROM customer""")
def schema_drift(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    trusted = df.columns
    out = ig.schema_drift(trusted, df.withColumnRenamed("c_mktsegment", "c_segment"))
    return out.select(
        "change_type", "severity", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "records"
    )


_DRIFTING = """r AS (SELECT '{"id":' || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ',"name":"' || c_name || '"' END
  || CASE WHEN c_custkey % 7 = 0 THEN ',"segment":"' WHEN c_custkey % 7 = 3 THEN ',"market":"' ELSE ',"mktsegment":"' END || c_mktsegment || '"'
  || CASE WHEN c_custkey % 13 = 0 THEN ',"nation":"' || c_nationkey || '"}' ELSE ',"nation":' || c_nationkey || '}' END AS text, c_custkey FROM customer)"""


def _drifting(spark, sf_dir):
    """Customers as JSON records whose fields and types drift from record to record."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("drifting_customer")
    return spark.sql("WITH " + _DRIFTING.replace("FROM customer", "FROM drifting_customer") + " SELECT text FROM r")


@query("m8_record_drift", (), f"""
WITH {_DRIFTING}, d AS (SELECT text, CASE c_custkey % 7 WHEN 0 THEN 'segment' WHEN 3 THEN 'market' ELSE '' END AS added,
  concat_ws(',', CASE WHEN c_custkey % 7 IN (0, 3) THEN 'mktsegment' END, CASE WHEN c_custkey % 11 = 0 THEN 'name' END) AS removed FROM r)
SELECT 'schema_changed' AS change_type, 'critical' AS severity, added, removed, CAST(count(*) AS BIGINT) AS records, min(text) AS first_text FROM d WHERE added <> '' OR removed <> '' GROUP BY added, removed""")
def drift_by_record(spark, sf_dir):
    out = ig.record_drift(_drifting(spark, sf_dir), "text", ["id", "name", "mktsegment", "nation"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})


@query("m9_record_schemas", (), f"""
WITH {_DRIFTING}, d AS (SELECT 'OBJECT<id: BIGINT, ' || CASE WHEN c_custkey % 7 = 3 THEN 'market: STRING, ' WHEN c_custkey % 7 = 0 THEN '' ELSE 'mktsegment: STRING, ' END
  || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'name: STRING, ' END || CASE WHEN c_custkey % 13 = 0 THEN 'nation: STRING' ELSE 'nation: BIGINT' END
  || CASE WHEN c_custkey % 7 = 0 THEN ', segment: STRING>' ELSE '>' END AS schema FROM r)
SELECT sha256(schema) AS schema_hash, schema, CAST(count(*) AS BIGINT) AS records FROM d GROUP BY schema""")
def schemas_by_record(spark, sf_dir):
    return ig.record_schemas(_drifting(spark, sf_dir), "text")


@query("m9_schema_hash", (), """
SELECT sha256('c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string') AS schema_hash, CAST(count(*) AS BIGINT) AS records FROM customer""")
def schema_hash(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.agg(F.count("*").alias("records")).select(ig.schema_hash(df.schema).alias("schema_hash"), "records")


@query("t2_except", ("v_baseline", "v_current"), """
SELECT record_id, 'missing' AS side FROM v_baseline WHERE record_id NOT IN (SELECT record_id FROM v_current)
UNION ALL SELECT record_id, 'extra' FROM v_current WHERE record_id NOT IN (SELECT record_id FROM v_baseline)""")
def id_difference(spark, sf_dir):
    old, new = view(spark, sf_dir, "v_baseline").select("record_id"), view(spark, sf_dir, "v_current").select("record_id")
    return ig.id_difference(old, new, "record_id")


@query("t1_union_by_name", ("v_baseline", "v_jobs"), """
SELECT record_id, c_nationkey, CAST(NULL AS VARCHAR) AS pipeline_type FROM v_baseline
UNION ALL SELECT CAST(job_id AS VARCHAR), NULL, pipeline_type FROM v_jobs""")
def union_by_name(spark, sf_dir):
    left = view(spark, sf_dir, "v_baseline").select("record_id", "c_nationkey")
    right = view(spark, sf_dir, "v_jobs").select(F.col("job_id").cast("string").alias("record_id"), "pipeline_type")
    return left.unionByName(right, allowMissingColumns=True)


@query("t3_key_union", ("v_baseline", "v_current"), """
SELECT b.record_id, 'c_mktsegment,c_name,c_nationkey,checked' AS keys FROM v_baseline b JOIN v_current c ON b.record_id = c.record_id""")
def key_union(spark, sf_dir):
    """Union of the keys of two records held as maps."""
    fields = ("c_name", "c_nationkey", "c_mktsegment")
    old = view(spark, sf_dir, "v_baseline").select(
        "record_id", F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c).cast("string"))]).alias("a")
    )
    new = view(spark, sf_dir, "v_current").select(
        "record_id", F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("checked"), F.lit("yes")).alias("b")
    )
    joined = old.join(new, "record_id")
    return joined.select("record_id", F.array_join(ig.key_union(F.col("a"), F.col("b")), ",").alias("keys"))
