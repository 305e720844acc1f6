"""Reports, joins, top-k and pages over jobs, violations, audit rows and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkveil.catalog.registry import query
from sparkveil.operators import integrity as ig, reports as rp
from sparkveil.views import table, view

FILE_TYPES = ((1, "Healthcare Data"), (2, "Financial Data"), (3, "E-commerce Data"), (4, "IoT Sensor Data"))
_TYPES_SQL = "ft AS (SELECT * FROM (VALUES (1, 'Healthcare Data'), (2, 'Financial Data'), (3, 'E-commerce Data'), (4, 'IoT Sensor Data')) t(file_type_id, type_label))"


def _file_types(spark):
    values = ", ".join(f"({i}, '{label}')" for i, label in FILE_TYPES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(file_type_id, type_label)")


def _rounded(df, digits, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


@query("f1_file_status", ("v_files", "v_viol"), """
SELECT f.file_id, f.filename, f.file_status, CAST(count(v.severity) AS BIGINT) AS total_events,
  CAST(count(*) FILTER (v.severity = 'critical') AS BIGINT) AS critical_events, CAST(count(*) FILTER (v.severity = 'high') AS BIGINT) AS high_events,
  CAST(count(*) FILTER (v.status = 'open') AS BIGINT) AS open_events, max(v.created_at) AS last_event
FROM v_files f LEFT JOIN v_viol v ON f.file_id = v.file_id GROUP BY f.file_id, f.filename, f.file_status""")
def file_status(spark, sf):
    return rp.file_status(view(spark, sf, "v_files"), view(spark, sf, "v_viol"))


@query("f2_processing_summary", ("v_files", "v_users", "v_jobs", "v_viol"), """
WITH c AS (SELECT file_id, count(*) AS n FROM v_viol GROUP BY file_id)
SELECT f.file_id, f.filename, u.username AS uploaded_by, j.job_id, j.pipeline_type, j.status AS processing_status, j.processing_time_seconds,
  CAST(coalesce(c.n, 0) AS BIGINT) AS compliance_violations
FROM v_files f JOIN v_users u ON f.created_by = u.user_id LEFT JOIN v_jobs j ON f.file_id = j.file_id LEFT JOIN c ON f.file_id = c.file_id""")
def processing_summary(spark, sf):
    return rp.processing_summary(*[view(spark, sf, v) for v in ("v_files", "v_users", "v_jobs", "v_viol")])


@query("f3_event_stats", ("v_viol",), """
SELECT CAST(count(*) AS BIGINT) AS total_events, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical_events,
  CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high_events, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS open_events,
  CAST(count(*) FILTER (created_at >= (SELECT max(created_at) FROM v_viol) - INTERVAL 24 HOUR) AS BIGINT) AS recent_events_24h FROM v_viol""")
def event_stats(spark, sf):
    events = view(spark, sf, "v_viol")
    return rp.event_statistics(events, rp.newest(events))


@query("f4_system_stats", ("v_users", "v_files", "v_jobs", "v_viol", "v_audit"), """
SELECT 'total_users' AS statistic, CAST(count(*) FILTER (is_active) AS BIGINT) AS n FROM v_users
UNION ALL SELECT 'total_files', count(*) FROM v_files UNION ALL SELECT 'total_records', count(*) FROM lineitem
UNION ALL SELECT 'active_jobs', count(*) FILTER (status IN ('pending', 'running')) FROM v_jobs
UNION ALL SELECT 'open_violations', count(*) FILTER (status = 'open') FROM v_viol
UNION ALL SELECT 'recent_logins', count(DISTINCT user_id) FROM v_audit WHERE action_type = 'signup' AND created_at >= (SELECT max(created_at) FROM v_audit) - INTERVAL 24 HOUR""")
def system_stats(spark, sf):
    audit = view(spark, sf, "v_audit")
    return rp.system_statistics(
        view(spark, sf, "v_users"), view(spark, sf, "v_files"), table(spark, sf, "lineitem"), view(spark, sf, "v_jobs"),
        view(spark, sf, "v_viol"), audit.filter("action_type = 'signup'"), rp.newest(audit),
    )


@query("f5_trend", ("v_viol",), """
SELECT CAST(created_at AS DATE) AS date, CAST(count(*) AS BIGINT) AS violations_count, CAST(count(DISTINCT file_id) AS BIGINT) AS files_affected
FROM v_viol WHERE CAST(created_at AS DATE) > CAST((SELECT max(created_at) FROM v_viol) AS DATE) - 30 GROUP BY 1""")
def trend(spark, sf):
    df = view(spark, sf, "v_viol")
    return rp.violation_trend(df, rp.newest(df))


@query("f6_type_severity", ("v_viol",), """
SELECT violation_type, severity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT file_id) AS BIGINT) AS files_affected FROM v_viol GROUP BY 1, 2""")
def type_severity(spark, sf):
    return rp.type_statistics(view(spark, sf, "v_viol"))


@query("f7_top_files", ("v_viol", "v_files"), """
SELECT t.file_id, f.filename, t.violation_count, t.violation_types_count FROM (
  SELECT file_id, CAST(count(*) AS BIGINT) AS violation_count, CAST(count(DISTINCT violation_type) AS BIGINT) AS violation_types_count
  FROM v_viol GROUP BY file_id ORDER BY 2 DESC, 1 LIMIT 10) t JOIN v_files f ON t.file_id = f.file_id""")
def top_files(spark, sf):
    return rp.top_files(view(spark, sf, "v_viol"), view(spark, sf, "v_files"))


@query("f8_records", ("v_jobs", "v_viol"), """
WITH t AS (SELECT job_id, violation_type, count(*) AS n FROM v_viol GROUP BY ALL),
l AS (SELECT job_id, sum(n) AS total, string_agg(violation_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY violation_type) AS types FROM t GROUP BY job_id)
SELECT j.job_id, CAST(coalesce(l.total, 0) AS BIGINT) AS violation_count, coalesce(l.types, '') AS violation_types FROM v_jobs j LEFT JOIN l ON j.job_id = l.job_id""")
def records(spark, sf):
    out = rp.records_with_violations(view(spark, sf, "v_jobs").select("job_id"), view(spark, sf, "v_viol"), "job_id")
    text = F.transform("violation_types", lambda t: F.concat(t["type"], F.lit(":"), t["n"].cast("string")))
    return out.select("job_id", "violation_count", F.coalesce(F.array_join(text, ","), F.lit("")).alias("violation_types"))


_RATE = "CAST(records_processed AS DOUBLE) / processing_time_seconds"


@query("f9_pipeline_perf", ("v_jobs",), f"""
SELECT pipeline_type, CAST(count(*) AS BIGINT) AS total_jobs, round(avg(records_processed), 4) AS avg_records_processed, round(avg({_RATE}), 4) AS avg_throughput,
  round(max({_RATE}), 4) AS max_throughput, round(min({_RATE}), 4) AS min_throughput, round(avg(processing_time_seconds), 4) AS avg_processing_time_seconds
FROM v_jobs WHERE status = 'completed' AND created_at >= (SELECT max(created_at) FROM v_jobs) - INTERVAL 900 DAY GROUP BY pipeline_type""")
def pipeline_perf(spark, sf):
    jobs = view(spark, sf, "v_jobs")
    out = rp.pipeline_performance(jobs, rp.newest(jobs), 900)
    return _rounded(out, 4, *[c for c in out.columns if c not in ("pipeline_type", "total_jobs")])


@query("f10_perf_trend", ("v_jobs",), f"""
SELECT CAST(created_at AS DATE) AS date, pipeline_type, CAST(count(*) AS BIGINT) AS jobs_count, round(avg(records_processed), 4) AS avg_records, round(avg({_RATE}), 4) AS avg_throughput
FROM v_jobs WHERE status = 'completed' AND created_at >= (SELECT max(created_at) FROM v_jobs) - INTERVAL 900 DAY GROUP BY 1, 2""")
def perf_trend(spark, sf):
    jobs = view(spark, sf, "v_jobs")
    return _rounded(rp.processing_trend(jobs, rp.newest(jobs), 900), 4, "avg_records", "avg_throughput")


@query("f11_audit_stats", ("v_audit",), """
SELECT action_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users FROM v_audit
WHERE created_at >= (SELECT max(created_at) FROM v_audit) - INTERVAL 72 HOUR GROUP BY 1""")
def audit_stats(spark, sf):
    audit = view(spark, sf, "v_audit")
    return rp.audit_statistics(audit, rp.newest(audit), 72)


@query("f12_jobs", ("v_jobs",), """
SELECT CAST(count(*) AS BIGINT) AS total_jobs, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed_jobs, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_jobs,
  round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 6) AS success_rate, CAST(sum(records_processed) AS BIGINT) AS total_records_processed FROM v_jobs""")
def jobs_report(spark, sf):
    return _rounded(rp.job_summary(view(spark, sf, "v_jobs")), 6, "success_rate")


@query("f13_violation_summary", ("v_viol",), """
SELECT CAST(count(*) AS BIGINT) AS total_violations, CAST(count(DISTINCT file_id) AS BIGINT) AS unique_files_affected, CAST(count(DISTINCT violation_type) AS BIGINT) AS violation_types
FROM v_viol WHERE severity = 'critical'""")
def violation_summary(spark, sf):
    return rp.violation_summary(rp.only(view(spark, sf, "v_viol"), severity="critical", status=None))


# Runs of the experiment reports: one per job, with technique and parameters by job number.
_RUNS = f"""runs AS (SELECT job_id AS run_id, pipeline_type, records_processed, CAST(processing_time_seconds AS DOUBLE) AS processing_time, {_RATE} AS throughput,
  CAST(processing_time_seconds AS DOUBLE) * 1000 / records_processed AS latency,
  CASE job_id % 11 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 15 END AS k_value,
  CASE WHEN job_id % 11 < 4 THEN 'k_anonymity' WHEN job_id % 11 < 8 THEN 'differential_privacy' ELSE 'tokenization' END AS technique,
  CAST(CASE WHEN job_id % 11 < 4 THEN least(1.0, CASE job_id % 11 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 15 END / 20.0)
    WHEN job_id % 11 < 8 THEN greatest(0.1, 1.0 - CASE job_id % 11 WHEN 4 THEN 0.1 WHEN 5 THEN 0.5 WHEN 6 THEN 1.0 ELSE 2.0 END) ELSE 0.7 END AS DOUBLE) AS privacy_level,
  CAST(job_id % 7 AS DOUBLE) / 10 AS violation_rate, 5000 * (1 + job_id % 5) AS size, status = 'completed' AS success,
  CAST(job_id % 100 AS DOUBLE) AS stream_percentage, 100 - CAST(job_id % 100 AS DOUBLE) AS batch_percentage, CAST(job_id % 9 AS DOUBLE) / 4 AS router_ms FROM v_jobs)"""


def _runs(spark, sf):
    return view(spark, sf, "v_jobs").select(
        F.col("job_id").alias("run_id"), "pipeline_type", "records_processed",
        F.col("processing_time_seconds").cast("double").alias("processing_time"), rp.throughput().alias("throughput"),
        (F.col("processing_time_seconds").cast("double") * 1000 / F.col("records_processed")).alias("latency"),
        F.expr("CASE job_id % 11 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 15 END").alias("k_value"),
        F.expr("CASE WHEN job_id % 11 < 4 THEN 'k_anonymity' WHEN job_id % 11 < 8 THEN 'differential_privacy' ELSE 'tokenization' END").alias("technique"),
        F.expr("""CASE WHEN job_id % 11 < 4 THEN least(1.0d, CASE job_id % 11 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 15 END / 20.0d)
          WHEN job_id % 11 < 8 THEN greatest(0.1d, 1.0d - CASE job_id % 11 WHEN 4 THEN 0.1d WHEN 5 THEN 0.5d WHEN 6 THEN 1.0d ELSE 2.0d END) ELSE 0.7d END""").alias("privacy_level"),
        (F.col("job_id") % 7 / 10.0).alias("violation_rate"), (F.lit(5000) * (F.col("job_id") % 5 + 1)).alias("size"),
        (F.col("status") == "completed").alias("success"), (F.col("job_id") % 100).cast("double").alias("stream_percentage"),
        (F.lit(100) - (F.col("job_id") % 100).cast("double")).alias("batch_percentage"), (F.col("job_id") % 9 / 4.0).alias("router_ms"),
    )


@query("f14_run_comparison", ("v_jobs",), f"""
WITH {_RUNS} SELECT pipeline_type, CAST(count(*) AS BIGINT) AS total_jobs, round(avg(throughput), 4) AS avg_throughput, round(max(throughput), 4) AS max_throughput, round(min(throughput), 4) AS min_throughput,
  round(avg(violation_rate), 6) AS avg_violation_rate, round(avg(latency), 6) AS avg_latency, round(max(latency), 6) AS max_latency, round(min(latency), 6) AS min_latency FROM runs GROUP BY 1""")
def run_comparison(spark, sf):
    out = _rounded(rp.run_comparison(_runs(spark, sf)), 4, "avg_throughput", "max_throughput", "min_throughput")
    return _rounded(out, 6, "avg_violation_rate", "avg_latency", "max_latency", "min_latency")


@query("f15_techniques", ("v_jobs",), f"""
WITH {_RUNS}, g AS (SELECT technique, CAST(count(*) AS BIGINT) AS jobs, avg(processing_time) AS t, avg(throughput) AS r, avg(privacy_level) AS p, stddev_pop(privacy_level) AS s FROM runs GROUP BY 1)
SELECT technique, jobs, round(t, 4) AS avg_processing_time, round(r, 4) AS avg_throughput, round(p, 6) AS avg_privacy_level, round(s, 6) AS privacy_std,
  CAST(row_number() OVER (ORDER BY r DESC, technique) AS INTEGER) AS performance_rank FROM g""")
def techniques(spark, sf):
    out = _rounded(rp.technique_analysis(_runs(spark, sf)), 4, "avg_processing_time", "avg_throughput")
    return _rounded(out, 6, "avg_privacy_level", "privacy_std")


@query("f15_overhead", ("v_jobs",), f"""
WITH {_RUNS} SELECT pipeline_type, CAST(count(*) AS BIGINT) AS jobs, round(avg(violation_rate), 6) AS avg_violation_detection,
  round(avg(greatest(0.0, (1000.0 - throughput) / 1000.0)), 6) AS avg_anonymization_overhead FROM runs GROUP BY 1""")
def overhead(spark, sf):
    return _rounded(rp.overhead_by_pipeline(_runs(spark, sf)), 6, "avg_violation_detection", "avg_anonymization_overhead")


@query("f15_k_values", ("v_jobs",), f"""
WITH {_RUNS} SELECT k_value, CAST(count(*) AS BIGINT) AS jobs, round(avg(throughput), 4) AS avg_throughput, round(avg(privacy_level), 4) AS avg_privacy_level, round(avg(processing_time), 4) AS avg_processing_time
FROM runs WHERE k_value IS NOT NULL GROUP BY 1""")
def k_values(spark, sf):
    return _rounded(rp.parameter_analysis(_runs(spark, sf), "k_value"), 4, "avg_throughput", "avg_privacy_level", "avg_processing_time")


@query("f15_insights", ("v_jobs",), f"""
WITH {_RUNS} SELECT 'best_privacy_technique' AS insight, (SELECT technique FROM runs GROUP BY 1 ORDER BY avg(privacy_level) DESC, technique DESC LIMIT 1) AS value
UNION ALL SELECT 'fastest_pipeline', (SELECT pipeline_type FROM runs GROUP BY 1 ORDER BY avg(throughput) DESC, pipeline_type DESC LIMIT 1)
UNION ALL SELECT 'most_used_pipeline', (SELECT pipeline_type FROM runs GROUP BY 1 ORDER BY count(*) DESC, pipeline_type DESC LIMIT 1)""")
def insights(spark, sf):
    return rp.insights(_runs(spark, sf))


@query("f16_groups", ("v_jobs",), f"""
WITH {_RUNS} SELECT pipeline_type, size, technique, CAST(count(*) AS BIGINT) AS runs, round(avg(throughput), 4) AS throughput_mean, round(stddev_samp(throughput), 4) AS throughput_std,
  round(stddev_samp(throughput) / sqrt(count(throughput)), 4) AS throughput_sem FROM runs GROUP BY 1, 2, 3""")
def groups(spark, sf):
    out = rp.experiment_groups(_runs(spark, sf), ["pipeline_type", "size", "technique"], ["throughput"])
    return _rounded(out, 4, "throughput_mean", "throughput_std", "throughput_sem")


@query("f17_best", ("v_jobs",), f"""
WITH {_RUNS} SELECT CAST(count(*) AS BIGINT) AS total_experiments, round(avg(throughput), 4) AS avg_throughput, round(max(throughput), 4) AS best_throughput,
  (SELECT technique FROM runs ORDER BY throughput DESC, run_id DESC LIMIT 1) AS best_throughput_method, round(min(latency), 6) AS best_latency,
  (SELECT technique FROM runs ORDER BY latency, run_id LIMIT 1) AS best_latency_method FROM runs""")
def best(spark, sf):
    out = _rounded(rp.best_settings(_runs(spark, sf)), 4, "avg_throughput", "best_throughput")
    return _rounded(out, 6, "best_latency")


@query("f17_by_size", ("v_jobs",), f"""
WITH {_RUNS} SELECT size, CAST(count(*) AS BIGINT) AS total_experiments, round(avg(processing_time), 4) AS avg_processing_time, round(avg(throughput), 4) AS avg_throughput,
  round(avg(throughput) / size, 6) AS scaling_efficiency FROM runs GROUP BY size""")
def by_size(spark, sf):
    out = _rounded(rp.by_size(_runs(spark, sf)), 4, "avg_processing_time", "avg_throughput")
    return _rounded(out, 6, "scaling_efficiency")


@query("f18_routing_overview", ("v_jobs",), f"""
WITH {_RUNS} SELECT round(avg(stream_percentage), 6) AS stream_percentage, round(avg(batch_percentage), 6) AS batch_percentage, round(avg(router_ms), 6) AS avg_routing_overhead_ms,
  round(avg(router_ms) / avg(latency), 6) AS routing_efficiency FROM runs""")
def routing_overview(spark, sf):
    out = rp.routing_overview(_runs(spark, sf))
    return _rounded(out, 6, *out.columns)


@query("f19_latency", ("v_audit",), """
SELECT action_type, round(avg(detail), 6) AS avg_latency, max(detail) AS max_latency, min(detail) AS min_latency, round(stddev_pop(detail), 6) AS latency_std,
  round(quantile_cont(CAST(detail AS DOUBLE), 0.5), 6) AS p50_latency, round(quantile_cont(CAST(detail AS DOUBLE), 0.95), 6) AS p95_latency,
  round(quantile_cont(CAST(detail AS DOUBLE), 0.99), 6) AS p99_latency FROM v_audit GROUP BY 1""")
def latency(spark, sf):
    out = rp.latency_statistics(view(spark, sf, "v_audit"), "detail", "action_type")
    return _rounded(out, 6, "avg_latency", "latency_std", "p50_latency", "p95_latency", "p99_latency")


@query("f20_run_summary", ("v_jobs",), f"""
WITH {_RUNS} SELECT CAST(count(*) AS BIGINT) AS total_experiments, CAST(count(*) FILTER (success) AS BIGINT) AS successful_experiments,
  round(count(*) FILTER (success) / CAST(count(*) AS DOUBLE), 6) AS success_rate, round(avg(processing_time) FILTER (success), 4) AS avg_processing_time,
  round(avg(throughput) FILTER (success), 4) AS avg_throughput FROM runs""")
def run_summary(spark, sf):
    out = _rounded(rp.run_summary(_runs(spark, sf)), 6, "success_rate")
    return _rounded(out, 4, "avg_processing_time", "avg_throughput")


@query("f21_integrity_report", ("v_viol",), """
WITH e AS (SELECT *, violation_type AS event_type FROM v_viol WHERE created_at >= (SELECT max(created_at) FROM v_viol) - INTERVAL 365 DAY),
o AS (SELECT count(*) AS n FROM v_viol WHERE status = 'open')
SELECT 'severity' AS section, severity AS item, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY severity
UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY event_type
UNION ALL SELECT 'total', 'events', count(*) FROM e UNION ALL SELECT 'total', 'open_violations', n FROM o
UNION ALL SELECT 'recommendation', 'investigate critical events', count(*) FROM e WHERE severity = 'critical' HAVING count(*) > 0
UNION ALL SELECT 'recommendation', 'resolve open violations', n FROM o WHERE n > 0
UNION ALL SELECT 'recommendation', 'no events, monitoring normal', 0 FROM e HAVING count(*) = 0""")
def integrity_report(spark, sf):
    df = view(spark, sf, "v_viol")
    events = df.withColumn("event_type", F.col("violation_type"))
    return rp.integrity_report(events, df.filter("status = 'open'"), rp.newest(df), 365)


@query("f22_file_events", ("v_viol",), """
SELECT file_id, CAST(count(*) AS BIGINT) AS total_events, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical_events,
  CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high_events, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS open_events, max(created_at) AS last_event FROM v_viol GROUP BY 1""")
def file_events(spark, sf):
    return rp.event_counts(view(spark, sf, "v_viol"), "file_id")


@query("f23_consistency", ("v_jobs",), f"""
WITH {_RUNS}, g AS (SELECT technique, size, avg(processing_time) AS a, (max(processing_time) - min(processing_time)) * 100.0 / avg(processing_time) AS v FROM runs GROUP BY 1, 2)
SELECT technique, size, round(a, 4) AS avg_time, round(v, 4) AS variance_percent, CASE WHEN v < 10 THEN 'excellent' WHEN v < 20 THEN 'good' ELSE 'high variance' END AS consistency FROM g""")
def consistency(spark, sf):
    return _rounded(rp.run_consistency(_runs(spark, sf), "technique", "size"), 4, "avg_time", "variance_percent")


# --------------------------------------------------------------------------------- joins


@query("j4_job_details", ("v_jobs", "v_files", "v_users"), f"""
WITH {_TYPES_SQL} SELECT j.job_id, f.filename, u.username, ft.type_label FROM v_jobs j JOIN v_files f ON j.file_id = f.file_id
LEFT JOIN v_users u ON f.created_by = u.user_id LEFT JOIN ft ON f.file_type_id = ft.file_type_id""")
def job_details(spark, sf):
    out = rp.job_details(view(spark, sf, "v_jobs"), view(spark, sf, "v_files"), view(spark, sf, "v_users"), _file_types(spark))
    return out.select("job_id", "filename", "username", "type_label")


@query("j5_violation_details", ("v_viol", "v_files", "v_users"), """
SELECT v.job_id, v.violation_type, v.severity, f.filename, u.username FROM v_viol v LEFT JOIN v_files f ON v.file_id = f.file_id LEFT JOIN v_users u ON f.created_by = u.user_id""")
def violation_details(spark, sf):
    out = rp.violation_details(view(spark, sf, "v_viol"), view(spark, sf, "v_files"), view(spark, sf, "v_users"))
    return out.select("job_id", "violation_type", "severity", "filename", "username")


@query("j6_events_filtered", ("v_viol", "v_files", "v_users"), """
SELECT v.job_id, v.severity, v.status, f.filename, u.username FROM v_viol v LEFT JOIN v_files f ON v.file_id = f.file_id LEFT JOIN v_users u ON f.created_by = u.user_id
WHERE v.severity = 'critical' AND v.status = 'open'""")
def events_filtered(spark, sf):
    events = rp.only(view(spark, sf, "v_viol"), severity="critical", status="open", violation_type=None)
    out = rp.violation_details(events, view(spark, sf, "v_files"), view(spark, sf, "v_users"))
    return out.select("job_id", "severity", "status", "filename", "username")


@query("j7_files", ("v_files", "v_users"), f"""
WITH {_TYPES_SQL} SELECT f.file_id, f.filename, ft.type_label, u.username FROM v_files f JOIN ft ON f.file_type_id = ft.file_type_id LEFT JOIN v_users u ON f.created_by = u.user_id""")
def files_list(spark, sf):
    return rp.file_list(view(spark, sf, "v_files"), _file_types(spark), view(spark, sf, "v_users"))


@query("j8_audit_trail", ("v_audit", "v_users"), """
SELECT a.id, a.action_type, a.created_at, u.username FROM (SELECT * FROM v_audit WHERE action_type = 'error' AND created_at >= (SELECT max(created_at) FROM v_audit) - INTERVAL 240 HOUR
  ORDER BY created_at DESC, id LIMIT 100) a LEFT JOIN v_users u ON a.user_id = u.user_id""")
def audit_trail(spark, sf):
    audit = view(spark, sf, "v_audit")
    out = rp.audit_trail(audit, view(spark, sf, "v_users"), rp.newest(audit), 240, action_type="error", user_id=None)
    return out.select("id", "action_type", "created_at", "username")


@query("j13_job_violations", ("v_jobs", "v_files", "v_viol"), """
WITH c AS (SELECT job_id, count(*) AS n FROM v_viol GROUP BY job_id)
SELECT j.job_id, j.pipeline_type, f.filename, CAST(coalesce(c.n, 0) AS BIGINT) AS violations_count FROM v_jobs j LEFT JOIN v_files f ON j.file_id = f.file_id LEFT JOIN c ON j.job_id = c.job_id""")
def job_violations(spark, sf):
    return rp.job_violation_counts(view(spark, sf, "v_jobs"), view(spark, sf, "v_files"), view(spark, sf, "v_viol"))


# ------------------------------------------------------------------------- top-k and pages


@query("l1_recent_violations", ("v_viol", "v_files"), """
SELECT v.job_id, v.created_at, v.severity, f.filename FROM (SELECT * FROM v_viol WHERE created_at >= (SELECT max(created_at) FROM v_viol) - INTERVAL 700 DAY
  ORDER BY created_at DESC, job_id, severity, violation_type, status LIMIT 20) v JOIN v_files f ON v.file_id = f.file_id""")
def recent_violations(spark, sf):
    df = view(spark, sf, "v_viol")
    order = [F.col("created_at").desc(), "job_id", "severity", "violation_type", "status"]
    recent = rp.since(df, rp.newest(df), "DAY", 700).orderBy(*order).limit(20)
    return recent.join(view(spark, sf, "v_files").select("file_id", "filename"), "file_id").select(
        "job_id", "created_at", "severity", "filename"
    )


@query("l2_page", ("v_jobs",), """
SELECT job_id, file_id, created_at, CAST((SELECT count(*) FROM v_jobs) AS BIGINT) AS total_count, 150 < (SELECT count(*) FROM v_jobs) AS has_more
FROM v_jobs ORDER BY created_at DESC, job_id LIMIT 100 OFFSET 50""")
def jobs_page(spark, sf):
    jobs = view(spark, sf, "v_jobs").select("job_id", "file_id", "created_at")
    return rp.page(jobs, [F.col("created_at").desc(), F.col("job_id")], 100, 50)


@query("l3_top_users", ("v_audit",), """
SELECT user_id, CAST(count(*) AS BIGINT) AS events FROM v_audit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_users(spark, sf):
    counts = view(spark, sf, "v_audit").groupBy("user_id").agg(F.count("*").alias("events"))
    return counts.orderBy(F.col("events").desc(), "user_id").limit(10)


@query("l4_ranking", ("v_jobs",), f"""
SELECT pipeline_type, job_id, round(r, 6) AS throughput FROM (SELECT pipeline_type, job_id, {_RATE} AS r, row_number() OVER (PARTITION BY pipeline_type ORDER BY {_RATE} DESC, job_id DESC) AS rn FROM v_jobs) x WHERE rn = 1""")
def ranking(spark, sf):
    out = rp.best_of(view(spark, sf, "v_jobs"), "pipeline_type", "job_id", rp.throughput(), "throughput")
    return _rounded(out, 6, "throughput")


@query("l4_all_ranked", ("v_jobs",), f"""
SELECT job_id, round({_RATE}, 6) AS throughput, CAST(row_number() OVER (ORDER BY {_RATE} DESC, job_id) AS BIGINT) AS rank FROM v_jobs WHERE {_RATE} IS NOT NULL""")
def all_ranked(spark, sf):
    return _rounded(rp.ranking(view(spark, sf, "v_jobs"), "job_id", rp.throughput(), "throughput"), 6, "throughput")


@query("l5_sample", ("v_pat",), "SELECT id, patient_name FROM v_pat ORDER BY id LIMIT 10")
def first_rows(spark, sf):
    return rp.first_rows(view(spark, sf, "v_pat"), ["id"], ["id", "patient_name"])


@query("w1_latest", ("v_jobs",), """
SELECT file_id, created_at, baseline_id FROM (SELECT file_id, created_at, CAST(job_id AS VARCHAR) AS baseline_id,
  row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, CAST(job_id AS VARCHAR) DESC) AS rn FROM v_jobs WHERE status <> 'failed') x WHERE rn = 1""")
def latest_baseline(spark, sf):
    """Every job left a baseline; those of failed jobs are inactive."""
    baselines = view(spark, sf, "v_jobs").select(
        "file_id", F.col("job_id").cast("string").alias("baseline_id"), "created_at", (F.col("status") != "failed").alias("is_active")
    )
    return ig.latest_active(baselines).select("file_id", "created_at", "baseline_id")


@query("v3_job_states", ("v_audit",), """
WITH log AS (SELECT user_id AS job_id, created_at AS moment, id AS seq, CASE action_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN action_type = 'click' THEN detail END AS progress, CASE WHEN action_type = 'error' THEN 'error ' || CAST(id AS VARCHAR) END AS error_message FROM v_audit)
SELECT job_id, arg_max(status, seq) AS status, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress, arg_max(error_message, seq) FILTER (error_message IS NOT NULL) AS error_message,
  min(moment) FILTER (status = 'running') AS started_at, max(moment) FILTER (status IN ('completed', 'failed')) AS completed_at FROM log GROUP BY job_id""")
def job_states(spark, sf):
    """State of a job from its log of partial updates (audit rows in time order)."""
    log = view(spark, sf, "v_audit").select(
        F.col("user_id").alias("job_id"), F.col("created_at").alias("moment"), F.col("id").alias("seq"),
        F.expr("CASE action_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END").alias("status"),
        F.expr("CASE WHEN action_type = 'click' THEN detail END").alias("progress"),
        F.expr("CASE WHEN action_type = 'error' THEN 'error ' || cast(id as string) END").alias("error_message"),
    )
    return rp.latest_state(log, "job_id", ["moment", "seq"], ["progress", "error_message"])
