"""Streaming queries: run to the end of the available data, output equal to the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from sparkveil import schemas as sc
from sparkveil.catalog.anonymization import k_sql, token_sql
from sparkveil.catalog.core import _COUNT_FIN, _PHI, TEST_SECRET
from sparkveil.catalog.governance import _reader, _redact_sql
from sparkveil.catalog.registry import query
from sparkveil.config import k_anonymity, tokenization
from sparkveil.operators import flow, governance as gv
from sparkveil.session import run_dir
from sparkveil.sources import appends, rejects as rj, topics
from sparkveil.streaming import consent, jobs, late, metrics
from sparkveil.views import stream_view, table, view

_AT = "2024-01-01 12:00:00"


def _at():
    return F.lit(_AT).cast("timestamp_ntz")


def _zoneless(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _checked(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "v_fin", "orders")
    return jobs.check(stream, "financial", tokenization(256), _at(), secret=TEST_SECRET)


@query("s5_json_stream", ("v_jobs",), "SELECT job_id, pipeline_type, status, records_processed FROM v_jobs")
def json_stream(spark, sf_dir):
    """Messages as JSON lines, read as a stream and parsed under an explicit schema."""
    df = view(spark, sf_dir, "v_jobs").select("job_id", "pipeline_type", "status", "records_processed")
    path = run_dir(spark, "messages")
    topics.as_messages(df).write.text(path)
    lines = jobs.file_stream(spark, path, spark.sql("SELECT '' AS value").schema, "text")
    return jobs.collect_table(topics.parse(lines, df.schema).drop("_unreadable", rj.REJECTS), "s5")


def _dirty_messages(spark, sf_dir):
    """Jobs as JSON lines, some with a field of another kind, some without a field, some no JSON."""
    texts = F.expr("""CASE WHEN job_id % 31 = 0 THEN concat('{"job_id":', job_id)
      WHEN job_id % 29 = 0 THEN concat('[', job_id, ']')
      WHEN job_id % 23 = 0 THEN to_json(struct(job_id, 'many' AS records_processed, 'maybe' AS done))
      WHEN job_id % 19 = 0 THEN to_json(struct(job_id, records_processed + 0.5D AS records_processed, job_id % 2 = 0 AS done))
      WHEN job_id % 17 = 0 THEN to_json(struct(job_id, CAST(records_processed AS STRING) AS records_processed, 'True' AS done))
      WHEN job_id % 13 = 0 THEN to_json(struct(job_id))
      ELSE to_json(struct(job_id, records_processed, status = 'completed' AS done)) END""")
    path = run_dir(spark, "dirty-messages")
    view(spark, sf_dir, "v_jobs").select(texts.alias("value")).write.text(path)
    lines = jobs.file_stream(spark, path, spark.sql("SELECT '' AS value").schema, "text")
    return topics.parse(lines, T.StructType.fromDDL("job_id BIGINT NOT NULL, records_processed BIGINT, done BOOLEAN"), keep=("value",))


@query("s5_rejects", ("v_jobs",), """
SELECT '{"job_id":' || CAST(job_id AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS "column", '{"job_id":' || CAST(job_id AS VARCHAR) AS value, 'not a JSON object' AS reason FROM v_jobs WHERE job_id % 31 = 0
UNION ALL SELECT '[' || CAST(job_id AS VARCHAR) || ']', NULL, '[' || CAST(job_id AS VARCHAR) || ']', 'not a JSON object' FROM v_jobs WHERE job_id % 29 = 0 AND job_id % 31 <> 0
UNION ALL SELECT '{"job_id":' || CAST(job_id AS VARCHAR) || ',"records_processed":"many","done":"maybe"}', c, v, r FROM v_jobs,
  (VALUES ('records_processed', 'many', 'not a bigint'), ('done', 'maybe', 'not a boolean')) t(c, v, r) WHERE job_id % 23 = 0 AND job_id % 29 <> 0 AND job_id % 31 <> 0
UNION ALL SELECT '{"job_id":' || CAST(job_id AS VARCHAR) || ',"records_processed":' || CAST(records_processed AS VARCHAR) || '.5,"done":' || CAST(job_id % 2 = 0 AS VARCHAR) || '}',
  'records_processed', CAST(records_processed AS VARCHAR) || '.5', 'not a bigint' FROM v_jobs WHERE job_id % 19 = 0 AND job_id % 23 <> 0 AND job_id % 29 <> 0 AND job_id % 31 <> 0""")
def json_rejects(spark, sf_dir):
    """What a stream of messages holds that is not as declared, field by field, next to the rows."""
    read = jobs.collect_table(_dirty_messages(spark, sf_dir), "s5r")
    return rj.channel(read, ("value",)).toDF("message", "column", "value", "reason")


_BAD_JOB = "(job_id % 31 = 0 OR job_id % 29 = 0)"


@query("s5_rows_kept", ("v_jobs",), f"""
SELECT CASE WHEN NOT {_BAD_JOB} THEN job_id END AS job_id, CASE WHEN NOT {_BAD_JOB} AND job_id % 23 <> 0 AND job_id % 19 <> 0 AND (job_id % 17 = 0 OR job_id % 13 <> 0) THEN records_processed END AS records_processed,
  CASE WHEN {_BAD_JOB} OR job_id % 23 = 0 THEN NULL WHEN job_id % 19 = 0 THEN job_id % 2 = 0 WHEN job_id % 17 = 0 THEN true WHEN job_id % 13 = 0 THEN NULL ELSE status = 'completed' END AS done,
  CAST(CASE WHEN {_BAD_JOB} THEN 1 WHEN job_id % 23 = 0 THEN 2 WHEN job_id % 19 = 0 THEN 1 ELSE 0 END AS INTEGER) AS rejects FROM v_jobs""")
def json_rows(spark, sf_dir):
    """The rows of the same stream: one for every message, absent fields NULL without a reject."""
    read = jobs.collect_table(_dirty_messages(spark, sf_dir), "s5k")
    return read.select("job_id", "records_processed", "done", F.size(rj.REJECTS).alias("rejects"))


@query("x1_stream_check", ("v_fin",), f"""
SELECT id, CASE WHEN {_COUNT_FIN} > 0 THEN {token_sql('account_number', 256)} ELSE account_number END AS account_number,
  CAST({_COUNT_FIN} AS INTEGER) AS violations, {_COUNT_FIN} = 0 AS is_compliant, 'stream' AS processed_via FROM v_fin""")
def stream_check(spark, sf_dir):
    out = jobs.collect_table(_checked(spark, sf_dir), "x1")
    return out.select("id", "account_number", F.size("violations").alias("violations"), "is_compliant", "processed_via")


_ANY_PHI = " OR ".join(p[0] for p in _PHI)


@query("x2_foreach_batch", ("v_pat",), "SELECT id, " + ", ".join(
    f"CASE WHEN {_ANY_PHI} THEN {token_sql(c, 256)} ELSE {c} END AS {c}" for c in ("ssn", "phone", "email", "patient_name")
) + ", 'batch' AS processed_via FROM v_pat")
def foreach_batch(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "v_pat", "customer")
    rows, _ = jobs.collect_batches(stream, "x2", jobs.batch_body("healthcare", tokenization(256), _at(), secret=TEST_SECRET))
    return rows.select("id", "ssn", "phone", "email", "patient_name", "processed_via")


@query("x3_batch_sizes", ("v_pat",), "SELECT CAST(count(*) AS BIGINT) AS records FROM v_pat")
def batch_sizes(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "v_pat", "customer")
    _, sizes = jobs.collect_batches(stream, "x3", jobs.batch_body("healthcare", tokenization(128), _at(), secret=TEST_SECRET))
    return sizes.agg(F.sum("batch_size").alias("records"))


@query("x4_grid_stream", ("v_pat",), " UNION ALL ".join(
    f"SELECT '{label}' AS setting, id, {ssn} AS ssn, {age} AS age FROM v_pat" for label, ssn, age in (
        ("k=3", k_sql(3)["ssn"], k_sql(3)["age"]), ("k=15", k_sql(15)["ssn"], k_sql(15)["age"]), ("256-bit", token_sql("ssn", 256), "CAST(age AS VARCHAR)"),
    )))
def grid_stream(spark, sf_dir):
    """One stream under three settings at once, instead of one consumer per setting."""
    stream = stream_view(spark, sf_dir, "v_pat", "customer")
    settings = [k_anonymity(3), k_anonymity(15), tokenization(256)]
    return jobs.collect_table(flow.grid_records(stream, settings, ["ssn", "age"], secret=TEST_SECRET), "x4")


@query("x5_running", ("v_fin",), f"""
SELECT is_compliant, CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (v > 0) AS BIGINT) AS violating, CAST(sum(v) AS BIGINT) AS violations
FROM (SELECT {_COUNT_FIN} AS v, {_COUNT_FIN} = 0 AS is_compliant FROM v_fin) x GROUP BY 1""")
def running(spark, sf_dir):
    return jobs.collect_latest(jobs.running_metrics(_checked(spark, sf_dir), "is_compliant"), ["is_compliant"], "x5")


@query("x7_dedupe", ("v_audit",), "SELECT id, action_type, created_at FROM v_audit")
def dedupe(spark, sf_dir):
    """Every event delivered twice, kept once."""
    stream = stream_view(spark, sf_dir, "v_audit", "events").select("id", "action_type", "created_at")
    twice = stream.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return _zoneless(jobs.collect_table(jobs.deduplicate(twice, "id", "created_at"), "x7"), "created_at")


_DAY = "date_trunc('day', created_at)"


@query("x8_tumbling", ("v_audit",), f"""
SELECT CAST({_DAY} AS TIMESTAMP) AS window_start, CAST({_DAY} AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, action_type, CAST(count(*) AS BIGINT) AS n FROM v_audit GROUP BY 1, 2, 3""")
def tumbling(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "v_audit", "events")
    counts = jobs.tumbling_counts(stream, "created_at", "1 day", "1 hour", "action_type")
    return _zoneless(jobs.collect_latest(counts, ["window_start", "window_end", "action_type"], "x8"), "window_start", "window_end")


@query("x8_tumbling_closed", ("v_audit",), f"""
SELECT CAST({_DAY} AS TIMESTAMP) AS window_start, action_type, CAST(count(*) AS BIGINT) AS n FROM v_audit
WHERE CAST({_DAY} AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM v_audit) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def tumbling_closed(spark, sf_dir):
    """Append mode: only windows the watermark has closed are written, each once."""
    stream = stream_view(spark, sf_dir, "v_audit", "events")
    counts = jobs.tumbling_counts(stream, "created_at", "1 day", "1 hour", "action_type")
    return _zoneless(jobs.collect_table(counts, "x8c"), "window_start").select("window_start", "action_type", "n")


_ARRIVAL = "least(5, greatest(0, CAST(date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) AS INTEGER) // 5) + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END)"


@query("x8_late", ("v_audit",), f"""
WITH b AS (SELECT *, {_ARRIVAL} AS batch FROM v_audit), m AS (SELECT batch, max(created_at) AS newest FROM b GROUP BY batch),
w AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS closed FROM m),
r AS (SELECT CAST({_DAY} AS TIMESTAMP) AS window_start, action_type, coalesce(CAST({_DAY} AS TIMESTAMP) + INTERVAL 1 DAY <= closed, false) AS late FROM b JOIN w ON b.batch = w.batch)
SELECT window_start, action_type, CAST(count(*) FILTER (NOT late) AS BIGINT) AS counted, CAST(count(*) FILTER (late) AS BIGINT) AS late FROM r GROUP BY 1, 2""")
def late_events(spark, sf_dir):
    """Events that arrive in up to six micro-batches, a tenth of them one batch late: every row is counted or written aside."""
    folder, path = run_dir(spark, "late-events"), run_dir(spark, "late-windows")
    arrival = F.least(F.lit(5), F.greatest(F.lit(0), F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 5)) + (F.col("event_id") % 10 == 0).cast("int"))
    events = table(spark, sf_dir, "events").withColumn("__arrival", arrival)
    for number in range(6):  # one after the other, as files are taken by their time
        events.where(F.col("__arrival") == number).drop("__arrival").coalesce(1).write.mode("append").parquet(folder)
    stream = stream_view(spark, sf_dir, "v_audit", "events", files_per_trigger=1, folder=folder)
    late.start_windows(stream, "created_at", "1 day", "1 hour", ("action_type",), path, f"{path}/checkpoint").awaitTermination()
    on_time = late.counted(spark, path, "action_type").select("window_start", "action_type", F.col("n").alias("counted"))
    aside = late.late_rows(spark, path).groupBy(F.date_trunc("day", F.col("created_at").cast("timestamp")).alias("window_start"), "action_type").agg(F.count("*").alias("late"))
    both = on_time.join(aside, ["window_start", "action_type"], "full_outer")
    zero = F.lit(0).cast("bigint")
    return _zoneless(both.select("window_start", "action_type", F.coalesce("counted", zero).alias("counted"), F.coalesce("late", zero).alias("late")), "window_start")


_MS = "(processing_time_seconds * 137 + job_id % 1000)"


def _share_sql(share: float) -> str:
    value = f"max(v) FILTER (k = CAST(ceil(n * {share}) AS BIGINT))"
    width = f"CAST(pow(2, length(bin({value})) - 4) AS BIGINT)"
    return f"CASE WHEN {value} < 8 THEN {value} ELSE ({value} // {width} + 1) * {width} - 1 END AS p{round(share * 100)}"


@query("x5_latency", ("v_jobs",), f"""
WITH r AS (SELECT pipeline_type, CAST({_MS} AS BIGINT) AS v, row_number() OVER (PARTITION BY pipeline_type ORDER BY {_MS}) AS k, count(*) OVER (PARTITION BY pipeline_type) AS n FROM v_jobs)
SELECT pipeline_type, CAST(count(*) AS BIGINT) AS records, round(avg(v), 6) AS mean, {', '.join(_share_sql(p) for p in (0.5, 0.95, 0.99))} FROM r GROUP BY pipeline_type""")
def latency(spark, sf_dir):
    """Latency of a stream in five micro-batches, as histograms that are added up afterwards."""
    folder, path = run_dir(spark, "latency-orders"), run_dir(spark, "latency")
    table(spark, sf_dir, "orders").repartition(5, "o_orderkey").write.parquet(folder)
    stream = stream_view(spark, sf_dir, "v_jobs", "orders", files_per_trigger=1, folder=folder)
    metrics.start_latency(stream, F.expr(_MS), ("pipeline_type",), path, f"{path}/checkpoint").awaitTermination()
    whole = metrics.merged(appends.read(spark, path), "pipeline_type")
    return metrics.quantiles(whole, (0.5, 0.95, 0.99), "pipeline_type").withColumn("mean", F.round("mean", 6))


_CONSENT_SQL = """c AS (SELECT user_id, arg_max(w, created_at) AS w, max(created_at) AS t FROM (SELECT user_id, created_at, action_type = 'error' AS w FROM v_audit
  WHERE action_type IN ('error', 'signup')) x GROUP BY 1)"""


@query("x9_consent_join", ("v_audit",), f"""
WITH {_CONSENT_SQL} SELECT a.id, a.user_id, coalesce(c.w AND a.created_at >= c.t, false) AS blocked FROM v_audit a LEFT JOIN c ON a.user_id = c.user_id""")
def consent_join(spark, sf_dir):
    """Sign-ups give consent, errors withdraw it; later events of the subject are blocked."""
    changes = view(spark, sf_dir, "v_audit").filter("action_type IN ('error', 'signup')").withColumn("withdrawn", F.col("action_type") == "error")
    newest = jobs.latest_consent(changes, "user_id", "created_at", "withdrawn")
    stream = stream_view(spark, sf_dir, "v_audit", "events")
    blocked = jobs.block_withdrawn(stream, newest, "user_id", "created_at")
    return jobs.collect_table(blocked, "x9").select("id", "user_id", "blocked")


@query("x9_consent_stream", ("v_audit",), """
WITH c AS (SELECT user_id, created_at, bool_or(action_type = 'error') AS withdrawn FROM v_audit WHERE action_type IN ('error', 'signup') GROUP BY 1, 2)
SELECT a.id, a.user_id, coalesce(c.withdrawn, false) AS blocked FROM v_audit a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.created_at >= c.created_at""")
def consent_stream(spark, sf_dir):
    """Changes and events in one stream of eight micro-batches, in no order of time: late changes reopen finished events."""
    folder = run_dir(spark, "consent-events")
    table(spark, sf_dir, "events").repartition(8, "event_id").write.parquet(folder)
    stream = stream_view(spark, sf_dir, "v_audit", "events", files_per_trigger=1, folder=folder)
    change = F.when(F.col("action_type").isin("error", "signup"), F.col("action_type") == "error")
    decided = consent.decide(stream, "user_id", "id", "created_at", change, horizon="60 days")
    return consent.latest(jobs.collect_table(decided, "x9s")).select(F.col("id").cast("bigint").alias("id"), F.col("user_id").cast("bigint").alias("user_id"), "blocked")


@query("x10_redacted_stream", ("v_pat",), f"SELECT id, {_redact_sql('patient_name')} AS patient_name, {_redact_sql('phone')} AS phone FROM v_pat")
def redacted_stream(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "v_pat", "customer")
    redacted = gv.redacted_view(stream, sc.HEALTHCARE, _reader(stream))
    return jobs.collect_table(redacted, "x10").select("id", "patient_name", "phone")
