"""Compliance, audit and performance reports.

Facts are counted per join key before they are joined, so a file with a third of all
violations adds one row to the join and no join multiplies rows. Times are parameters
("as of"); callers default them to the newest time of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkveil.operators.quantiles import exact_quantiles
from sparkveil.plans.joins import left_join_many
from sparkveil.plans.numbering import row_numbers


def newest(df: DataFrame, column: str = "created_at") -> Column:
    """The newest time of a table as a scalar subquery, to stand in for "now"."""
    return df.agg(F.max(column).alias("t")).scalar()


def since(df: DataFrame, as_of: Column, unit: str, amount: int, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column) >= F.timestamp_add(unit, F.lit(-amount), as_of))


def only(df: DataFrame, **filters) -> DataFrame:
    """Equality filters, added to the plan only when a value is given."""
    for column, value in filters.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


# --------------------------------------------------------------------- file and event status


def event_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("severity") == "critical").alias("critical_events"),
        F.count_if(F.col("severity") == "high").alias("high_events"),
        F.count_if(F.col("status") == "open").alias("open_events"),
        F.max("created_at").alias("last_event"),
    )


def file_status(files: DataFrame, events: DataFrame) -> DataFrame:
    """Event counts per file, files without events included."""
    joined = files.join(event_counts(events, "file_id"), "file_id", "left")
    counts = ("total_events", "critical_events", "high_events", "open_events")
    return joined.select(
        "file_id", "filename", "file_status", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "last_event"
    )


def event_statistics(events: DataFrame, as_of: Column) -> DataFrame:
    """Totals and the last 24 hours in one pass."""
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("severity") == "critical").alias("critical_events"),
        F.count_if(F.col("severity") == "high").alias("high_events"),
        F.count_if(F.col("status") == "open").alias("open_events"),
        F.count_if(F.col("created_at") >= F.timestamp_add("HOUR", F.lit(-24), as_of)).alias("recent_events_24h"),
    )


def processing_summary(files: DataFrame, users: DataFrame, jobs: DataFrame, violations: DataFrame) -> DataFrame:
    """Files with an owner, their jobs if any, and the number of violations per file."""
    counted = violations.groupBy("file_id").agg(F.count("*").alias("compliance_violations"))
    owners = users.select(F.col("user_id").alias("created_by"), F.col("username").alias("uploaded_by"))
    details = jobs.select("file_id", "job_id", "pipeline_type", F.col("status").alias("processing_status"), "processing_time_seconds")
    described = files.join(owners, "created_by").select("file_id", "filename", "uploaded_by")
    # The violations are counted once; the count joins last because both parts of the job join read their inputs.
    return left_join_many(described, details, "file_id").join(counted, "file_id", "left").select(
        "file_id", "filename", "uploaded_by", "job_id", "pipeline_type", "processing_status", "processing_time_seconds",
        F.coalesce("compliance_violations", F.lit(0)).alias("compliance_violations"),
    )


def system_statistics(users: DataFrame, files: DataFrame, records: DataFrame, jobs: DataFrame, violations: DataFrame, logins: DataFrame, as_of: Column) -> DataFrame:
    """Six counts as rows (statistic, n), each a global aggregate of its own table."""

    def row(name: str, df: DataFrame, counted: Column) -> DataFrame:
        return df.agg(counted.alias("n")).select(F.lit(name).alias("statistic"), "n")

    recent = F.col("created_at") >= F.timestamp_add("HOUR", F.lit(-24), as_of)
    parts = [
        row("total_users", users, F.count_if(F.col("is_active"))),
        row("total_files", files, F.count("*")),
        row("total_records", records, F.count("*")),
        row("active_jobs", jobs, F.count_if(F.col("status").isin("pending", "running"))),
        row("open_violations", violations, F.count_if(F.col("status") == "open")),
        row("recent_logins", logins.filter(recent), F.count_distinct("user_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -------------------------------------------------------------------------- violation report


def violation_trend(violations: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Violations and affected files per day of the last `days` dates, the newest included and first."""
    recent = violations.where(F.to_date("created_at") > F.date_sub(F.to_date(as_of), days))
    daily = recent.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("violations_count"), F.count_distinct("file_id").alias("files_affected")
    )
    return daily.orderBy(F.col("date").desc())


def type_statistics(violations: DataFrame) -> DataFrame:
    return violations.groupBy("violation_type", "severity").agg(
        F.count("*").alias("n"), F.count_distinct("file_id").alias("files_affected")
    )


def top_files(violations: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """Files with most violations: counted and cut to `n` rows before file names are joined."""
    counted = violations.groupBy("file_id").agg(
        F.count("*").alias("violation_count"), F.count_distinct("violation_type").alias("violation_types_count")
    )
    top = counted.orderBy(F.col("violation_count").desc(), "file_id").limit(n)
    names = files.select("file_id", "filename")
    return names.join(top, "file_id")


def violation_summary(violations: DataFrame) -> DataFrame:
    """Totals of the whole filtered set, not of one page."""
    return violations.agg(
        F.count("*").alias("total_violations"),
        F.count_distinct("file_id").alias("unique_files_affected"),
        F.count_distinct("violation_type").alias("violation_types"),
    )


#: Partitions up to which Spark writes a shuffle without a buffer that sorts it.
UNSORTED = 200


def records_with_violations(records: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """Records with their violation count and types.

    The list of types is kept as counts per type, `array<struct<type, n>>`: the same multiset
    with at most one entry per type, so a record with millions of violations stays small.
    """
    # The counting has finer partitions of its own. Beside the join that often makes the violations, the hash tables and
    # lists of a partition's records would add to its sorts, and partitions are sized by bytes that compress to little here.
    own = int(violations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = violations.select(key, "violation_type").repartition(max(own, min(4 * own, UNSORTED)), key)
    per_type = rows.groupBy(key, "violation_type").agg(F.count("*").alias("n"))
    listed = per_type.groupBy(key).agg(
        F.sum("n").alias("violation_count"),
        F.array_sort(F.collect_list(F.struct(F.col("violation_type").alias("type"), "n"))).alias("violation_types"),
    )
    return records.join(listed, key, "left").select(
        *records.columns,
        F.coalesce("violation_count", F.lit(0)).alias("violation_count"),
        "violation_types",
    )


def violation_details(violations: DataFrame, files: DataFrame, users: DataFrame) -> DataFrame:
    """Violations with file name and owner; violations are the preserved side of left joins."""
    owned = files.join(users.select(F.col("user_id").alias("created_by"), "username"), "created_by", "left")
    return violations.join(owned.select("file_id", "filename", "username"), "file_id", "left")


# ------------------------------------------------------------------------------- job reports


def job_details(jobs: DataFrame, files: DataFrame, users: DataFrame, file_types: DataFrame) -> DataFrame:
    owned = files.join(users.select(F.col("user_id").alias("created_by"), "username"), "created_by", "left").join(
        file_types, "file_type_id", "left"
    )
    return jobs.join(owned.select("file_id", "filename", "username", "type_label"), "file_id")


def job_summary(jobs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return jobs.agg(
        F.count("*").alias("total_jobs"), done.alias("completed_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.coalesce(F.try_divide(done * 100.0, F.count("*")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("records_processed"), F.lit(0)).alias("total_records_processed"),
    )


def throughput() -> Column:
    return F.try_divide(F.col("records_processed"), F.col("processing_time_seconds"))


def pipeline_performance(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Completed jobs of the last days: counts, records, throughput and time per pipeline."""
    done = since(jobs.filter("status = 'completed'"), as_of, "DAY", days)
    rate = throughput()
    return done.groupBy("pipeline_type").agg(
        F.count("*").alias("total_jobs"), F.avg("records_processed").alias("avg_records_processed"),
        F.avg(rate).alias("avg_throughput"), F.max(rate).alias("max_throughput"), F.min(rate).alias("min_throughput"),
        F.avg("processing_time_seconds").alias("avg_processing_time_seconds"),
    )


def processing_trend(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    done = since(jobs.filter("status = 'completed'"), as_of, "DAY", days)
    return done.groupBy(F.to_date("created_at").alias("date"), "pipeline_type").agg(
        F.count("*").alias("jobs_count"), F.avg("records_processed").alias("avg_records"), F.avg(throughput()).alias("avg_throughput")
    )


def audit_statistics(audit: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return since(audit, as_of, "HOUR", hours).groupBy("action_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("unique_users")
    )


def audit_trail(audit: DataFrame, users: DataFrame, as_of: Column, hours: int = 24, n: int = 100, **filters) -> DataFrame:
    """Newest audit rows with user names: filtered and cut before the join."""
    newest_rows = since(only(audit, **filters), as_of, "HOUR", hours).orderBy(F.col("created_at").desc(), "id").limit(n)
    return newest_rows.join(users.select("user_id", "username"), "user_id", "left")


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page with the total and whether more rows follow."""
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.select("*", total.alias("total_count"), (F.lit(offset + limit) < total).alias("has_more"))


# ------------------------------------------------------------------------ experiment reports


def run_comparison(runs: DataFrame) -> DataFrame:
    """Throughput, violation rate and latency per pipeline over all runs."""
    rate = F.col("throughput")
    return runs.groupBy("pipeline_type").agg(
        F.count("*").alias("total_jobs"), F.avg(rate).alias("avg_throughput"), F.max(rate).alias("max_throughput"),
        F.min(rate).alias("min_throughput"), F.avg("violation_rate").alias("avg_violation_rate"),
        F.avg("latency").alias("avg_latency"), F.max("latency").alias("max_latency"), F.min("latency").alias("min_latency"),
    )


def technique_analysis(runs: DataFrame) -> DataFrame:
    """Jobs, time, throughput and spread of the privacy level per technique, ranked by throughput."""
    grouped = runs.groupBy("technique").agg(
        F.count("*").alias("jobs"), F.avg("processing_time").alias("avg_processing_time"),
        F.avg("throughput").alias("avg_throughput"), F.avg("privacy_level").alias("avg_privacy_level"),
        F.stddev_pop("privacy_level").alias("privacy_std"),
    )
    # One row per technique reaches this window.
    order = Window.orderBy(F.col("avg_throughput").desc(), "technique")
    return grouped.select("*", F.row_number().over(order).alias("performance_rank"))


def overhead_by_pipeline(runs: DataFrame, base_rate: float = 1000.0) -> DataFrame:
    """Violation rate and estimated overhead max(0, (base - throughput) / base) per pipeline."""
    overhead = F.greatest(F.lit(0.0), (F.lit(base_rate) - F.col("throughput")) / F.lit(base_rate))
    return runs.groupBy("pipeline_type").agg(
        F.count("*").alias("jobs"), F.avg("violation_rate").alias("avg_violation_detection"),
        F.avg(overhead).alias("avg_anonymization_overhead"),
    )


def parameter_analysis(runs: DataFrame, parameter: str) -> DataFrame:
    return runs.filter(F.col(parameter).isNotNull()).groupBy(parameter).agg(
        F.count("*").alias("jobs"), F.avg("throughput").alias("avg_throughput"),
        F.avg("privacy_level").alias("avg_privacy_level"), F.avg("processing_time").alias("avg_processing_time"),
    )


def insights(runs: DataFrame) -> DataFrame:
    """(insight, value): the technique of highest mean privacy, the pipelines of highest mean throughput and of most runs.

    All three come out of one aggregate per technique and pipeline; of equals the last by name is taken.
    """
    parts = runs.groupBy("technique", "pipeline_type").agg(
        F.sum("privacy_level").alias("privacy"), F.count("privacy_level").alias("n_privacy"),
        F.sum("throughput").alias("speed"), F.count("throughput").alias("n_speed"), F.count("*").alias("runs"),
    )

    def best(key: str, measure: Column, insight: str) -> DataFrame:
        ranked = parts.groupBy(key).agg(measure.alias("m"))
        return ranked.agg(F.max_by(key, F.struct("m", key)).alias("value")).select(F.lit(insight).alias("insight"), "value")

    privacy = F.try_divide(F.sum("privacy"), F.sum("n_privacy"))
    speed = F.try_divide(F.sum("speed"), F.sum("n_speed"))
    return best("technique", privacy, "best_privacy_technique").unionByName(best("pipeline_type", speed, "fastest_pipeline")).unionByName(
        best("pipeline_type", F.sum("runs"), "most_used_pipeline")
    )


def experiment_groups(runs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean, sample standard deviation and standard error per experiment group."""
    aggregates = [F.count("*").alias("runs")]
    for m in measures:
        aggregates += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
            (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_sem"),
        ]
    return runs.groupBy(*keys).agg(*aggregates)


def best_settings(runs: DataFrame) -> DataFrame:
    """Run with the best throughput and run with the best latency."""
    rate, delay = F.struct("throughput", "run_id"), F.struct("latency", "run_id")
    return runs.agg(
        F.count("*").alias("total_experiments"), F.avg("throughput").alias("avg_throughput"),
        F.max("throughput").alias("best_throughput"), F.max_by("technique", rate).alias("best_throughput_method"),
        F.min("latency").alias("best_latency"), F.min_by("technique", delay).alias("best_latency_method"),
    )


def by_size(runs: DataFrame) -> DataFrame:
    """Averages per data size with the scaling efficiency rate / size."""
    return runs.groupBy("size").agg(
        F.count("*").alias("total_experiments"), F.avg("processing_time").alias("avg_processing_time"),
        F.avg("throughput").alias("avg_throughput"), (F.avg("throughput") / F.col("size")).alias("scaling_efficiency"),
    )


def routing_overview(runs: DataFrame) -> DataFrame:
    """Mean stream and batch share, routing overhead, and overhead over latency."""
    return runs.agg(
        F.avg("stream_percentage").alias("stream_percentage"), F.avg("batch_percentage").alias("batch_percentage"),
        F.avg("router_ms").alias("avg_routing_overhead_ms"),
        F.coalesce(F.try_divide(F.avg("router_ms"), F.avg("latency")), F.lit(0.0)).alias("routing_efficiency"),
    )


def latency_statistics(df: DataFrame, latency: str, *keys: str) -> DataFrame:
    """Mean, extremes, population deviation and exact p50, p95, p99 of a latency; NULL latencies do not count."""
    stats = df.groupBy(*keys).agg(
        F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency"), F.min(latency).alias("min_latency"),
        F.stddev_pop(latency).alias("latency_std"),
    )
    shares = {"p50_latency": 0.5, "p95_latency": 0.95, "p99_latency": 0.99}
    points = exact_quantiles(df, latency, shares, *keys)
    group = (F.struct(*keys) if keys else F.lit(0)).alias("__group")
    return stats.select("*", group).join(points.select(group, *shares), "__group", "left").drop("__group")


def run_summary(runs: DataFrame) -> DataFrame:
    """Number of runs, success rate and averages over the successful ones."""
    good = F.col("success")
    return runs.agg(
        F.count("*").alias("total_experiments"), F.count_if(good).alias("successful_experiments"),
        F.try_divide(F.count_if(good), F.count("*")).alias("success_rate"),
        F.avg(F.when(good, F.col("processing_time"))).alias("avg_processing_time"),
        F.avg(F.when(good, F.col("throughput"))).alias("avg_throughput"),
    )


def run_consistency(runs: DataFrame, *keys: str) -> DataFrame:
    """Range over mean of the run times with the grade excellent (< 10 %), good (< 20 %) or high variance."""
    spread = (F.max("processing_time") - F.min("processing_time")) * 100.0 / F.avg("processing_time")
    out = runs.groupBy(*keys).agg(F.avg("processing_time").alias("avg_time"), spread.alias("variance_percent"))
    grade = F.when(F.col("variance_percent") < 10, "excellent").when(F.col("variance_percent") < 20, "good").otherwise("high variance")
    return out.select("*", grade.alias("consistency"))


def integrity_report(events: DataFrame, open_violations: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows (section, item, n): events by severity and type, open violations, and recommendations."""
    recent = since(events, as_of, "DAY", days)
    counts = recent.groupBy("severity", "event_type").agg(F.count("*").alias("n"))
    # All later steps work on this small count table.
    by_severity = counts.groupBy(F.col("severity").alias("item")).agg(F.sum("n").alias("n")).select(F.lit("severity").alias("section"), "item", "n")
    by_type = counts.groupBy(F.col("event_type").alias("item")).agg(F.sum("n").alias("n")).select(F.lit("event_type").alias("section"), "item", "n")
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("severity") == "critical", F.col("n"))), F.lit(0)).alias("critical"),
    )
    opened = open_violations.agg(F.count("*").alias("n"))
    totals = total.select("events", "critical", opened.scalar().alias("open"))

    def advice(test: Column, text: str, n: Column) -> Column:
        return F.when(test, F.struct(F.lit("recommendation").alias("section"), F.lit(text).alias("item"), n.cast("bigint").alias("n")))

    rows = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("events").alias("item"), F.col("events").cast("bigint").alias("n")),
        F.struct(F.lit("total").alias("section"), F.lit("open_violations").alias("item"), F.col("open").cast("bigint").alias("n")),
        advice(F.col("critical") > 0, "investigate critical events", F.col("critical")),
        advice(F.col("open") > 0, "resolve open violations", F.col("open")),
        advice(F.col("events") == 0, "no events, monitoring normal", F.lit(0)),
    )
    tail = totals.select(F.inline(F.array_compact(rows)))
    return by_severity.unionByName(by_type).unionByName(tail)


# -------------------------------------------------------------------------------- job states


def latest_state(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Current row per key from an append-only log of partial updates.

    Every field keeps its last non-NULL value, `started_at` is the first time the job ran and
    `completed_at` the last time it ended: aggregates, so no job's log is sorted in one task.
    """
    position = F.struct(*order)
    at = order[0]
    ended = F.col("status").isin("completed", "failed")
    return log.groupBy(key).agg(
        F.max_by("status", position).alias("status"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), position)).alias(f) for f in fields],
        F.min(F.when(F.col("status") == "running", F.col(at))).alias("started_at"),
        F.max(F.when(ended, F.col(at))).alias("completed_at"),
    )


def file_list(files: DataFrame, types: DataFrame, users: DataFrame) -> DataFrame:
    """Files of a known type with the type's label and the name of who made them; NULL where that user is unknown."""
    makers = users.select(F.col("user_id").alias("created_by"), "username")
    return files.join(types, "file_type_id").join(makers, "created_by", "left").select("file_id", "filename", "type_label", "username")


def job_violation_counts(jobs: DataFrame, files: DataFrame, violations: DataFrame) -> DataFrame:
    """All jobs with the name of their file and the number of their violations, which are counted before the join."""
    counted = violations.groupBy("job_id").agg(F.count("*").alias("n"))
    named = jobs.join(files.select("file_id", "filename"), "file_id", "left").join(counted, "job_id", "left")
    return named.select("job_id", "pipeline_type", "filename", F.coalesce("n", F.lit(0)).alias("violations_count"))


def best_of(df: DataFrame, group: str, key: str, rate: Column, name: str) -> DataFrame:
    """(group, key, name): the row with the highest rate, of equal rates the greatest key, by an aggregate without a sort.

    Rows without a rate take no part, and neither does a group that has no rate.
    """
    best = F.max(F.struct(F.col("__rate"), F.col(key))).alias("best")
    rated = df.select(group, key, rate.alias("__rate")).where(F.col("__rate").isNotNull())
    return rated.groupBy(group).agg(best).select(group, F.col("best")[key].alias(key), F.col("best")["__rate"].alias(name))


def ranking(df: DataFrame, key: str, rate: Column, name: str) -> DataFrame:
    """(key, name, rank): all rows with a rate ranked over the whole table, highest first, of equal rates the smallest key first.

    `key` is unique. The ranks are counted over ranges, so no task sorts the table.
    """
    rated = df.select(F.col(key), rate.cast("double").alias(name)).where(F.col(name).isNotNull())
    ranked = row_numbers(rated.withColumn("__down", -F.col(name)), ["__down", key], "rank")
    return ranked.select(key, name, "rank")


def first_rows(df: DataFrame, order: list[str], columns: list[str], n: int = 10) -> DataFrame:
    """The first n rows along `order`, as a preview: every task keeps its n first, and one takes n of those."""
    return df.select(*columns, *[c for c in order if c not in columns]).orderBy(*order).limit(n).select(*columns)
