"""Results out: record and violation tables, CSV and parquet, JSON cleaning, experiment log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkveil.functions.hashing import record_hash
from sparkveil.operators import compliance as co
from sparkveil.plans.numbering import row_numbers


def union_results(parts: list[DataFrame]) -> DataFrame:
    """Results with different columns as one set: union of all columns, missing ones NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: they become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> None:
    _flat(df).write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_both(df: DataFrame, path: str) -> None:
    """Parquet next to CSV."""
    write_csv(df, f"{path}/csv")
    write_parquet(df, f"{path}/parquet")


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, **properties: str) -> None:
    """Append to a database table; the driver jar has to be on the class path."""
    df.write.mode("append").option("batchsize", batch_size).jdbc(url, table, properties=properties)


def record_table(df: DataFrame, data_type: str, job_id: str, file_id: str, order: list[str], processed: list[str] | None = None) -> DataFrame:
    """Rows of the record table: id = job id and row number, original and processed JSON, flags, hash."""
    fields = df.columns
    found = df.select("*", co.violations(df, data_type).alias("__v"), record_hash(df.schema).alias("__h"))
    numbered = row_numbers(found, order, "row_number")
    options = {"ignoreNullFields": "false"}
    return numbered.select(
        F.lit(job_id).alias("job_id"), F.lit(file_id).alias("file_id"),
        F.concat(F.lit(f"{job_id}_"), (F.col("row_number") - 1).cast("string")).alias("record_id"),
        "row_number",
        F.to_json(F.struct(*fields), options).alias("original_data"),
        F.to_json(F.struct(*(processed or fields)), options).alias("processed_data"),
        co.has_pii(df).alias("has_pii"), (F.size("__v") > 0).alias("has_violations"),
        co.stored_violation_types(F.col("__v")).alias("violation_types"),
        co.score(F.size("__v")).alias("compliance_score"), F.col("__h").alias("record_hash"),
    )


def audit_rows(df: DataFrame, action: Column, user: Column, at: Column, resource: str, details: list[str]) -> DataFrame:
    """Audit events as they are appended: who did what to which resource and when, with details as JSON."""
    return df.select(
        action.alias("action_type"), user.alias("user_id"), F.lit(resource).alias("resource_type"), at.alias("created_at"),
        F.to_json(F.struct(*details), {"ignoreNullFields": "false"}).alias("details"),
    )


def violation_table(df: DataFrame, data_type: str, key: str, file_id: str) -> DataFrame:
    """One row per violation."""
    rows = co.violation_rows(df, data_type, [key])
    return rows.select(
        F.lit(file_id).alias("file_id"), F.col(key).cast("string").alias("record_id"), F.col("type").alias("violation_type"),
        F.col("regulation").alias("violation_category"), "severity", "description",
        F.split("field", ",").alias("affected_columns"), F.lit("open").alias("status"),
    )


def violating_record_table(df: DataFrame, data_type: str, key: str, file_id: str) -> DataFrame:
    """One row per violating record, as the batch path stores them."""
    found = df.select(F.col(key).cast("string").alias("record_id"), co.violations(df, data_type).alias("v")).filter(F.size("v") > 0)
    return found.select(
        F.lit(file_id).alias("file_id"), "record_id", co.max_severity(F.col("v")).alias("severity"),
        F.size("v").alias("violations"), F.lit("open").alias("status"),
    )


def clean(column: Column, data_type: T.DataType) -> Column:
    """JSON-safe value: NaN, infinities and 'nan' become NULL, times become ISO text, through nested types."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))
        return F.when(finite, column)
    if isinstance(data_type, T.StringType):
        return F.when(F.lower(column) != "nan", column)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda x: clean(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(column, lambda _, v: clean(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [clean(column[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def clean_records(df: DataFrame) -> DataFrame:
    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_lines(df: DataFrame) -> DataFrame:
    """Cleaned records as JSON text with NULL fields kept."""
    cleaned = clean_records(df)
    return cleaned.select(F.to_json(F.struct(*cleaned.columns), {"ignoreNullFields": "false"}).alias("value"))


# Columns of the experiment log in order, with their defaults.
EXPERIMENT_COLUMNS = (
    ("experiment_id", "string", None), ("timestamp", "string", None), ("pipeline_type", "string", None),
    ("dataset_type", "string", None), ("dataset_size", "bigint", 0), ("anonymization_method", "string", None),
    ("anonymization_params", "string", None), ("pure_processing_time_seconds", "double", 0.0),
    ("pre_processing_time_seconds", "double", 0.0), ("post_processing_time_seconds", "double", 0.0),
    ("total_time_seconds", "double", 0.0), ("records_processed", "bigint", 0), ("records_per_second", "double", 0.0),
    ("violations_detected", "bigint", 0), ("violation_rate", "double", 0.0), ("memory_usage_mb", "double", 0.0),
    ("cpu_usage_percent", "double", 0.0), ("anonymization_overhead_seconds", "double", 0.0),
    ("compliance_check_time_seconds", "double", 0.0), ("avg_latency_ms", "double", 0.0), ("max_latency_ms", "double", 0.0),
    ("min_latency_ms", "double", 0.0), ("latency_std_ms", "double", 0.0), ("subprocess_overhead_ms", "double", 0.0),
    ("e2e_latency_ms", "double", 0.0), ("router_time_ms", "double", 0.0), ("stream_percentage", "double", 0.0),
    ("batch_percentage", "double", 0.0), ("information_loss_score", "double", 0.0),
    ("utility_preservation_score", "double", 0.0), ("privacy_level_score", "double", 0.0), ("success", "boolean", True),
    ("error_message", "string", ""), ("notes", "string", ""),
)


def experiment_log(runs: DataFrame) -> DataFrame:
    """Runs in the fixed column order; rate and latencies are derived where they are not given."""
    have = set(runs.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    records = given("records_processed", F.lit(0))
    per_record = F.coalesce(F.try_divide(given("pure_processing_time_seconds", F.lit(0.0)) * 1000.0, records), F.lit(0.0))
    derived = {
        "records_per_second": F.coalesce(F.try_divide(records, given("pure_processing_time_seconds", F.lit(0.0))), F.lit(0.0)),
        "avg_latency_ms": per_record, "max_latency_ms": per_record, "min_latency_ms": per_record,
        "e2e_latency_ms": F.coalesce(F.try_divide(given("total_time_seconds", F.lit(0.0)) * 1000.0, records), F.lit(0.0)),
    }
    return runs.select(*[
        given(name, derived.get(name, F.lit(default))).cast(kind).alias(name) for name, kind, default in EXPERIMENT_COLUMNS
    ])
