"""Integrity monitoring: hashed baselines, change events, drift, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkveil.functions.hashing import hmac_sha256, record_hash

# Severity and compliance impact per kind of change.
SEVERITY = {"record_modified": "high", "record_added": "medium", "record_deleted": "critical"}
IMPACT = {"record_modified": "medium", "record_added": "low", "record_deleted": "high"}

DIFF = T.MapType(T.StringType(), T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))


def schema_text(schema: T.StructType) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)


def schema_hash(schema: T.StructType) -> Column:
    """SHA-256 of column names and types in column order."""
    return F.sha2(F.lit(schema_text(schema)), 256)


def record_hashes(df: DataFrame, id_column: str = "record_id") -> DataFrame:
    """One row per record: id and canonical hash of all its fields."""
    return df.select(F.col(id_column).cast("string").alias("record_id"), record_hash(df.schema).alias("record_hash"))


def baseline(df: DataFrame, baseline_id: str, created_at: Column, id_column: str = "record_id") -> DataFrame:
    """The rows a baseline is stored as: hash and fields per record, never one value for all."""
    payload = [c for c in df.columns if c != id_column]
    return df.select(
        F.lit(baseline_id).alias("baseline_id"),
        created_at.alias("created_at"),
        F.lit(True).alias("is_active"),
        F.col(id_column).cast("string").alias("record_id"),
        record_hash(df.schema).alias("record_hash"),
        schema_hash(df.schema).alias("schema_hash"),
        F.lit(schema_text(df.schema)).alias("columns"),
        *[F.col(f"`{c}`") for c in payload],
    )


def multiset_digest(record_hash: Column) -> Column:
    """Aggregate: SHA-256 over the number of hex hashes and the exact sums of their four 64-bit parts.

    Order-free and combined map-side, equal copies count, and every bit of every hash takes part. Sums of plain
    hashes can be forged by someone who may choose many records; give keyed hashes (`keyed`) where that matters.
    """
    parts = [F.conv(F.substring(record_hash, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.sum(p).cast("string") for p in parts]), 256)


def keyed(record_hash: Column, secret: bytes) -> Column:
    """The hash under a secret, so that nobody without it can find records of a wanted sum."""
    return hmac_sha256(record_hash, secret)


def baseline_summary(stored: DataFrame) -> DataFrame:
    """Totals per baseline with an order-free content hash (`multiset_digest`); no sort or concatenation of all records."""
    return stored.groupBy("baseline_id").agg(
        F.count("*").alias("total_records"), F.max("schema_hash").alias("schema_hash"), multiset_digest(F.col("record_hash")).alias("content_hash")
    )


def latest_active(baselines: DataFrame, file_column: str = "file_id") -> DataFrame:
    """Newest active baseline per file: an aggregate, so no file's history is sorted in one task."""
    names = [c for c in baselines.columns if c != file_column]
    newest = F.max_by(F.struct(*names), F.struct("created_at", "baseline_id"))
    picked = baselines.filter("is_active").groupBy(file_column).agg(newest.alias("b"))
    return picked.select(file_column, *[F.col(f"b.{c}").alias(c) for c in names])


def field_diff(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Map of changed fields to (old, new) texts over the union of the fields; absent counts as NULL."""
    entries = []
    for name in sorted(set(old) | set(new)):
        before = old.get(name, F.lit(None)).cast("string")
        after = new.get(name, F.lit(None)).cast("string")
        entry = F.struct(F.lit(name).alias("key"), F.struct(before.alias("old"), after.alias("new")).alias("value"))
        entries.append(F.when(~before.eqNullSafe(after), entry))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())).cast(DIFF)


def detect_changes(
    trusted: DataFrame, current: DataFrame, id_column: str = "record_id", with_fields: bool = True
) -> DataFrame:
    """Change events between a trusted and a current record set.

    One event per current record that was modified or added and per trusted record that is
    gone. Ids of the trusted set are unique; an id may repeat in the current set, and a
    repeated id only makes a join partition big, which adaptive execution can split because
    the current records are the preserved side of a left join. Field values travel along only
    when the field difference is wanted.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        fields = [c for c in df.columns if c != id_column] if with_fields else []
        packed = [F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in fields]).alias(f"{prefix}_fields")] if fields else []
        return df.select(
            F.col(id_column).cast("string").alias("record_id"), record_hash(df.schema).alias(f"{prefix}_hash"), *packed
        )

    old, new = side(trusted, "old"), side(current, "new")
    matched = new.join(old, "record_id", "left").filter(~F.col("new_hash").eqNullSafe(F.col("old_hash")))
    gone = old.join(new.select("record_id").distinct(), "record_id", "left_anti")
    kind = F.when(F.col("old_hash").isNull(), "record_added").otherwise("record_modified")
    empty = F.lit(None).cast(DIFF)
    diff = empty
    if with_fields:
        before = {c: F.col(f"old_fields.{c}") for c in trusted.columns if c != id_column}
        after = {c: F.col(f"new_fields.{c}") for c in current.columns if c != id_column}
        diff = F.when(F.col("old_hash").isNotNull(), field_diff(before, after))
    changed = matched.select(
        "record_id", "old_hash", "new_hash", kind.alias("change_type"), diff.alias("affected_fields")
    )
    deleted = gone.select(
        "record_id", "old_hash", F.lit(None).cast("string").alias("new_hash"),
        F.lit("record_deleted").alias("change_type"), empty.alias("affected_fields"),
    )
    return as_events(changed.unionByName(deleted))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def as_events(changes: DataFrame, *carried: str) -> DataFrame:
    """Changes as events, with severity, impact and a sentence."""
    kind = F.col("change_type")
    text = (
        F.when(kind == "record_modified", F.concat(F.lit("Record "), F.col("record_id"), F.lit(" was modified")))
        .when(kind == "record_added", F.concat(F.lit("New record "), F.col("record_id"), F.lit(" was added")))
        .otherwise(F.concat(F.lit("Record "), F.col("record_id"), F.lit(" was deleted")))
    )
    return changes.select(
        "change_type", "record_id", "old_hash", "new_hash", _lookup(SEVERITY, kind).alias("severity"),
        _lookup(IMPACT, kind).alias("compliance_impact"), text.alias("description"), "affected_fields", *carried,
    )


def schema_drift(trusted_columns: list[str], df: DataFrame) -> DataFrame:
    """One critical event when the ordered column list differs, with added and removed columns."""
    current = df.columns
    old = F.array(*[F.lit(c) for c in trusted_columns])
    new = F.array(*[F.lit(c) for c in current])
    counted = df.agg(F.count("*").alias("records"))
    return counted.filter(F.lit(list(trusted_columns) != list(current))).select(
        F.lit("schema_changed").alias("change_type"), F.lit("schema").alias("record_id"),
        F.lit("critical").alias("severity"), F.lit("critical").alias("compliance_impact"),
        F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"),
        "records",
    )


def id_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one side has, `missing` from the new or `extra` in it; each once, NULL being an id too.

    One aggregate over both sides: a repeated id is combined before it travels.
    """
    both = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(key, F.lit(0), F.lit(1)))
    seen = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n")).where(F.col("o") != F.col("n"))
    return seen.select(key, F.when(F.col("o") == 1, "missing").otherwise("extra").alias("side"))


def key_union(first: Column, second: Column) -> Column:
    """Sorted names of the fields that either of two records, held as maps, has; a record that is NULL has none."""
    def names(record: Column) -> Column:
        return F.coalesce(F.map_keys(record), F.array().cast("array<string>"))

    return F.array_sort(F.array_union(names(first), names(second)))


def record_drift(records: DataFrame, text: str, trusted: list[str]) -> DataFrame:
    """Events for JSON records whose fields differ from the trusted ones: (added, removed, records, first_text) per difference.

    Unlike a table's columns, fields may drift record by record. A field that holds null is there. Text that is no
    JSON object lacks every field. Differences are counted map-side; `first_text` is the smallest of such records.
    """
    fields = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(c) for c in trusted]).cast("array<string>")
    seen = records.select(
        F.col(text).alias("text"), F.array_sort(F.array_except(fields, wanted)).alias("added"), F.array_sort(F.array_except(wanted, fields)).alias("removed")
    )
    drifted = seen.where((F.size("added") > 0) | (F.size("removed") > 0)).groupBy("added", "removed")
    return drifted.agg(F.count("*").alias("records"), F.min("text").alias("first_text")).select(
        F.lit("schema_changed").alias("change_type"), F.lit("critical").alias("severity"), "added", "removed", "records", "first_text"
    )


def record_schemas(records: DataFrame, text: str) -> DataFrame:
    """(schema_hash, schema, records): the schemas, field names with types, that JSON records were found with.

    The hash is taken of a schema, not of a record: there are as many as schemas. Text that is no JSON has the schema NULL.
    """
    found = records.select(F.schema_of_variant(F.try_parse_json(text)).alias("schema"))
    return found.groupBy("schema").agg(F.count("*").alias("records")).select(F.sha2("schema", 256).alias("schema_hash"), "schema", "records")


def count_drift(trusted: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One event when the number of records moved by more than the threshold; an empty baseline gives none."""
    before = trusted.agg(F.count("*").alias("n")).scalar()
    counts = current.agg(F.count("*").alias("new_count")).select(before.alias("old_count"), "new_count")
    share = F.try_divide(F.abs(F.col("new_count") - F.col("old_count")), F.col("old_count"))
    return counts.filter(share > F.lit(threshold)).select(
        F.lit("metadata_changed").alias("change_type"), F.lit("row_count").alias("record_id"),
        F.lit("high").alias("severity"), F.lit("medium").alias("compliance_impact"),
        "old_count", "new_count", (share * 100).alias("change_percentage"),
    )


def escalated(events: DataFrame) -> DataFrame:
    """Events that also become compliance violations: severe ones with a severe impact."""
    return events.filter(
        F.col("severity").isin("critical", "high") & F.col("compliance_impact").isin("high", "critical")
    ).select(
        F.lit("integrity").alias("violation_type"), F.lit("unauthorized_change").alias("violation_category"),
        "severity", F.concat(F.lit("Data integrity violation: "), F.col("description")).alias("description"),
        "record_id", F.lit(1).alias("affected_records_count"), F.lit("restricted").alias("data_classification"),
    )


def resolve(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Events with the latest resolution applied; resolutions are appended, never rewritten in place.

    `resolutions` has event_id, status, notes, resolved_by, resolved_at. Only the newest per
    event is kept before the join, so its side has unique keys.
    """
    newest = resolutions.groupBy("event_id").agg(
        F.max_by(F.struct("status", "notes", "resolved_by", "resolved_at"), F.struct("resolved_at", "status")).alias("r")
    )
    joined = events.join(newest, "event_id", "left")
    kept = [c for c in events.columns if c != "status"]
    return joined.select(
        *kept, F.coalesce(F.col("r.status"), F.col("status")).alias("status"), F.col("r.notes").alias("resolution_notes"),
        F.col("r.resolved_by").alias("resolved_by"), F.col("r.resolved_at").alias("resolved_at"),
    )


def apply_updates(records: DataFrame, updates: DataFrame, id_column: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Merge updated rows into a record table and give the change log rows.

    `updates` has the same columns with unique ids. An update of an unknown id is ignored, as
    an UPDATE would be.
    """
    fields = [c for c in records.columns if c != id_column]
    right = updates.select(F.col(id_column), F.struct(*fields).alias("__new"), record_hash(updates.schema).alias("__new_hash"))
    left = records.select("*", record_hash(records.schema).alias("__old_hash"))
    joined = left.join(right, id_column, "left")
    has_update = F.col("__new").isNotNull()
    merged = joined.select(
        id_column, *[F.when(has_update, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    ).select(*records.columns)
    diff = field_diff({c: F.col(c) for c in fields}, {c: F.col(f"__new.{c}") for c in fields})
    changes = joined.filter(has_update).select(
        id_column, F.lit("UPDATE").alias("change_type"), diff.alias("changed_fields"),
        F.lit("user").alias("change_source"), F.col("__old_hash").alias("old_hash"), F.col("__new_hash").alias("new_hash"),
    )
    return merged, changes


def expectations(df: DataFrame, min_rows: int, max_rows: int | None, ranges: dict[str, tuple[float, float]], not_null: list[str]) -> DataFrame:
    """Row-count, range and completeness checks with an alert flag, all in one aggregate."""
    aggregates = [F.count("*").alias("rows")]
    aggregates += [F.count_if(~F.col(c).between(lo, hi)).alias(f"range_{c}") for c, (lo, hi) in ranges.items()]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null]
    n = F.col("rows")
    outside = (n < min_rows) | (F.lit(False) if max_rows is None else n > max_rows)
    rows = [F.struct(F.lit("row_count").alias("expectation"), n.alias("observed"), outside.alias("alert"))]
    for name in [f"range_{c}" for c in ranges] + [f"null_{c}" for c in not_null]:
        rows.append(F.struct(F.lit(name).alias("expectation"), F.col(name).alias("observed"), (F.col(name) > 0).alias("alert")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
