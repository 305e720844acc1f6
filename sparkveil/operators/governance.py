"""Roles and permissions, masking by access level, minimization, transfers, erasure, breach clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkveil.functions.values import pick, present
from sparkveil.schemas import Schema

# Roles, permissions and which role holds which permission.
ROLES = ("admin", "data_analyst", "compliance_officer", "security_manager", "viewer", "data_engineer")
PERMISSIONS = (
    "file_read", "file_write", "file_delete", "file_admin",
    "record_read", "record_write", "record_delete", "record_admin",
    "system_read", "system_write", "system_admin",
    "compliance_read", "compliance_write", "compliance_admin",
    "audit_read", "audit_admin",
)
GRANTS = {
    "admin": PERMISSIONS,
    "data_analyst": ("file_read", "file_write", "record_read", "record_write", "system_read", "compliance_read"),
    "compliance_officer": ("file_read", "record_read", "system_read", "compliance_read", "compliance_write", "audit_read"),
    "security_manager": (
        "file_read", "record_read", "system_read", "system_write", "compliance_read", "audit_read", "audit_admin",
    ),
    "viewer": ("file_read", "record_read", "system_read", "compliance_read"),
    "data_engineer": ("file_read", "file_write", "record_read", "record_write", "system_read", "system_write"),
}


def roles(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{r}')" for i, r in enumerate(ROLES, 1))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(role_id, role_code)")


def role_permissions(spark: SparkSession, granted: dict[str, tuple[str, ...]] = GRANTS) -> DataFrame:
    """One row per role and permission, from the grants and not from a cross of the two tables."""
    rows = ", ".join(
        f"({i}, '{r}', '{p}', '{p.split('_')[0]}', '{p.split('_')[1]}')" for i, r in enumerate(ROLES, 1) for p in granted[r]
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(role_id, role_code, permission_code, resource_type, action)"
    )


def user_permissions(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """Permissions of active users; the seeded permission table is small enough to be broadcast by its size."""
    return users.filter("is_active").join(permissions, "role_id").select(
        "user_id", "username", "role_code", "permission_code", "resource_type", "action"
    )


def users_allowed(users: DataFrame, permissions: DataFrame, resource: str, action: str) -> DataFrame:
    """Active users that may do `action` on `resource`; the admin action implies every other."""
    granting = permissions.filter((F.col("resource_type") == resource) & F.col("action").isin(action, "admin"))
    return users.filter("is_active").join(granting.select("role_id").distinct(), "role_id", "left_semi")


# How much of a sensitive field a role may see.
ACCESS_LEVELS = {
    "admin": "full", "compliance_officer": "full", "security_manager": "partial",
    "data_analyst": "masked", "data_engineer": "masked", "viewer": "none",
}


def redact(value: Column, level: Column) -> Column:
    """Full value, its end (at most four characters and half of it), letters and digits masked, or nothing."""
    masked = F.mask(value)
    partial = F.concat(F.lit("****"), F.right(value, F.least(F.lit(4), F.floor(F.length(value) / 2).cast("int"))))
    return F.when(level == "full", value).when(level == "partial", partial).when(level == "masked", masked)


def redacted_view(df: DataFrame, schema: Schema, role: Column, strict: bool = False) -> DataFrame:
    """Sensitive fields by the access level of `role`; other declared fields stay as they are.

    Columns that the schema does not declare stay as they are too, unless `strict`: then they count as sensitive.
    """
    sensitive = {c for c in df.columns if c not in schema.names} | set(schema.sensitive) if strict else set(schema.sensitive)
    leveled = df.select("*", pick(ACCESS_LEVELS, role, "none").alias("__level"))
    return leveled.select(*[
        redact(F.col(c).cast("string"), F.col("__level")).alias(c) if c in sensitive else F.col(c) for c in df.columns
    ])


def row_filter(df: DataFrame, role: Column, owner: Column, user: Column) -> DataFrame:
    """Rows a reader may see: all for full access, own rows otherwise."""
    level = pick(ACCESS_LEVELS, role, "none")
    return df.filter((level == "full") | F.coalesce(owner == user, F.lit(False)))


def minimization(df: DataFrame, schema: Schema, sensitive_names: tuple[str, ...]) -> DataFrame:
    """Columns beyond the declared schema, whether they are personal data, and how many records fill them."""
    declared = set(schema.names)
    types = {f.name: f.dataType for f in df.schema.fields}
    extra = [c for c in df.columns if c not in declared]
    if not extra:
        return df.sparkSession.sql("SELECT '' AS field, false AS is_sensitive, 0L AS filled WHERE false")
    counts = df.agg(*[F.count_if(present(F.col(c), types[c])).alias(c) for c in extra])
    rows = [
        F.struct(F.lit(c).alias("field"), F.lit(c in sensitive_names).alias("is_sensitive"), F.col(c).alias("filled"))
        for c in extra
    ]
    return counts.select(F.inline(F.array(*rows)))


def cross_border(records: DataFrame, countries: DataFrame, origin: str, target: str, consent: Column, legal_basis: Column) -> DataFrame:
    """Transfers that leave the protected zone without consent or legal basis.

    An origin that is no known country counts as protected, so that such a transfer is shown and not lost.

    `countries` (country, protected) is a dimension of a few hundred rows; its size decides
    how Spark joins it.
    """
    zones = countries.select(F.col("country").alias("__c"), F.col("protected").alias("__p"))
    start, end = zones.alias("start"), zones.alias("end")
    joined = (
        records.join(start, F.col(origin) == F.col("start.__c"), "left")
        .join(end, F.col(target) == F.col("end.__c"), "left")
    )
    leaves = F.coalesce(F.col("start.__p"), F.lit(True)) & ~F.coalesce(F.col("end.__p"), F.lit(False))
    excused = F.coalesce(consent, F.lit(False)) | F.coalesce(legal_basis != "", F.lit(False))
    return joined.filter(leaves & ~excused).select(*[F.col(c) for c in records.columns])


def erase(records: DataFrame, requests: DataFrame, subject: str) -> DataFrame:
    """Records without those of subjects that asked for erasure."""
    return records.join(requests.select(subject).distinct(), subject, "left_anti")


def erasure_status(records: DataFrame, requests: DataFrame, subject: str, as_of: Column, days: int = 30) -> DataFrame:
    """Open erasure requests: records still stored, age, and whether the period is over."""
    left = records.groupBy(subject).agg(F.count("*").alias("stored_records"))
    first = requests.groupBy(subject).agg(F.min("requested_at").alias("requested_at"))
    age = F.date_diff(as_of, F.col("requested_at"))
    return first.join(left, subject).select(
        subject, "requested_at", "stored_records", age.alias("age_days"), (age > days).alias("overdue")
    )


def breach_clock(detections: DataFrame, notices: DataFrame, key: str, as_of: Column, hours: int = 72) -> DataFrame:
    """Detected breaches with the time to the first notice that follows, and whether the 72 hours were missed.

    Notices are reduced to one per breach before the outer join; a notice before the detection is none of it.
    """
    found = detections.select(F.col(key).alias("__key"), F.col("detected_at").alias("__at")).distinct()
    follows = notices.join(found, (F.col(key) == F.col("__key")) & (F.col("notified_at") >= F.col("__at")))
    first = follows.groupBy("__key", "__at").agg(F.min("notified_at").alias("notified_at"))
    joined = detections.join(first, (F.col(key) == F.col("__key")) & (F.col("detected_at") == F.col("__at")), "left")
    until = F.coalesce(F.col("notified_at"), as_of)
    elapsed = F.timestamp_diff("SECOND", F.col("detected_at"), until) / F.lit(3600.0)
    return joined.select(
        key, "detected_at", "notified_at", elapsed.alias("hours"), (elapsed > hours).alias("overdue")
    )


def users_with_roles(users: DataFrame, known: DataFrame) -> DataFrame:
    """Users with the code of their role; users without a known role are not listed."""
    return users.join(known, "role_id").select("user_id", "username", "role_code")
