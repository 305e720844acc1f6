"""Compliance rules as column expressions.

A rule is a predicate over the columns of a record plus a description; its type, field,
severity and regulation are constants. Rules whose columns are absent drop out when the plan
is built, so a record set is checked in one projection without a shuffle, and the same
columns work on streams.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkveil.functions import patterns
from sparkveil.functions.values import any_of, present

VIOLATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "field", "description", "severity", "regulation")]
)

# Order of severities.
SEVERITIES = ("low", "medium", "high", "critical")

Columns = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """One check. `predicate` must never be NULL-sensitive: NULL counts as "no violation"."""

    name: str
    type: str
    field: str
    severity: str
    regulation: str
    needs: tuple[str, ...]
    predicate: Callable[[Columns], Column]
    description: Callable[[Columns], Column] | str

    def hits(self, columns: Columns) -> Column:
        return F.coalesce(self.predicate(columns), F.lit(False))

    def violation(self, columns: Columns) -> Column:
        text = F.lit(self.description) if isinstance(self.description, str) else self.description(columns)
        return F.struct(
            F.lit(self.type).alias("type"),
            F.lit(self.field).alias("field"),
            text.alias("description"),
            F.lit(self.severity).alias("severity"),
            F.lit(self.regulation).alias("regulation"),
        )


def _phi(column: str, pattern: str, label: str, severity: str) -> Rule:
    return Rule(
        name=f"phi_{column}",
        type="phi_exposure",
        field=column,
        severity=severity,
        regulation="HIPAA",
        needs=(column,),
        predicate=lambda c: c[column].rlike(pattern) & ~c[column].contains("***"),
        description=f"Exposed {label}",
    )


PHI_RULES = (
    _phi("ssn", patterns.SSN, "Social Security Number in XXX-XX-XXXX format", "critical"),
    _phi("phone", patterns.PHONE, "Phone number in (XXX) XXX-XXXX format", "high"),
    _phi("email", patterns.EMAIL, "Email address in standard format", "high"),
    _phi("medical_record_number", patterns.MRN, "Medical Record Number", "critical"),
)

CONSENT_RULES = (
    Rule(
        name="consent_missing",
        type="missing_consent",
        field="consent_given",
        severity="critical",
        regulation="GDPR",
        needs=("consent_given",),
        predicate=lambda c: ~F.coalesce(c["consent_given"], F.lit(False)),
        description="Processing personal data without explicit consent",
    ),
    Rule(
        name="consent_withdrawn",
        type="unauthorized_access",
        field="processing_status",
        severity="critical",
        regulation="GDPR",
        needs=("consent_withdrawn", "processing_status"),
        predicate=lambda c: c["consent_withdrawn"] & (c["processing_status"] == "active"),
        description="Processing data after consent withdrawal",
    ),
)


def retention_rule(limit_days: int = 365) -> Rule:
    return Rule(
        name="retention",
        type="data_retention",
        field="data_retention_days",
        severity="medium",
        regulation="GDPR",
        needs=("data_retention_days",),
        predicate=lambda c: c["data_retention_days"] > F.lit(limit_days),
        description=lambda c: F.concat(
            F.lit("Data retained for "),
            c["data_retention_days"].cast("string"),
            F.lit(f" days, exceeds limit of {limit_days}"),
        ),
    )


PCI_RULE = Rule(
    name="pci_card",
    type="phi_exposure",
    field="credit_card",
    severity="critical",
    regulation="PCI-DSS",
    needs=("credit_card",),
    predicate=lambda c: c["credit_card"].rlike("^" + patterns.CARD) & ~c["credit_card"].contains("*"),
    description="Exposed credit card number violates PCI-DSS",
)


def _precise(coordinate: Column) -> Column:
    """More than two decimals, tested on the number and not on its text."""
    hundredfold = coordinate.cast("double") * 100
    return F.abs(hundredfold - F.round(hundredfold)) > F.lit(1e-6)


LOCATION_RULE = Rule(
    name="location",
    type="unauthorized_access",
    field="location_lat,location_lng",
    severity="high",
    regulation="GDPR",
    needs=("location_lat", "location_lng"),
    predicate=lambda c: (c["location_lat"] != 0)
    & (c["location_lng"] != 0)
    & (_precise(c["location_lat"]) | _precise(c["location_lng"])),
    description="Precise location data without proper anonymization",
)


@dataclass
class RuleBook:
    """Rule sets by data type; an unknown data type gets all rules."""

    retention_days: int = 365
    extra: dict[str, list[Rule]] = field(default_factory=dict)

    def register(self, rule: Rule, *data_types: str) -> RuleBook:
        """Add a rule of the user to the named sets (and always to `all`)."""
        for data_type in (*data_types, "all"):
            self.extra.setdefault(data_type, []).append(rule)
        return self

    def rules(self, data_type: str = "all") -> list[Rule]:
        retention = (retention_rule(self.retention_days),)
        sets = {
            "healthcare": PHI_RULES + CONSENT_RULES,
            "financial": CONSENT_RULES + retention,
            "ecommerce": (PCI_RULE,) + CONSENT_RULES + retention,
            "iot": (LOCATION_RULE,) + CONSENT_RULES + retention,
            "customer": CONSENT_RULES + retention,
            "all": PHI_RULES + CONSENT_RULES + retention + (PCI_RULE, LOCATION_RULE),
        }
        known = data_type in sets or data_type in self.extra
        name = data_type if known else "all"
        return [*sets.get(name, ()), *self.extra.get(name, ())]

    def applicable(self, df: DataFrame, data_type: str, aliases: Mapping[str, str] | None = None):
        """Rules whose columns exist, and the columns under the names the rules use.

        `aliases` maps a rule column to the column that plays its role in this record set,
        such as `{"credit_card": "credit_card_number"}`.
        """
        columns = {c: F.col(f"`{c}`") for c in df.columns}
        for role, actual in (aliases or {}).items():
            if actual in df.columns:
                columns[role] = F.col(f"`{actual}`")
        return [r for r in self.rules(data_type) if all(n in columns for n in r.needs)], columns


DEFAULT_BOOK = RuleBook()


def violations(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> Column:
    """Array of violation structs in rule order."""
    rules, columns = book.applicable(df, data_type, aliases)
    if not rules:
        return F.array().cast(T.ArrayType(VIOLATION))
    candidates = [F.when(r.hits(columns), r.violation(columns)) for r in rules]
    return F.array_compact(F.array(*candidates))


def mixed_union(parts: Mapping[str, DataFrame], tag: str = "rule_set") -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """Record sets of several kinds as one, tagged by kind, and the columns each kind brings.

    The columns tell a field that a kind does not have from one that is NULL: rules apply to the former in no record.
    """
    out, columns = None, {}
    for name, df in parts.items():
        tagged, columns[name] = df.select(F.lit(name).alias(tag), "*"), tuple(df.columns)
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out, columns


def mixed_violations(df: DataFrame, columns: Mapping[str, tuple[str, ...]], kind: Column, book: RuleBook = DEFAULT_BOOK) -> Column:
    """Violations of every record under the rule set of its own kind, as one projection; unknown kinds have none."""
    out = F.array().cast(T.ArrayType(VIOLATION))
    for name, own in columns.items():
        out = F.when(kind == name, violations(df.select(*[F.col(f"`{c}`") for c in own]), name, book)).otherwise(out)
    return out


def mixed_violates(df: DataFrame, columns: Mapping[str, tuple[str, ...]], kind: Column, book: RuleBook = DEFAULT_BOOK) -> Column:
    """Quick check of a mixed set: has the record any violation under the rules of its kind?"""
    out = F.lit(False)
    for name, own in columns.items():
        out = F.when(kind == name, violates(df.select(*[F.col(f"`{c}`") for c in own]), name, book)).otherwise(out)
    return out


def violates(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> Column:
    """Quick check: is there any violation? Builds no structs and stops at the first hit."""
    rules, columns = book.applicable(df, data_type, aliases)
    return any_of([r.hits(columns) for r in rules])


def violation_count(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> Column:
    """Number of violations without building them."""
    rules, columns = book.applicable(df, data_type, aliases)
    total = F.lit(0)
    for rule in rules:
        total = total + rule.hits(columns).cast("int")
    return total


def detect(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> DataFrame:
    """Detailed check: records with `violations` and `compliant`."""
    found = df.select("*", violations(df, data_type, book, aliases).alias("violations"))
    return found.select("*", (F.size("violations") == 0).alias("compliant"))


def violation_rows(df: DataFrame, data_type: str, keys: list[str], book: RuleBook = DEFAULT_BOOK, aliases=None):
    """One row per violation with the record key in front."""
    return df.select(*keys, F.inline(violations(df, data_type, book, aliases)))


def max_severity(violation_array: Column) -> Column:
    """Highest severity of an array of violations, 'none' when it is empty."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    ranks = F.transform(violation_array, lambda v: F.array_position(names, v["severity"]))
    highest = F.coalesce(F.array_max(ranks), F.lit(0)).cast("int")
    return F.when(F.size(violation_array) == 0, F.lit("none")).otherwise(
        F.coalesce(F.try_element_at(names, F.when(highest > 0, highest)), F.lit("unknown"))
    )


def enrich(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> DataFrame:
    """Records with the compliance columns of the batch processor."""
    found = df.select("*", violations(df, data_type, book, aliases).alias("__v"))
    v = F.col("__v")
    return found.select(
        *df.columns,
        F.size(v).alias("compliance_violations"),
        F.to_json(v).alias("compliance_details"),
        (F.size(v) == 0).alias("is_compliant"),
        F.exists(v, lambda x: x["type"] == "phi_exposure").alias("has_phi_exposure"),
        F.exists(v, lambda x: x["type"] == "missing_consent").alias("has_consent_violation"),
        max_severity(v).alias("violation_severity"),
    )


def summarize(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> DataFrame:
    """Violations by severity, regulation and type, and in total, as rows (dimension, value, n).

    Every rule is one conditional count of a single aggregate; the constants of the rules are
    folded in afterwards on a handful of rows, so no violation is ever materialized.
    """
    rules, columns = book.applicable(df, data_type, aliases)
    if not rules:
        return df.sparkSession.createDataFrame([], "dimension string, value string, n bigint")
    counts = df.agg(*[F.count_if(r.hits(columns)).alias(f"n{i}") for i, r in enumerate(rules)])
    rows = []
    for i, rule in enumerate(rules):
        for dimension, value in (
            ("severity", rule.severity), ("regulation", rule.regulation), ("type", rule.type), ("total", "all"),
        ):
            rows.append(F.struct(F.lit(dimension).alias("dimension"), F.lit(value).alias("value"), F.col(f"n{i}").alias("n")))
    flat = counts.select(F.inline(F.array(*rows)))
    return flat.groupBy("dimension", "value").agg(F.sum("n").alias("n")).filter("n > 0 OR dimension = 'total'")


def breakdown(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> DataFrame:
    """Violations by (regulation, severity, type), same one-pass form as `summarize`."""
    rules, columns = book.applicable(df, data_type, aliases)
    counts = df.agg(*[F.count_if(r.hits(columns)).alias(f"n{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(r.regulation).alias("regulation"), F.lit(r.severity).alias("severity"),
            F.lit(r.type).alias("type"), F.col(f"n{i}").alias("n"),
        )
        for i, r in enumerate(rules)
    ]
    flat = counts.select(F.inline(F.array(*rows)))
    return flat.groupBy("regulation", "severity", "type").agg(F.sum("n").alias("n")).filter("n > 0")


def totals(df: DataFrame, data_type: str, book: RuleBook = DEFAULT_BOOK, aliases=None) -> DataFrame:
    """Records, violating records, violations and rate; the two counts are kept apart."""
    counted = df.select(violation_count(df, data_type, book, aliases).alias("v"))
    return counted.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("v") > 0).alias("violating_records"),
        F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("violations"),
        F.avg((F.col("v") > 0).cast("double")).alias("violation_rate"),
    )


# Fields that make a record personal data.
PII_FIELDS = (
    "ssn", "phone", "email", "patient_name", "medical_record_number", "insurance_id", "credit_card", "account_number",
)


def has_pii(df: DataFrame) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return any_of([present(F.col(c), types[c]) for c in PII_FIELDS if c in types])


def violation_types(violation_array: Column) -> Column:
    """Distinct violation types of a record in a fixed order; empty when it is compliant."""
    return F.array_sort(F.array_distinct(F.transform(violation_array, lambda v: v["type"])))


def stored_violation_types(violation_array: Column) -> Column:
    """Types as the record table keeps them: two named ones, else one generic type."""
    named = F.filter(
        F.array(F.lit("phi_exposure"), F.lit("missing_consent"), F.lit("gdpr_violation")),
        lambda t: F.array_contains(F.transform(violation_array, lambda v: v["type"]), t),
    )
    generic = F.array(F.lit("compliance_violation"))
    return (
        F.when(F.size(violation_array) == 0, F.array().cast("array<string>"))
        .when(F.size(named) == 0, generic)
        .otherwise(named)
    )


def score(count: Column) -> Column:
    """Per-record compliance score: 1 - violations / 5."""
    return F.lit(1.0) - count / F.lit(5.0)


def flag_dataset(df: DataFrame, data_type: str, checked_at: Column, book: RuleBook = DEFAULT_BOOK) -> DataFrame:
    """Whole-set columns: checked flag, time of the check, and the true per-record flag."""
    return df.select(
        "*",
        F.lit(True).alias("compliance_checked"),
        checked_at.alias("compliance_timestamp"),
        violates(df, data_type, book).alias("has_violations"),
    )


def violation_sample(df: DataFrame, data_type: str, key: str, n: int = 10, book: RuleBook = DEFAULT_BOOK) -> DataFrame:
    """First `n` violations by key and rule order, for a report header (top-k, no full sort)."""
    rows = violation_rows(df, data_type, [key], book)
    return rows.orderBy(key, "type", "field").limit(n)


# --------------------------------------------------------------------------------------
# Second rule catalogue: consent validity, retention by age, exposed identifiers.

# Fixed values of the catalogue: name, regulation, description.
CATALOGUE = (
    ("consent_validity", "GDPR", "Check if consent is valid and not expired"),
    ("data_retention", "GDPR", "Check if data retention period is exceeded"),
    ("data_minimization", "GDPR", "Check if excessive data is collected"),
    ("cross_border_transfer", "GDPR", "Check unauthorized cross-border data transfers"),
    ("phi_exposure", "HIPAA", "Check for exposed PHI identifiers"),
    ("minimum_necessary", "HIPAA", "Check minimum necessary rule compliance"),
    ("access_controls", "HIPAA", "Check proper access controls"),
)
# Declared rules without a check of their own; governance operators do that work.
DECLARED_ONLY = frozenset({"data_minimization", "cross_border_transfer", "minimum_necessary", "access_controls"})

CONSENT_VALID_DAYS = 730
DEFAULT_RETENTION_DAYS = 1095


def consent_validity(df: DataFrame, reference_time: Column) -> Column:
    """Detail text, or NULL when consent is given and not older than two years."""
    status = F.col("consent_status") if "consent_status" in df.columns else F.lit(False)
    given = F.coalesce(status, F.lit(False))
    expired = F.lit(False)
    if "consent_date" in df.columns:
        limit = F.timestamp_add("DAY", F.lit(-CONSENT_VALID_DAYS), reference_time)
        expired = F.coalesce(F.col("consent_date") < limit, F.lit(False))
    return F.when(~given, F.lit("Consent not provided or withdrawn")).when(
        expired, F.lit("Consent expired (>2 years old)")
    )


def retention_by_age(df: DataFrame, reference_time: Column) -> Column:
    """Detail text when a record is older than its retention period, else NULL."""
    starts = [F.col(c) for c in ("created_timestamp", "treatment_date") if c in df.columns]
    if not starts:
        return F.lit(None).cast("string")
    days = F.lit(DEFAULT_RETENTION_DAYS)
    if "data_retention_days" in df.columns:
        days = F.coalesce(F.col("data_retention_days"), days)
    over = reference_time > F.timestamp_add("DAY", days.cast("int"), F.coalesce(*starts))
    text = F.concat(F.lit("Data retention period exceeded ("), days.cast("string"), F.lit(" days)"))
    return F.when(F.coalesce(over, F.lit(False)), text)


def exposed_identifiers(df: DataFrame) -> Column:
    """Identifier fields whose value matches any of the three exposure patterns."""
    names = [c for c in ("ssn", "phone", "email", "medical_record_number") if c in df.columns]
    any_pattern = "|".join(f"(?:{p})" for p in (patterns.SSN, patterns.PHONE, patterns.EMAIL))
    hits = [F.when(F.col(c).rlike(any_pattern), F.lit(c)) for c in names]
    return F.filter(F.array(*hits), lambda n: n.isNotNull()) if hits else F.array().cast("array<string>")


def phi_cross_scan(df: DataFrame) -> Column:
    """Detail text listing the exposed fields, or NULL."""
    listed = F.nullif(F.array_join(exposed_identifiers(df), ", "), F.lit(""))
    return F.concat(F.lit("Exposed PHI fields: "), listed)


def evaluate(df: DataFrame, reference_time: Column, regulation: str = "both") -> DataFrame:
    """Records with `record_id`, `violations` and `compliant` under the second catalogue."""
    names = df.columns
    # Details stand in a projection of their own: each is computed once, and the time, which
    # may be a scalar subquery, stays out of higher-order functions.
    details = {
        "consent_validity": consent_validity(df, reference_time),
        "data_retention": retention_by_age(df, reference_time),
        "phi_exposure": phi_cross_scan(df),
    }
    df = df.select("*", *[v.alias(f"__{n}") for n, v in details.items()])
    wanted = {"gdpr": ("GDPR",), "hipaa": ("HIPAA",), "both": ("GDPR", "HIPAA")}[regulation]
    found = []
    for name, law, text in CATALOGUE:
        if law in wanted and name not in DECLARED_ONLY:
            entry = F.struct(
                F.lit(name).alias("rule"), F.lit(law).alias("regulation"),
                F.lit(text).alias("description"), F.col(f"__{name}").alias("violation_details"),
            )
            found.append(entry)
    listed = F.filter(F.array(*found), lambda v: v["violation_details"].isNotNull())
    ids = [F.col(c) for c in ("patient_id", "customer_id") if c in df.columns]
    record_id = F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in ids]) if ids else F.lit(None)
    checked = df.select(
        *names, record_id.alias("record_id"), listed.alias("violations")
    )
    return checked.select("*", (F.size("violations") == 0).alias("compliant"))
