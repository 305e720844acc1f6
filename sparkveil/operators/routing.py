"""Routing as one CASE chain per rule table.

A rule is a condition in SQL over the columns of a record, written by the user of the library, with the columns it
reads in braces and their declared types beside it: `{amount} > 10000` with `amount double`. Inputs are read by
`try_cast`. Rules are tried in priority order and the first hit wins; a rule whose columns are absent does not hit,
nor does one whose inputs are NULL. A rule with an input that is given but cannot be read as declared is in error:
if no rule before it hits, the record takes the fallback route with the reason `rule_error`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkveil.functions.hashing import hash_mod
from sparkveil.functions.values import present
from sparkveil.plans.joins import with_group_stats

STREAM, BATCH = "stream", "batch"


def size_estimate(df: DataFrame) -> Column:
    """Length of the record as JSON text, NULL fields included."""
    return F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def complexity(df: DataFrame) -> Column:
    """0.1 per field, 0.2 per text longer than 50, 0.3 per field named after a date or time."""
    names = [c.lower() for c in df.columns]
    # Counted in tenths, so that the comparison with 1.0 is exact.
    tenths = F.lit(len(names) + 3 * sum("date" in n or "time" in n for n in names))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            tenths = tenths + F.when(F.length(F.col(f"`{f.name}`")) > 50, 2).otherwise(0)
    return tenths / F.lit(10.0)


def characteristics(df: DataFrame, violation_array: Column) -> Column:
    return F.struct(
        size_estimate(df).alias("size_estimate"),
        (F.size(violation_array) > 0).alias("has_violations"),
        complexity(df).alias("complexity_score"),
        F.length(F.to_json(violation_array)).alias("violation_text"),
    )


def tree_decision(df: DataFrame, traits: Column) -> Column:
    """The fixed decision tree: struct(route, reason), first match wins."""
    chain = F.when(traits["complexity_score"] > 1.0, _to(BATCH, "high_complexity"))
    if "account_number" in df.columns or "transaction_amount" in df.columns:
        chain = chain.when(F.lit(True), _to(BATCH, "financial_data"))
    return (
        chain.when(traits["size_estimate"] > 1000, _to(BATCH, "large_record"))
        .when(traits["has_violations"] & (traits["violation_text"] > 200), _to(STREAM, "urgent_violation"))
        .otherwise(_to(STREAM, "realtime_processing"))
    )


def _to(route: str, reason: str) -> Column:
    return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))


def decide_by_tree(df: DataFrame, violation_array: Column, key: str) -> DataFrame:
    """Records with `decision` (record id, route, reason, characteristics)."""
    traits = df.select("*", characteristics(df, violation_array).alias("__traits"))
    choice = traits.select("*", tree_decision(df, F.col("__traits")).alias("__choice"))
    return choice.select(
        *df.columns,
        F.struct(
            F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("record_id"),
            F.col("__choice.route").alias("route"), F.col("__choice.reason").alias("reason"),
            F.col("__traits").alias("characteristics"),
        ).alias("decision"),
    )


@dataclass(frozen=True)
class RouteRule:
    """`inputs` are the columns in braces in the condition, with the types they are read as ("a double, b string")."""

    id: str
    condition: str
    route: str
    priority: int
    needs: tuple[str, ...] = ()
    regulation: str | None = None
    enabled: bool = True
    inputs: str = ""

    @property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in T.StructType.fromDDL(self.inputs).fields} if self.inputs else {}

    def applies(self, df: DataFrame) -> bool:
        """Whether the rule is switched on and all its columns are there."""
        return self.enabled and all(c in df.columns for c in (*self.needs, *self.types))

    def hits(self, df: DataFrame) -> Column:
        """Whether the condition holds for the inputs as they can be read; never NULL, never an error of a cast."""
        types = self.types
        if not types:
            return F.expr(f"coalesce({self.condition}, false)")
        read = {c: f"try_cast({_as_text(df, c, k)} AS {k.simpleString()})" for c, k in types.items()}
        return F.expr(f"coalesce({self.condition.format(**read)}, false)")

    def misread(self, df: DataFrame) -> dict[str, Column]:
        """Per input that may fail: whether its value is given but not of the declared type."""
        given = {f.name: f.dataType for f in df.schema.fields}
        return {
            c: F.expr(f"{_as_text(df, c, k)} IS NOT NULL AND try_cast({_as_text(df, c, k)} AS {k.simpleString()}) IS NULL")
            for c, k in self.types.items() if given[c] != k and not isinstance(k, T.StringType)
        }


def _as_text(df: DataFrame, column: str, kind: T.DataType) -> str:
    """SQL of a column on its way to a type: as it is where Spark casts between the two, else as text; '' is not given."""
    have = df.schema[column].dataType
    if have == kind or isinstance(have, T.NumericType) and isinstance(kind, T.NumericType):
        return f"`{column}`"
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(have, times) and isinstance(kind, times):
        return f"`{column}`"
    return f"nullif(trim(CAST(`{column}` AS STRING)), '')"


# Thresholds of the rule tables.
HIGH_VALUE = 10000
QUEUE_LIMIT = 1000
LARGE_TEXT = 500
HIGH_RISK = 0.8
URGENT_PRIORITIES = ("urgent", "emergency", "critical")

_PRIORITY_LIST = ", ".join(f"'{p}'" for p in URGENT_PRIORITIES)
_EMERGENCY_FLAG = "lower(cast(emergency_flag as string)) = 'true'"
_EMERGENCY_PRIORITY = f"lower(priority) in ({_PRIORITY_LIST})"


def _incomplete(required: Iterable[str], schema: T.StructType) -> str:
    """A required field counts as missing when absent, NULL, '', zero or false."""
    types = {f.name: f.dataType for f in schema.fields}
    tests = []
    for c in required:
        if c not in types:
            tests.append("true")
        elif isinstance(types[c], T.StringType):
            tests.append(f"coalesce(`{c}`, '') = ''")
        elif isinstance(types[c], T.NumericType):
            tests.append(f"coalesce(`{c}`, 0) = 0")
        elif isinstance(types[c], T.BooleanType):
            tests.append(f"not coalesce(`{c}`, false)")
        else:
            tests.append(f"`{c}` is null")
    return " or ".join(tests) or "false"


def emergency(available: Iterable[str]) -> str:
    parts = [sql for column, sql in (("emergency_flag", _EMERGENCY_FLAG), ("priority", _EMERGENCY_PRIORITY)) if column in available]
    return " or ".join(f"coalesce({p}, false)" for p in parts) or "false"


def record_text(columns: Iterable[str]) -> str:
    """SQL of the record as text, for size rules."""
    return "length(to_json(struct(" + ", ".join(f"`{c}`" for c in columns) + "), map('ignoreNullFields', 'false')))"


def operational_rules(
    schema: T.StructType, required: tuple[str, ...] = (), queue_size: int = 0, enabled: Iterable[str] | None = None
) -> list[RouteRule]:
    """The operational rule table for a record set, queue size and required fields as parameters."""
    columns = schema.names
    rules = [
        RouteRule("urgent_deadline", "{days_to_deadline} < 1", STREAM, 1, inputs="days_to_deadline double"),
        RouteRule("high_risk_healthcare", f"{{type}} = 'healthcare' and {{risk_score}} > {HIGH_RISK}", STREAM, 2, inputs="type string, risk_score double"),
        RouteRule("high_value_transaction", f"{{type}} = 'financial' and {{amount}} > {HIGH_VALUE}", STREAM, 3, inputs="type string, amount double"),
        RouteRule("emergency_flag", emergency(columns), STREAM, 4),
        RouteRule("batch_queue_overload", "true" if queue_size > QUEUE_LIMIT else "false", STREAM, 5),
        RouteRule("incomplete_data", _incomplete(required, schema), BATCH, 6),
        RouteRule("large_record_size", f"{record_text(columns)} > {LARGE_TEXT}", BATCH, 7),
        RouteRule("default", "true", BATCH, 999),
    ]
    return [r if enabled is None or r.id in enabled else replace(r, enabled=False) for r in rules]


def adaptive_rules(
    schema: T.StructType, data_type: str, reference_time: str, required: tuple[str, ...], queue_size: int = 0
) -> list[RouteRule]:
    """The adaptive router's rules for one data type; time, queue and required fields are parameters."""
    columns = schema.names
    amount = "amount" if "amount" in columns else "transaction_amount"
    rules = [
        RouteRule(
            "compliance_deadline_urgent",
            f"timestampdiff(SECOND, timestamp_ntz '{reference_time}', {{compliance_deadline}}) < 86400",
            STREAM, 1, inputs="compliance_deadline timestamp_ntz",
        )
    ]
    if data_type == "financial":
        rules.append(RouteRule("high_value_transaction", f"{{{amount}}} > {HIGH_VALUE}", STREAM, 2, inputs=f"{amount} double"))
    if data_type == "healthcare":
        rules.append(RouteRule("healthcare_emergency", emergency(columns), STREAM, 3))
    rules += [
        RouteRule("batch_queue_overload", "true" if queue_size > QUEUE_LIMIT else "false", STREAM, 4),
        RouteRule("incomplete_data", _incomplete(required, schema), BATCH, 5),
        RouteRule("large_record_size", f"{record_text(columns)} > {LARGE_TEXT}", BATCH, 6),
        RouteRule("default_batch_routing", "true", BATCH, 7),
    ]
    return rules


# Special categories of personal data and the member states.
SPECIAL_CATEGORIES = ("health", "genetic", "biometric", "political", "religious", "racial", "sexual", "trade_union")
EU_COUNTRIES = (
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "EL", "HU", "IE", "IT", "LV", "LT", "LU",
    "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE",
)


def regulatory_rules(reference_time: str, gdpr: bool = True, hipaa: bool = True) -> list[RouteRule]:
    """The regulatory layer, tried before the operational one; each law can be switched off."""
    special = ", ".join(f"'{c}'" for c in SPECIAL_CATEGORIES)
    countries = ", ".join(f"'{c}'" for c in EU_COUNTRIES)
    now = f"timestamp_ntz '{reference_time}'"
    rules = [
        RouteRule("G1", f"coalesce({{legal_basis}}, '') = '' and ({{data_subject_country}} like 'EU%' or {{data_subject_country}} in ({countries}))",
                  STREAM, 1, regulation="GDPR", inputs="legal_basis string, data_subject_country string"),
        RouteRule("G2", f"{{category}} in ({special})", STREAM, 2, regulation="GDPR", inputs="category string"),
        RouteRule("G3", f"{{consent_expiry}} < {now}", BATCH, 3, regulation="GDPR", inputs="consent_expiry timestamp_ntz"),
        RouteRule("G4", f"{{retention_date}} < {now} + interval 7 days", BATCH, 4, regulation="GDPR", inputs="retention_date timestamp_ntz"),
        RouteRule("H1", "{contains_phi} and coalesce({encryption}, 'none') = 'none'", STREAM, 5, regulation="HIPAA", inputs="contains_phi boolean, encryption string"),
        RouteRule("H2", "{audit_required}", STREAM, 6, regulation="HIPAA", inputs="audit_required boolean"),
        RouteRule("H3", "{breach_suspected}", STREAM, 7, regulation="HIPAA", inputs="breach_suspected boolean"),
    ]
    wanted = {"GDPR": gdpr, "HIPAA": hipaa}
    return [replace(r, enabled=wanted[r.regulation]) for r in rules]


def decide(df: DataFrame, *layers: list[RouteRule], fallback: str = STREAM, errors: Column | None = None) -> Column:
    """struct(route, reason) of the first rule that hits over all layers in order.

    Before a rule is tried its inputs are: where one is given but not of the declared type, the record takes the
    fallback route, unless an earlier rule has hit. When no rule hits, the fallback route is taken as well.
    `errors` marks records that the caller knows to be unreadable; they take it before any rule.
    """
    steps = [] if errors is None else [(F.coalesce(errors, F.lit(False)), _to(fallback, "rule_error"))]
    for rule in _in_order(df, layers):
        failed = list(rule.misread(df).values())
        if failed:
            steps.append((_any(failed), _to(fallback, "rule_error")))
        steps.append((rule.hits(df), _to(rule.route, rule.id)))
    chain = None
    for test, outcome in steps:
        chain = F.when(test, outcome) if chain is None else chain.when(test, outcome)
    return _to(fallback, "fallback") if chain is None else chain.otherwise(_to(fallback, "fallback"))


def _in_order(df: DataFrame, layers: Iterable[list[RouteRule]]) -> list[RouteRule]:
    return [rule for layer in layers for rule in sorted(layer, key=lambda r: r.priority) if rule.applies(df)]


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def rule_errors(df: DataFrame, *layers: list[RouteRule]) -> Column:
    """Array of (rule, column, value) for every input of a rule that is given but cannot be read as declared."""
    entries = [
        F.when(failed, F.struct(F.lit(rule.id).alias("rule"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")))
        for rule in _in_order(df, layers) for c, failed in rule.misread(df).items()
    ]
    kind = "array<struct<rule: string, column: string, value: string>>"
    return F.filter(F.array(*entries).cast(kind), lambda x: x.isNotNull())


def severity_route(severity: Column, complexity_score: Column) -> Column:
    """Documented variant: critical first, then complexity of 4 and more."""
    return (
        F.when(severity == "critical", _to(STREAM, "critical_urgency"))
        .when(complexity_score >= 4, _to(BATCH, "high_complexity"))
        .otherwise(_to(STREAM, "default"))
    )


def violation_route(has_violations: Column, complexity_score: Column) -> Column:
    """Documented variant: any violation first, then complexity above 1."""
    return (
        F.when(has_violations, _to(STREAM, "violation"))
        .when(complexity_score > 1.0, _to(BATCH, "high_complexity"))
        .otherwise(_to(STREAM, "default"))
    )


def sensitivity_route(df: DataFrame, sensitive: list[str], threshold: int) -> Column:
    """Documented strategy: records with many filled sensitive fields go to batch."""
    types = {f.name: f.dataType for f in df.schema.fields}
    filled = F.lit(0)
    for c in sensitive:
        if c in types:
            filled = filled + present(F.col(c), types[c]).cast("int")
    return F.when(filled >= threshold, _to(BATCH, "sensitive")).otherwise(_to(STREAM, "not_sensitive"))


def volume_route(df: DataFrame, source: str, threshold: int) -> DataFrame:
    """Documented strategy: sources with more than `threshold` records go to batch."""
    counted = with_group_stats(df, [source], __volume=F.count("*"))
    return counted.select(
        *df.columns,
        F.when(F.col("__volume") > threshold, _to(BATCH, "high_volume")).otherwise(_to(STREAM, "low_volume")).alias("decision"),
    )


def learned_route(df: DataFrame, features: list[str], label: str, max_iterations: int = 20):
    """Documented strategy: a logistic regression trained on past decisions (label 1 = batch).

    Records with a missing or unreadable feature are not trained on. They are scored with the others: every
    feature counts as 0 there, so each record of the input has a prediction.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    read = [f"coalesce(nanvl(try_cast(`{c}` AS DOUBLE), NULL), 0D) AS __in_{i}" for i, c in enumerate(features)]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(read)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__in_{i}" for i in range(len(features))], outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol=label, maxIter=max_iterations, standardization=True),
    ]
    whole = " AND ".join(f"NOT isnan(try_cast(`{c}` AS DOUBLE)) AND try_cast(`{c}` AS DOUBLE) IS NOT NULL" for c in features)
    return Pipeline(stages=stages).fit(df.where(whole).where(F.col(label).isNotNull()))


def statistics(decided: DataFrame, route: str = "decision.route", reason: str = "decision.reason") -> DataFrame:
    """Records per route and reason with their share of all records."""
    counts = decided.groupBy(F.col(route).alias("route"), F.col(reason).alias("reason")).agg(F.count("*").alias("records"))
    # One row per route and reason reaches this window; the records are read once.
    total = F.sum("records").over(Window.partitionBy())
    return counts.select("route", "reason", "records", (F.col("records") * 100.0 / total).alias("percent"))


def rule_hits(df: DataFrame, rules: list[RouteRule]) -> DataFrame:
    """How often each rule would hit on its own, in one aggregate."""
    usable = [r for r in rules if r.applies(df)]
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(r.hits(df)).alias(f"n{i}") for i, r in enumerate(usable)],
    )
    rows = [
        F.struct(F.lit(r.id).alias("rule"), F.col(f"n{i}").alias("hits"), (F.col(f"n{i}") / F.col("total")).alias("hit_rate"))
        for i, r in enumerate(usable)
    ]
    return counts.select(F.inline(F.array(*rows)))


def sla_share(df: DataFrame, urgent: Column, latency_seconds: Column, limit: float = 2.0) -> DataFrame:
    """Share of urgent records handled within the limit."""
    within = F.count_if(urgent & (latency_seconds <= limit))
    return df.agg(
        F.count_if(urgent).alias("urgent"), within.alias("within_limit"),
        F.try_divide(within, F.count_if(urgent)).alias("sla_share"),
    )


def with_routing_fields(df: DataFrame, key: str, data_type: str, base_time: str, seed: str = "42") -> DataFrame:
    """Reproducible routing inputs: 20 % urgent deadlines and, for healthcare, 10 % emergencies."""
    draw = hash_mod(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")), 1000)
    base = F.lit(base_time).cast("timestamp_ntz")
    staged = df.select("*", draw.alias("__d"))
    d = F.col("__d")
    urgent = F.timestamp_add("HOUR", (d % 23 + 1).cast("int"), base)
    later = F.timestamp_add("DAY", (d % 28 + 2).cast("int"), base)
    added = [F.when(d % 100 < 20, urgent).otherwise(later).alias("compliance_deadline")]
    if data_type == "healthcare":
        alarm = d % 100 < 10
        added += [F.when(alarm, F.lit("true")).alias("emergency_flag"), F.when(alarm, F.lit("urgent")).alias("priority")]
    return staged.select(*df.columns, *added)
