"""Declared schemas, their sensitive fields, and schema detection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "date": T.DateType(),
}
_PANDAS = {
    "string": "object", "int": "int64", "double": "float64", "boolean": "bool",
    "timestamp": "datetime64[ns]", "date": "datetime64[ns]",
}
_JSON = {"string": "string", "int": "integer", "double": "number", "boolean": "boolean"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = True
    rules: tuple[str, ...] = ()
    sensitive: bool = False
    description: str = ""


@dataclass(frozen=True)
class Schema:
    name: str
    data_type: str
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def sensitive(self) -> list[str]:
        return [f.name for f in self.fields if f.sensitive]

    def spark(self) -> T.StructType:
        """Spark schema; sensitivity and rule tags travel as field metadata."""
        return T.StructType([
            T.StructField(
                f.name, _TYPES.get(f.type, T.StringType()), f.nullable,
                {"sensitive": f.sensitive, "rules": list(f.rules)},
            )
            for f in self.fields
        ])

    def pandas(self) -> dict[str, str]:
        return {f.name: _PANDAS.get(f.type, "object") for f in self.fields}

    def json(self) -> dict:
        return {
            "type": "object",
            "properties": {f.name: {"type": _JSON.get(f.type, "string"), "description": f.description} for f in self.fields},
            "required": [f.name for f in self.fields if not f.nullable],
        }


# Names, types, order, sensitivity and rule tags of the declared record schemas.
HEALTHCARE = Schema("healthcare_v1", "healthcare", (
    Field("id", nullable=False, description="Key of the record"),
    Field("patient_name", rules=("HIPAA_PHI",), sensitive=True, description="Full name of the patient"),
    Field("ssn", rules=("HIPAA_PHI",), sensitive=True, description="Social security number"),
    Field("phone", rules=("HIPAA_PHI",), sensitive=True, description="Phone number"),
    Field("email", rules=("HIPAA_PHI",), sensitive=True, description="Mail address"),
    Field("diagnosis", rules=("HIPAA_PHI",), sensitive=True, description="What the patient is treated for"),
    Field("treatment_date", "timestamp", description="When the treatment took place"),
    Field("has_violation", "boolean", description="Whether a check has found a violation"),
    Field("violation_type", description="Kind of the violation found"),
    Field("timestamp", "timestamp", description="When the record was taken in"),
    Field("medical_record_number", rules=("HIPAA_PHI",), sensitive=True, description="Number of the patient's file"),
    Field("doctor_name", rules=("HIPAA_PHI",), sensitive=True, description="Full name of the treating doctor"),
    Field("insurance_id", rules=("HIPAA_PHI",), sensitive=True, description="Number of the insurance policy"),
))
FINANCIAL = Schema("financial_v1", "financial", (
    Field("id", nullable=False, description="Key of the record"),
    Field("customer_name", rules=("GDPR_PII",), sensitive=True, description="Full name of the customer"),
    Field("account_number", rules=("GDPR_PII",), sensitive=True, description="Number of the account"),
    Field("transaction_amount", "double", description="Amount moved, in the account's currency"),
    Field("transaction_date", "timestamp", description="When the transaction took place"),
    Field("location", description="Place the record belongs to"),
    Field("consent_given", "boolean", rules=("GDPR_CONSENT",), description="Whether consent to processing is on file"),
    Field("has_violation", "boolean", description="Whether a check has found a violation"),
    Field("violation_type", description="Kind of the violation found"),
    Field("timestamp", "timestamp", description="When the record was taken in"),
    Field("customer_id", rules=("GDPR_PII",), sensitive=True, description="Key of the customer"),
    Field("credit_score", "int", rules=("GDPR_PII",), sensitive=True, description="Credit score of the customer"),
    Field("data_retention_days", "int", description="Days the record may be kept"),
))
CUSTOMER = Schema("customer_v1", "customer", (
    Field("id", nullable=False, description="Key of the record"),
    Field("name", rules=("PII",), sensitive=True, description="Full name"),
    Field("email", rules=("PII",), sensitive=True, description="Mail address"),
    Field("phone", rules=("PII",), sensitive=True, description="Phone number"),
    Field("address", rules=("PII",), sensitive=True, description="Postal address"),
    Field("date_of_birth", "date", rules=("PII",), sensitive=True, description="Day of birth"),
    Field("created_at", "timestamp", description="When the record was made"),
    Field("updated_at", "timestamp", description="When the record was last changed"),
))
ECOMMERCE = Schema("ecommerce_v1", "customer", (
    Field("order_id", nullable=False, description="Key of the order"),
    Field("customer_email", rules=("PII", "GDPR_PII",), sensitive=True, description="Mail address of the customer"),
    Field("customer_name", rules=("PII",), sensitive=True, description="Full name of the customer"),
    Field("credit_card", rules=("PCI_DSS",), sensitive=True, description="Number of the card paid with"),
    Field("billing_address", rules=("PII",), sensitive=True, description="Address the invoice goes to"),
    Field("product_name", description="What was bought"),
    Field("order_amount", "double", description="Price of the order"),
    Field("order_date", "timestamp", description="When the order was placed"),
    Field("shipping_address", rules=("PII",), sensitive=True, description="Address the goods go to"),
    Field("consent_marketing", "boolean", rules=("GDPR_CONSENT",), description="Whether consent to advertising is on file"),
    Field("timestamp", "timestamp", description="When the record was taken in"),
))
IOT = Schema("iot_sensors_v1", "generic", (
    Field("device_id", nullable=False, description="Key of the device"),
    Field("sensor_type", description="Kind of the sensor"),
    Field("location_lat", "double", rules=("LOCATION_PII",), sensitive=True, description="Latitude of the device in degrees"),
    Field("location_lng", "double", rules=("LOCATION_PII",), sensitive=True, description="Longitude of the device in degrees"),
    Field("temperature", "double", description="Temperature measured"),
    Field("humidity", "double", description="Relative humidity measured"),
    Field("user_id", rules=("PII",), sensitive=True, description="Key of the device's owner"),
    Field("reading_timestamp", "timestamp", description="When the value was measured"),
    Field("data_retention_days", "int", description="Days the record may be kept"),
))

# Columns that hint at a schema, with the score a candidate must exceed.
SIGNATURES = {
    "healthcare": (("patient_name", "diagnosis", "treatment_date"), ("ssn", "medical_record_number", "doctor_name"), 0.6),
    "financial": (("transaction_amount", "transaction_date", "account_number"), ("customer_name", "consent_given", "credit_score"), 0.6),
    "customer": (("name", "email"), ("phone", "address", "date_of_birth"), 0.5),
}
REQUIRED_WEIGHT, OPTIONAL_WEIGHT = 0.8, 0.2

# Words in a path that name a schema, tried in this order.
PATH_WORDS = {
    "healthcare": ("healthcare", "medical", "patient", "hipaa"),
    "financial": ("financial", "transaction", "payment", "gdpr"),
    "customer": ("customer", "client", "user"),
}

# Roles a column plays under another name, per generated record set.
ALIASES = {
    "research_ecommerce": {"credit_card": "credit_card_number"},
    "ecommerce": {"consent_given": "consent_marketing"},
    "ecommerce_sample": {"consent_given": "privacy_consent"},
    "iot_sample": {"consent_given": "consent_for_tracking"},
}


@dataclass
class Registry:
    schemas: dict[str, Schema] = field(default_factory=lambda: {
        "healthcare": HEALTHCARE, "financial": FINANCIAL, "ecommerce": ECOMMERCE, "iot": IOT, "customer": CUSTOMER,
    })

    def register(self, schema: Schema, name: str | None = None) -> None:
        self.schemas[name or schema.data_type] = schema

    def get(self, name: str | None) -> Schema | None:
        return self.schemas.get(name) if name else None

    def list(self) -> list[str]:
        return list(self.schemas)


REGISTRY = Registry()


def signature_score(columns, name: str) -> float:
    required, optional, _ = SIGNATURES[name]
    have = set(columns)
    return REQUIRED_WEIGHT * len(have & set(required)) / len(required) + OPTIONAL_WEIGHT * len(have & set(optional)) / len(optional)


def detect(columns) -> str | None:
    """Schema whose signature scores best above its threshold; the first one on a tie."""
    scores = [(signature_score(columns, n), n) for n in SIGNATURES]
    over = [(s, n) for s, n in scores if s > SIGNATURES[n][2]]
    return max(over, key=lambda pair: pair[0])[1] if over else None


def from_path(path: str) -> str | None:
    lowered = path.lower()
    return next((name for name, words in PATH_WORDS.items() if any(w in lowered for w in words)), None)


def choose(path: str, columns=None) -> str | None:
    """By path first, then by columns."""
    return from_path(path) or (detect(columns) if columns is not None else None)


def path_schema(path: Column) -> Column:
    """Schema name from a path column, for mixed folders read in one scan."""
    chain = None
    for name, words in PATH_WORDS.items():
        test = F.lower(path).rlike("|".join(words))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def data_type(columns) -> str:
    """Data type by the first marker column found, healthcare when there is none."""
    for marker, kind in (("patient_name", "healthcare"), ("account_number", "financial"), ("credit_card", "ecommerce"), ("sensor_type", "iot")):
        if marker in columns:
            return kind
    return "healthcare"


def rule_set(columns) -> str:
    """Rule set the processors use: healthcare with a patient name, else financial."""
    return "healthcare" if "patient_name" in columns else "financial"


def detect_in_catalogue(columns: DataFrame, table: str = "table_name", column: str = "column_name") -> DataFrame:
    """Detect the schema of every table of a catalogue (one row per table and column) in one job.

    The signatures are joined as a table of 17 rows; scores are counts per table and schema.
    """
    rows = ", ".join(
        f"('{name}', {rank}, '{c}', {weight / len(group)!r}, {limit!r})"
        for rank, (name, (required, optional, limit)) in enumerate(SIGNATURES.items())
        for group, weight in ((required, REQUIRED_WEIGHT), (optional, OPTIONAL_WEIGHT))
        for c in group
    )
    signatures = columns.sparkSession.sql(
        f"SELECT schema_name, rank, hint, cast(points as double) points, cast(threshold as double) threshold FROM VALUES {rows} AS t(schema_name, rank, hint, points, threshold)"
    )
    hits = columns.select(table, F.col(column).alias("hint")).distinct().join(F.broadcast(signatures), "hint")
    scores = hits.groupBy(table, "schema_name", "rank", "threshold").agg(F.sum("points").alias("score"))
    over = scores.filter(F.round("score", 9) > F.col("threshold"))
    best = F.max_by(F.struct("schema_name", "score"), F.struct(F.round("score", 9).alias("s"), (-F.col("rank")).alias("r")))
    found = over.groupBy(table).agg(best.alias("b"))
    tables = columns.select(table).distinct()
    return tables.join(found, table, "left").select(
        table, F.col("b.schema_name").alias("schema_name"), F.round("b.score", 6).alias("score")
    )
