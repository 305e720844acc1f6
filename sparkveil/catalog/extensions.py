"""What users add themselves: rules, schemas, methods and functions of records, each run over a whole record set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparkveil import schemas as sc
from sparkveil.catalog.registry import query
from sparkveil.config import Anonymization
from sparkveil.operators import anonymize as an, compliance as co, flow
from sparkveil.sources import files
from sparkveil.views import view

LARGE_ORDER = co.Rule(
    name="large_order", type="excessive_collection", field="order_amount", severity="low", regulation="GDPR", needs=("order_amount", "consent_given"),
    predicate=lambda c: (c["order_amount"] > 50000) & ~c["consent_given"],
    description=lambda c: F.concat(F.lit("Order of part "), c["part_id"].cast("string"), F.lit(" without consent")),
)


@query("ua_custom_rule", ("v_ecom",), """
SELECT order_id, type, field, severity, description FROM (
  SELECT order_id, 'excessive_collection' AS type, 'order_amount' AS field, 'low' AS severity, 'Order of part ' || part_id || ' without consent' AS description FROM v_ecom WHERE order_amount > 50000 AND NOT consent_given
  UNION ALL SELECT order_id, 'data_retention', 'data_retention_days', 'medium', 'Data retained for ' || data_retention_days || ' days, exceeds limit of 700' FROM v_ecom WHERE data_retention_days > 700) x""")
def custom_rule(spark, sf_dir):
    """A book of one's own: a further rule and another retention limit; the violations of both, next to those of the set's other rules."""
    book = co.RuleBook(retention_days=700).register(LARGE_ORDER, "ecommerce")
    rows = co.violation_rows(view(spark, sf_dir, "v_ecom"), "ecommerce", ["order_id"], book)
    return rows.where(F.col("type").isin("excessive_collection", "data_retention")).select("order_id", "type", "field", "severity", "description")


READING = sc.Schema("reading_v1", "reading", (
    sc.Field("reading_id", "int", nullable=False, description="Key of the reading"),
    sc.Field("device_id", rules=("GDPR_PII",), sensitive=True, description="Device it came from"),
    sc.Field("reading_value", "double", description="Value read"),
    sc.Field("consent_given", "boolean", rules=("GDPR_CONSENT",), description="Whether consent is on file"),
))


@query("ub_registered_schema", ("v_iot",), """
SELECT reading_id, CASE WHEN reading_id % 19 <> 0 THEN device_id END AS device_id, CASE WHEN reading_id % 23 <> 0 THEN round(reading_value, 6) END AS reading_value, consent_given,
  CASE WHEN reading_id % 23 = 0 THEN 'reading_value: not a double' ELSE '' END AS rejected FROM v_iot""")
def registered_schema(spark, sf_dir):
    """Readings as texts, some unreadable or empty, read by a schema that the user registered."""
    registry = sc.Registry()
    registry.register(READING)
    key = F.col("reading_id")
    texts = view(spark, sf_dir, "v_iot").select(
        key.cast("string").alias("reading_id"), F.when(key % 19 == 0, "").otherwise(F.col("device_id")).alias("device_id"),
        F.when(key % 23 == 0, "high").otherwise(F.col("reading_value").cast("string")).alias("reading_value"), F.col("consent_given").cast("string").alias("consent_given"),
    )
    read = files.conform(texts, registry.get("reading"), rejects="rejects")
    problems = F.array_join(F.transform("rejects", lambda r: F.concat_ws(": ", r["column"], r["reason"])), ",")
    return read.select(F.col("reading_id").cast("bigint").alias("reading_id"), "device_id", F.round("reading_value", 6).alias("reading_value"), "consent_given", problems.alias("rejected"))


@query("ud_map_records", ("v_fin",), """
SELECT id, CAST(list_sum(list_transform(regexp_extract_all(account_number, '[0-9]'), lambda d: CAST(d AS INT))) % 10 AS BIGINT) AS check_digit FROM v_fin""")
def map_records(spark, sf_dir):
    """A rule of the user as a function of Arrow batches: the digit that the account number's digits sum to."""

    def check_digit(batch: pd.DataFrame) -> pd.DataFrame:
        sums = [sum(map(int, filter(str.isdecimal, number))) % 10 for number in batch["account_number"]]
        return pd.DataFrame({"id": batch["id"], "check_digit": sums})

    return flow.map_records(view(spark, sf_dir, "v_fin").select("id", "account_number"), check_digit, "id string, check_digit bigint")


def _initials(schema, settings):
    """First letters of the names and the years of the dates that a record set has."""
    names = {f: F.concat(F.substring(f, 1, 1), F.lit(".")) for f in ("patient_name", "doctor_name") if f in schema.names}
    return names | {"diagnosis": F.sha2(F.concat_ws(":", F.lit(settings.label), F.col("diagnosis")), 256)}


@query("ue_custom_method", ("v_pat",), """
SELECT id, substr(patient_name, 1, 1) || '.' AS patient_name, CASE WHEN diagnosis IS NULL THEN sha256('initials') ELSE sha256('initials:' || diagnosis) END AS diagnosis, email FROM v_pat""")
def custom_method(spark, sf_dir):
    an.register_method("initials", _initials)
    out = an.anonymize(view(spark, sf_dir, "v_pat"), Anonymization("initials"))
    return out.select("id", "patient_name", "diagnosis", "email")
