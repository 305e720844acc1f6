"""Ladders, noise, tokens, and their provenance."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkveil.catalog.core import TEST_SECRET, _COUNT_FIN
from sparkveil.catalog.registry import query
from sparkveil.config import differential_privacy, grid, k_anonymity, tokenization
from sparkveil.operators import anonymize as an, compliance as co
from sparkveil.plans.numbering import batch_numbers, row_numbers
from sparkveil.views import view

TEST_SEED = "test-seed"

# ------------------------------------------------------------------------------ ladders


def _keep(c: str, changed: str) -> str:
    return f"CASE WHEN {c} <> '' THEN {changed} ELSE {c} END"


def k_sql(k: int) -> dict[str, str]:
    t = 0 if k <= 3 else 1 if k <= 10 else 2
    w = (10, 20, 30)[t]
    low = f"CAST(floor(age / {w}.0) * {w} AS INT)"
    return {
        "age": f"CASE WHEN age <> 0 THEN CAST({low} AS STRING) || '-' || CAST({low} + {w - 1} AS STRING) ELSE CAST(age AS STRING) END",
        "ssn": _keep("ssn", ("substr(ssn, 1, 5) || '****'", "substr(ssn, 1, 3) || '******'", "'***-**-****'")[t]),
        "phone": _keep("phone", ("substr(phone, 1, 6) || '****'", "substr(phone, 1, 3) || '*******'", "'***-***-****'")[t]),
        "diagnosis": _keep("diagnosis", """CASE WHEN lower(diagnosis) IN ('diabetes', 'hypertension') THEN 'chronic_condition'
            WHEN lower(diagnosis) IN ('flu', 'cold') THEN 'respiratory_infection' ELSE 'other_condition' END"""
            if t == 0 else "'medical_condition'"),
        "location": _keep("location", "split_part(location, ',', 1)" if t == 0 else "'Region_Generalized'"),
    }


_PAT_REST = ("patient_name", "email", "medical_record_number", "gender")


def _select_sql(changed: dict[str, str], plain: tuple[str, ...], source: str, extra: str = "") -> str:
    columns = ["id", *[f"{sql} AS {c}" for c, sql in changed.items()], *plain]
    return f"SELECT {', '.join(columns)}{extra} FROM {source}"


for _k in (3, 5, 10, 15):

    def _ladder(spark, sf_dir, k=_k):
        out = an.anonymize(view(spark, sf_dir, "v_pat"), k_anonymity(k), metadata=True)
        return out.select(
            "id", "age", "ssn", "phone", "diagnosis", "location", *_PAT_REST,
            F.col("_k_anonymity_level").alias("k_level"), F.col("_anonymization_config.method").alias("method"),
        )

    query(f"a4_k{_k}", ("v_pat",), _select_sql(
        k_sql(_k), _PAT_REST, "v_pat", f", {_k} AS k_level, 'k_anonymity' AS method"))(_ladder)


@query("a1_config_grid", ("v_pat",), """
SELECT c.label, c.method, CAST(count(*) AS BIGINT) AS records FROM v_pat,
 (VALUES ('k=3','k_anonymity'),('k=5','k_anonymity'),('k=10','k_anonymity'),('k=15','k_anonymity'),
  ('eps=0.1','differential_privacy'),('eps=0.5','differential_privacy'),('eps=1.0','differential_privacy'),('eps=2.0','differential_privacy'),
  ('128-bit','tokenization'),('256-bit','tokenization'),('512-bit','tokenization')) c(label, method)
GROUP BY c.label, c.method""")
def config_grid(spark, sf_dir):
    """Every setting with the records it applies to: the grid is folded in after the count."""
    settings = F.array(*[
        F.struct(F.lit(s.label).alias("label"), F.lit(s.method).alias("method")) for s in grid()
    ])
    counted = view(spark, sf_dir, "v_pat").agg(F.count("*").alias("records"))
    return counted.select("records", F.inline(settings)).select("label", "method", "records")


# ------------------------------------------------------------------------- legacy forms

_H52 = "CAST(('0x' || substr(sha256({v}), 1, 13)) AS BIGINT)"


def _label_sql(prefix: str, column: str, digits: int) -> str:
    h = _H52.format(v=f"'{TEST_SEED}' || {column}")
    return f"'{prefix}' || lpad(CAST({h} % {10**digits} AS STRING), {digits}, '0')"


@query("a9_legacy_k", ("v_pat",), """
SELECT id, CASE WHEN diagnosis IN ('diabetes', 'hypertension') THEN 'chronic_disease'
  WHEN diagnosis IN ('asthma', 'flu') THEN 'respiratory' ELSE 'other' END AS diagnosis_generalized,
  '***-**-****' AS ssn_masked, '***-***-****' AS phone_masked, '***@***.com' AS email_masked
FROM (SELECT id, lower(diagnosis) AS diagnosis FROM v_pat) x""")
def legacy_k(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat").withColumn("diagnosis", F.lower("diagnosis"))
    return an.legacy_batch_k(df).select("id", "diagnosis_generalized", "ssn_masked", "phone_masked", "email_masked")


@query("a10_legacy_dp", ("v_pat",), """
SELECT id, 'DP_PROTECTED' AS ssn_dp, 'DP_PROTECTED' AS phone_dp, 'DP_PROTECTED' AS email_dp FROM v_pat""")
def legacy_dp(spark, sf_dir):
    return an.legacy_batch_dp(view(spark, sf_dir, "v_pat")).select("id", "ssn_dp", "phone_dp", "email_dp")


_LEGACY_SQL = {
    "k_anonymity": f"'***-**-' || right(ssn, 4) AS ssn, '***-***-' || right(phone, 4) AS phone, {_label_sql('PATIENT_', 'patient_name', 3)} AS patient_name",
    "differential_privacy": "'DP_PROTECTED_SSN' AS ssn, 'DP_PROTECTED_PHONE' AS phone, 'DP_PROTECTED_NAME' AS patient_name",
    "tokenization": f"{_label_sql('TOKEN_', 'ssn', 4)} AS ssn, {_label_sql('PHONE_TOKEN_', 'phone', 3)} AS phone, {_label_sql('PATIENT_TOKEN_', 'patient_name', 3)} AS patient_name",
}
for _method, _sql in _LEGACY_SQL.items():

    def _legacy(spark, sf_dir, method=_method):
        out = an.legacy_record(view(spark, sf_dir, "v_pat"), method, TEST_SEED)
        return out.select("id", "ssn", "phone", "patient_name")

    query(f"a11_legacy_{_method}", ("v_pat",), f"SELECT id, {_sql} FROM v_pat")(_legacy)


@query("a12_quick_token", ("v_pat",), f"""
SELECT id, {_label_sql('TOKEN_', 'ssn', 4)} AS ssn, {_label_sql('PHONE_TOKEN_', 'phone', 3)} AS phone,
  {_label_sql('EMAIL_TOKEN_', 'email', 3)} AS email, {_label_sql('PATIENT_', 'patient_name', 3)} AS patient_name FROM v_pat""")
def quick_token(spark, sf_dir):
    out = an.quick_tokens(view(spark, sf_dir, "v_pat"), seed=TEST_SEED)
    return out.select("id", "ssn", "phone", "email", "patient_name")


@query("a12_quick_dp", ("v_pat",), """
SELECT id, 'DP_PROTECTED' AS ssn, 'DP_PROTECTED' AS phone, 'DP_PROTECTED' AS email, 'DP_PROTECTED' AS patient_name FROM v_pat""")
def quick_dp(spark, sf_dir):
    out = an.quick_tokens(view(spark, sf_dir, "v_pat"), "differential_privacy")
    return out.select("id", "ssn", "phone", "email", "patient_name")


# -------------------------------------------------------------------------------- noise


def uniform_sql(purpose: str, key: str = "id") -> str:
    return f"({_H52.format(v=f"'{TEST_SEED}|{purpose}|' || {key}")} / pow(2, 52))"


def laplace_sql(purpose: str, scale: float, key: str = "id") -> str:
    u = uniform_sql(purpose, key)
    return f"(-{scale!r} * sign({u} - 0.5) * ln(greatest(1.0 - 2.0 * abs({u} - 0.5), 1e-16)))"


def dp_age_sql(eps: float) -> str:
    return f"CAST(round(greatest(0.0, least(120.0, age + {laplace_sql('age', 1.0 / eps)}))) AS INT)"


def dp_amount_sql(eps: float) -> str:
    return f"greatest(0.0, transaction_amount + {laplace_sql('transaction_amount', 100 / eps)})"


for _e, _name in ((0.1, "e01"), (0.5, "e05"), (1.0, "e1"), (2.0, "e2")):

    def _noisy(spark, sf_dir, eps=_e):
        out = an.anonymize(view(spark, sf_dir, "v_fin", heavy=True), differential_privacy(eps), seed=TEST_SEED, metadata=True)
        return out.select(
            "id", "age", F.round("transaction_amount", 4).alias("transaction_amount"),
            F.col("_epsilon_used").alias("epsilon_used"), F.col("_noise_scale").alias("noise_scale"),
        )

    query(f"a13_dp_{_name}", ("v_fin",), f"""
SELECT id, {dp_age_sql(_e)} AS age, round({dp_amount_sql(_e)}, 4) AS transaction_amount,
  CAST({_e} AS DOUBLE) AS epsilon_used, CAST({1.0 / _e!r} AS DOUBLE) AS noise_scale FROM v_fin""")(_noisy)


def gender_sql(eps: float) -> str:
    p = math.exp(eps) / (math.exp(eps) + 2)
    pick = f"CAST(floor({uniform_sql('gender_pick')} * 2) AS INT)"
    return f"""CASE WHEN {uniform_sql('gender_coin')} < {p!r} THEN gender
  WHEN gender = 'M' THEN CASE {pick} WHEN 0 THEN 'F' ELSE 'Other' END
  WHEN gender = 'F' THEN CASE {pick} WHEN 0 THEN 'M' ELSE 'Other' END
  ELSE CASE {pick} WHEN 0 THEN 'M' ELSE 'F' END END"""


@query("a15_randomized_response", ("v_pat",), f"SELECT id, {gender_sql(1.0)} AS gender FROM v_pat")
def response(spark, sf_dir):
    out = an.anonymize(view(spark, sf_dir, "v_pat"), differential_privacy(1.0), seed=TEST_SEED)
    return out.select("id", "gender")


_TIERS = ((0.1, "STRONG"), (0.5, "MED"), (1.0, "WEAK"))


def _tier_sql(tier: str) -> str:
    return (
        f"{_label_sql(f'DP_{tier}_', 'ssn', 4)} AS ssn, {_label_sql(f'DP_{tier}_', 'phone', 4)} AS phone, "
        f"{_label_sql(f'DP_{tier}_', 'email', 3)} || '@private.com' AS email"
    )


for _e, _tier in _TIERS:

    def _identifiers(spark, sf_dir, eps=_e):
        out = an.anonymize(view(spark, sf_dir, "v_pat"), differential_privacy(eps), seed=TEST_SEED)
        return out.select("id", "ssn", "phone", "email")

    query(f"a16_tier_{_tier.lower()}", ("v_pat",), f"SELECT id, {_tier_sql(_tier)} FROM v_pat")(_identifiers)

# ------------------------------------------------------------------------------- tokens


def hmac_sql(column: str, key_bits: int) -> str:
    key = TEST_SECRET[: key_bits // 8].ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({column}))))"


def token_sql(column: str, bits: int) -> str:
    prefix, suffix = an.TOKEN_AFFIXES[column]
    length = {128: 8, 256: 12, 512: 16}[bits]
    text = f"'{prefix}_{bits}_' || substr({hmac_sql(column, bits)}, 1, {length}) || '{suffix}'"
    return _keep(column, text)


@query("a17_hmac_token", ("v_pat",), f"SELECT id, {hmac_sql('patient_name', 256)} AS digest FROM v_pat")
def hmac_token(spark, sf_dir):
    from sparkveil.functions.hashing import hmac_sha256

    df = view(spark, sf_dir, "v_pat")
    return df.select("id", hmac_sha256(F.col("patient_name"), TEST_SECRET[:32]).alias("digest"))


for _bits in (128, 256, 512):

    def _patients(spark, sf_dir, bits=_bits):
        out = an.anonymize(view(spark, sf_dir, "v_pat"), tokenization(bits), secret=TEST_SECRET, metadata=True)
        return out.select("id", "ssn", "phone", "email", "patient_name", F.col("_token_key_length").alias("key_length"))

    def _accounts(spark, sf_dir, bits=_bits):
        out = an.anonymize(view(spark, sf_dir, "v_fin", heavy=True), tokenization(bits), secret=TEST_SECRET)
        return out.select("id", "customer_name", "account_number", "transaction_amount")

    query(f"a18_token_{_bits}", ("v_pat",), "SELECT id, " + ", ".join(
        f"{token_sql(c, _bits)} AS {c}" for c in ("ssn", "phone", "email", "patient_name")
    ) + f", {_bits} AS key_length FROM v_pat")(_patients)
    query(f"a18_token_fin_{_bits}", ("v_fin",), "SELECT id, " + ", ".join(
        f"{token_sql(c, _bits)} AS {c}" for c in ("customer_name", "account_number")
    ) + ", transaction_amount FROM v_fin")(_accounts)


# ------------------------------------------------- conditional, unconditional, provenance


@query("a19_conditional", ("v_fin",), f"""
SELECT id, CASE WHEN {_COUNT_FIN} > 0 THEN {token_sql('customer_name', 256)} ELSE customer_name END AS customer_name,
  CASE WHEN {_COUNT_FIN} > 0 THEN {token_sql('account_number', 256)} ELSE account_number END AS account_number FROM v_fin""")
def conditional(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin", heavy=True)
    out = an.anonymize(df, tokenization(256), secret=TEST_SECRET, where=co.violates(df, "financial"))
    return out.select("id", "customer_name", "account_number")


@query("a20_unconditional", ("v_pat",), "SELECT id, " + ", ".join(f"{s} AS {c}" for c, s in k_sql(3).items()) + """,
  CASE WHEN medical_record_number <> '' THEN substr(medical_record_number, 1, 3) || '*******' ELSE medical_record_number END AS medical_record_number
FROM v_pat""")
def unconditional(spark, sf_dir):
    """All records, with the added masker for the record number the ladders leave alone."""
    out = an.anonymize(view(spark, sf_dir, "v_pat"), k_anonymity(3), extended=True)
    return out.select("id", "age", "ssn", "phone", "diagnosis", "location", "medical_record_number")


@query("a21_provenance", ("v_fin",), f"""
SELECT id, CAST(ceil(row_number() OVER (ORDER BY CAST(id AS BIGINT)) / 1000.0) AS BIGINT) AS processing_batch,
  'batch' AS processed_via, TIMESTAMP '2024-01-01 12:00:00' AS processed_at, {_COUNT_FIN} > 0 AS anonymized,
  'tokenization' AS anonymization_method, '256-bit' AS anonymization_parameters FROM v_fin""")
def provenance(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin").withColumn("__order", F.col("id").cast("bigint"))
    numbered = batch_numbers(df, ["__order"])
    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    out = an.with_provenance(numbered, tokenization(256), "batch", at, co.violates(df, "financial"))
    return out.select(
        "id", "processing_batch", "processed_via", "processed_at", "anonymized",
        "anonymization_method", "anonymization_parameters",
    )


@query("w2_batch_number", (), """
SELECT job_id, line, CAST(row_number() OVER (ORDER BY job_id, line) AS BIGINT) AS row_number,
  CAST(ceil(row_number() OVER (ORDER BY job_id, line) / 1000.0) AS BIGINT) AS batch
FROM (SELECT DISTINCT l_orderkey AS job_id, l_linenumber AS line FROM lineitem) x""")
def batch_number(spark, sf_dir):
    """Row and batch number over (order, line) without a one-task sort."""
    from sparkveil.views import table

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line")
    ).distinct()
    numbered = row_numbers(lines, ["job_id", "line"])
    return numbered.select("job_id", "line", "row_number", F.ceil(F.col("row_number") / 1000).cast("bigint").alias("batch"))
