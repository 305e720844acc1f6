"""Anonymization as projections: generalization ladders, noise, keyed tokens.

Every method is a set of column expressions applied in one `select`, so it runs inside the
scan stage, needs no shuffle and works on streams. NULL stays NULL in every method, and ''
stays '' under generalization and tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkveil.config import DIFFERENTIAL_PRIVACY, K_ANONYMITY, TOKENIZATION, Anonymization
from sparkveil.functions import hashing, noise
from sparkveil.functions.values import present

# ----------------------------------------------------------------- generalization ladders


def _tier(k: int) -> int:
    """0 for k up to 3, 1 for k up to 10, 2 above."""
    return 0 if k <= 3 else 1 if k <= 10 else 2


def generalize_age(age: Column, k: int) -> Column:
    """Text range of 10, 20 or 30 years."""
    width = (10, 20, 30)[_tier(k)]
    low = (F.floor(age.cast("int") / F.lit(width)) * width).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + (width - 1)).cast("string"))


def generalize_ssn(ssn: Column, k: int) -> Column:
    return (
        F.concat(F.substring(ssn, 1, 5), F.lit("****")),
        F.concat(F.substring(ssn, 1, 3), F.lit("******")),
        F.lit("***-**-****"),
    )[_tier(k)]


def generalize_phone(phone: Column, k: int) -> Column:
    return (
        F.concat(F.substring(phone, 1, 6), F.lit("****")),
        F.concat(F.substring(phone, 1, 3), F.lit("*******")),
        F.lit("***-***-****"),
    )[_tier(k)]


# Groups of diagnoses.
DIAGNOSIS_GROUPS = {
    "chronic_condition": ("diabetes", "hypertension"),
    "respiratory_infection": ("flu", "cold"),
}


def generalize_diagnosis(diagnosis: Column, k: int) -> Column:
    if _tier(k) > 0:
        return F.lit("medical_condition")
    lowered = F.lower(diagnosis)
    chain = None
    for group, members in DIAGNOSIS_GROUPS.items():
        test = lowered.isin(*members)
        chain = F.when(test, F.lit(group)) if chain is None else chain.when(test, F.lit(group))
    return chain.otherwise(F.lit("other_condition"))


def generalize_location(location: Column, k: int) -> Column:
    return F.substring_index(location, ",", 1) if _tier(k) == 0 else F.lit("Region_Generalized")


def mask_identifier(value: Column, k: int) -> Column:
    """Added masker for identifiers the ladders leave alone: keep the first three characters or none."""
    return F.concat(F.substring(value, 1, 3), F.lit("*******")) if _tier(k) == 0 else F.lit("**********")


LADDERS: dict[str, Callable[[Column, int], Column]] = {
    "age": generalize_age,
    "ssn": generalize_ssn,
    "phone": generalize_phone,
    "diagnosis": generalize_diagnosis,
    "location": generalize_location,
}
# Identifiers the reference semantics never touch; masked only on request.
UNTOUCHED_IDENTIFIERS = ("medical_record_number", "insurance_id", "credit_card", "credit_card_number")


def _kept_unless_present(column: str, data_type: T.DataType, changed: Column) -> Column:
    original = F.col(column)
    result_type = T.StringType() if column == "age" else data_type
    return F.when(present(original, data_type), changed).otherwise(original.cast(result_type))


def k_columns(schema: T.StructType, k: int, extended: bool = False) -> dict[str, Column]:
    types = {f.name: f.dataType for f in schema.fields}
    out = {}
    for name, ladder in LADDERS.items():
        if name in types:
            value = F.col(name) if name == "age" else F.col(name).cast("string")
            out[name] = _kept_unless_present(name, types[name], ladder(value, k))
    if extended:
        for name in UNTOUCHED_IDENTIFIERS:
            if name in types:
                out[name] = _kept_unless_present(name, types[name], mask_identifier(F.col(name).cast("string"), k))
    return out


# --------------------------------------------------------------------------------- noise

# Fixed values.
GENDERS = ("M", "F", "Other")
AGE_RANGE = (0, 120)
AMOUNT_SENSITIVITY = 100


def dp_strength(epsilon: float) -> str:
    return "STRONG" if epsilon < 0.5 else "MED" if epsilon < 1.0 else "WEAK"


def _draw(purpose: str) -> str:
    return f"__draw_{purpose}"


def dp_draws(schema: T.StructType, key: Column, seed: str) -> dict[str, Column]:
    """The uniforms noise is made of: hashed from the release seed, a purpose and the record key."""
    names = {f.name for f in schema.fields}
    purposes = [c for c in ("age", "transaction_amount") if c in names]
    purposes += ["gender_coin", "gender_pick"] if "gender" in names else []
    return {_draw(p): hashing.hash_uniform(F.lit(seed), F.lit(p), key) for p in purposes}


def dp_columns(schema: T.StructType, epsilon: float, seed: str) -> dict[str, Column]:
    """Noisy columns over a record set prepared with `dp_draws`; `seed` is the secret of this release."""
    types = {f.name: f.dataType for f in schema.fields}

    def uniform(purpose: str) -> Column:
        return F.col(_draw(purpose))

    out = {}
    if "age" in types:
        age = F.col("age").cast("double")
        noisy = age + noise.laplace(uniform("age"), 1.0 / epsilon)
        bounded = F.greatest(F.lit(float(AGE_RANGE[0])), F.least(F.lit(float(AGE_RANGE[1])), noisy))
        out["age"] = F.when(present(F.col("age"), types["age"]), F.round(bounded).cast("int")).otherwise(
            F.col("age").cast("int")
        )
    if "transaction_amount" in types:
        amount = F.col("transaction_amount").cast("double")
        noisy = F.greatest(F.lit(0.0), amount + noise.laplace(uniform("transaction_amount"), AMOUNT_SENSITIVITY / epsilon))
        out["transaction_amount"] = F.when(
            present(F.col("transaction_amount"), types["transaction_amount"]), noisy
        ).otherwise(amount)
    if "gender" in types:
        answer = noise.randomized_response(
            F.col("gender"), GENDERS, epsilon, uniform("gender_coin"), uniform("gender_pick")
        )
        out["gender"] = _kept_unless_present("gender", types["gender"], answer)
    tier = dp_strength(epsilon)
    for name, digits, suffix in (("ssn", 4, ""), ("phone", 4, ""), ("email", 3, "@private.com")):
        if name in types:
            bucket = hashing.hash_mod(F.col(name).cast("string"), 10**digits, seed)
            label = F.concat(F.lit(f"DP_{tier}_"), F.lpad(bucket.cast("string"), digits, "0"), F.lit(suffix))
            out[name] = F.when(F.col(name).isNotNull(), label)
    return out


# -------------------------------------------------------------------------------- tokens

# Prefix and suffix of a token per column.
TOKEN_AFFIXES = {
    "ssn": ("TOKEN", ""),
    "phone": ("PHONE", ""),
    "email": ("EMAIL", "@tokenized.com"),
    "patient_name": ("PATIENT", ""),
    "customer_name": ("CUSTOMER", ""),
    "account_number": ("ACCT", ""),
}


def token_length(key_bits: int) -> int:
    return 16 if key_bits >= 512 else 12 if key_bits >= 256 else 8


def token(value: Column, key_bits: int, secret: bytes) -> Column:
    """Keyed token of a value; the same secret gives the same token in every job and stream."""
    if len(secret) * 8 < key_bits:
        raise ValueError(f"the secret has {len(secret) * 8} bits, {key_bits} are needed")
    digest = hashing.hmac_sha256(value, secret[: key_bits // 8])
    return F.substring(digest, 1, token_length(key_bits))


def token_columns(schema: T.StructType, key_bits: int, secret: bytes, extended: bool = False) -> dict[str, Column]:
    types = {f.name: f.dataType for f in schema.fields}
    affixes = dict(TOKEN_AFFIXES)
    if extended:
        affixes |= {name: (name.upper(), "") for name in UNTOUCHED_IDENTIFIERS}
    out = {}
    for name, (prefix, suffix) in affixes.items():
        if name in types:
            text = F.col(name).cast("string")
            value = F.concat(F.lit(f"{prefix}_{key_bits}_"), token(text, key_bits, secret), F.lit(suffix))
            out[name] = _kept_unless_present(name, types[name], value)
    return out


# ------------------------------------------------------------------------------ dispatch

_CUSTOM: dict[str, Callable[[T.StructType, Anonymization], dict[str, Column]]] = {}


def register_method(name: str, build: Callable[[T.StructType, Anonymization], dict[str, Column]]) -> None:
    """Add a method of the user: a function from (schema, settings) to changed columns."""
    _CUSTOM[name] = build


def effect(settings: Anonymization) -> tuple:
    """Equal for settings that change records in the same way: k values of one ladder rung do."""
    return (settings.method, _tier(settings.k)) if settings.method == K_ANONYMITY else (settings,)


def prepare(df: DataFrame, settings: Anonymization, key: str = "id", seed: str = "") -> DataFrame:
    """Records with the helper columns a method needs.

    They stand in a projection of their own, so each hash is computed once however often the
    changed columns use it.
    """
    if settings.method != DIFFERENTIAL_PRIVACY:
        return df
    draws = dp_draws(df.schema, F.col(key).cast("string"), seed)
    return df.select("*", *[v.alias(n) for n, v in draws.items() if n not in df.columns])


def changed_columns(
    schema: T.StructType, settings: Anonymization, secret: bytes = b"", seed: str = "", extended: bool = False
) -> dict[str, Column]:
    """The columns a method changes, as expressions over a prepared record set."""
    if settings.method == K_ANONYMITY:
        return k_columns(schema, settings.k, extended)
    if settings.method == DIFFERENTIAL_PRIVACY:
        return dp_columns(schema, settings.epsilon, seed)
    if settings.method == TOKENIZATION:
        return token_columns(schema, settings.key_bits, secret, extended)
    if settings.method in _CUSTOM:
        return _CUSTOM[settings.method](schema, settings)
    raise ValueError(f"unknown anonymization method {settings.method!r}")


def metadata_column(settings: Anonymization) -> Column:
    return F.struct(
        F.lit(settings.method).alias("method"),
        F.struct(
            F.lit(settings.k).cast("int").alias("k_value"),
            F.lit(settings.epsilon).cast("double").alias("epsilon"),
            F.lit(settings.key_bits).cast("int").alias("key_length"),
        ).alias("parameters"),
    )


def level_columns(settings: Anonymization) -> list[Column]:
    """The per-method metadata columns."""
    if settings.method == K_ANONYMITY:
        return [F.lit(settings.k).alias("_k_anonymity_level")]
    if settings.method == DIFFERENTIAL_PRIVACY:
        return [F.lit(settings.epsilon).alias("_epsilon_used"), F.lit(1.0 / settings.epsilon).alias("_noise_scale")]
    if settings.method == TOKENIZATION:
        return [F.lit(settings.key_bits).alias("_token_key_length")]
    return []


def anonymize(
    df: DataFrame,
    settings: Anonymization,
    key: str = "id",
    secret: bytes = b"",
    seed: str = "",
    where: Column | None = None,
    extended: bool = False,
    metadata: bool = False,
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """Anonymize all records, or only those where `where` holds; `fields` limits the columns.

    A column whose type changes (age becomes a text range) has the new type in every row.
    """
    changed = changed_columns(df.schema, settings, secret, seed, extended)
    if fields is not None:
        changed = {c: v for c, v in changed.items() if c in fields}
    prepared = prepare(df, settings, key, seed)
    out = []
    for f in df.schema.fields:
        if f.name not in changed:
            out.append(F.col(f"`{f.name}`"))
            continue
        value = changed[f.name]
        if where is not None:
            new_type = prepared.select(value.alias("x")).schema["x"].dataType
            value = F.when(where, value).otherwise(F.col(f.name).cast(new_type))
        out.append(value.alias(f.name))
    if metadata:
        out += [metadata_column(settings).alias("_anonymization_config"), *level_columns(settings)]
    return prepared.select(*out)


def with_provenance(df: DataFrame, settings: Anonymization, via: str, processed_at: Column, anonymized: Column) -> DataFrame:
    """Provenance columns; the time is a parameter so that a rerun gives the same rows."""
    return df.select(
        "*",
        F.lit(via).alias("processed_via"),
        processed_at.alias("processed_at"),
        anonymized.alias("anonymized"),
        F.lit(settings.method).alias("anonymization_method"),
        F.lit(settings.label).alias("anonymization_parameters"),
    )


# ------------------------------------------------------------- legacy forms of the methods


def legacy_batch_k(df: DataFrame) -> DataFrame:
    """Added columns of the old batch job: generalized diagnosis and constant masks."""
    diagnosis = F.col("diagnosis")
    return df.select(
        "*",
        F.when(diagnosis.isin("diabetes", "hypertension"), "chronic_disease")
        .when(diagnosis.isin("asthma", "flu"), "respiratory")
        .otherwise("other")
        .alias("diagnosis_generalized"),
        F.lit("***-**-****").alias("ssn_masked"),
        F.lit("***-***-****").alias("phone_masked"),
        F.lit("***@***.com").alias("email_masked"),
    )


def legacy_batch_dp(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit("DP_PROTECTED").alias(f"{c}_dp") for c in ("ssn", "phone", "email")])


def _hash_label(prefix: str, column: str, digits: int, seed: str) -> Column:
    bucket = hashing.hash_mod(F.col(column).cast("string"), 10**digits, seed)
    return F.concat(F.lit(prefix), F.lpad(bucket.cast("string"), digits, "0"))


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def legacy_record(df: DataFrame, method: str, seed: str = "") -> DataFrame:
    """The old per-record helper: keep the last four characters, constants, or short hash labels."""
    if method == K_ANONYMITY:
        new = {
            "ssn": F.concat(F.lit("***-**-"), F.right(F.col("ssn"), F.lit(4))),
            "phone": F.concat(F.lit("***-***-"), F.right(F.col("phone"), F.lit(4))),
            "patient_name": _hash_label("PATIENT_", "patient_name", 3, seed),
        }
    elif method == DIFFERENTIAL_PRIVACY:
        new = {
            "ssn": F.lit("DP_PROTECTED_SSN"),
            "phone": F.lit("DP_PROTECTED_PHONE"),
            "patient_name": F.lit("DP_PROTECTED_NAME"),
        }
    elif method == TOKENIZATION:
        new = {
            "ssn": _hash_label("TOKEN_", "ssn", 4, seed),
            "phone": _hash_label("PHONE_TOKEN_", "phone", 3, seed),
            "patient_name": _hash_label("PATIENT_TOKEN_", "patient_name", 3, seed),
        }
    else:
        raise ValueError(f"unknown anonymization method {method!r}")
    return _replace(df, new)


def quick_tokens(df: DataFrame, method: str = TOKENIZATION, seed: str = "") -> DataFrame:
    """The short labels of the stream path, from a stable hash instead of a per-process one."""
    if method == DIFFERENTIAL_PRIVACY:
        new = {c: F.lit("DP_PROTECTED") for c in ("ssn", "phone", "email", "patient_name")}
    else:
        new = {
            "ssn": _hash_label("TOKEN_", "ssn", 4, seed),
            "phone": _hash_label("PHONE_TOKEN_", "phone", 3, seed),
            "email": _hash_label("EMAIL_TOKEN_", "email", 3, seed),
            "patient_name": _hash_label("PATIENT_", "patient_name", 3, seed),
        }
    return _replace(df, new)
