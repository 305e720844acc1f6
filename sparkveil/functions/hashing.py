"""Hash-derived columns: keyed tokens, reproducible uniforms, canonical record hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_BLOCK = 64  # SHA-256 block size in bytes
_SEPARATOR = "\u0001"
_NULL = "\u0000"


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, from the built-in digest: H(outer || H(inner || value))."""
    if len(key) > _BLOCK:
        raise ValueError("keys longer than one block are not supported")
    padded = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer = F.lit(bytearray(b ^ 0x5C for b in padded))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def hash52(value: Column) -> Column:
    """The first 52 bits of SHA-256 as a non-negative long; the same on every engine and run."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 13), 16, 10).cast("bigint")


def hash_uniform(*parts: Column) -> Column:
    """A uniform in [0, 1) that depends only on the parts, not on partitioning or retries."""
    return hash52(F.concat_ws("|", *parts)) / F.lit(float(2**52))


def hash_mod(value: Column, modulus: int, secret: str = "") -> Column:
    keyed = F.concat(F.lit(secret), value) if secret else value
    return F.pmod(hash52(keyed), F.lit(modulus))


def canonical_text(column: Column, data_type: T.DataType) -> Column:
    """Text form of a value that does not depend on session settings or engine version."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = F.format_string("%.16e", column.cast("double"))
    elif isinstance(data_type, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(data_type, T.BinaryType):
        text = F.hex(column)
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(column, {"ignoreNullFields": "false", "timeZone": "UTC"})
    else:
        text = column.cast("string")
    return F.when(column.isNull(), F.lit(_NULL)).otherwise(text)


def record_hash(schema: T.StructType, exclude: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a record: fields in name order, each with its name and its value as `N` or `V<bytes>:<text>`.

    With the length in front no text can pass for a border between fields or for a missing value.
    """
    fields = sorted((f for f in schema.fields if f.name not in exclude), key=lambda f: f.name)
    parts = []
    for field in fields:
        column = F.col(f"`{field.name}`")
        text = canonical_text(column, field.dataType)
        value = F.concat(F.lit("V"), F.octet_length(text), F.lit(":"), text)
        parts += [F.lit(field.name), F.when(column.isNull(), F.lit("N")).otherwise(value)]
    return F.sha2(F.concat_ws(_SEPARATOR, *parts), 256)
