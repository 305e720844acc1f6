"""Typed reading with a reject channel: what cannot be read is listed, not lost.

A reject is (column, value, reason). Readers put the rejects of a row into an array next to its columns, so rows and
rejects come out of one pass over the input; `channel` and `counts` turn that array into tables of their own.
JSON is parsed to a variant first, which tells an absent field, a null and a value of another kind apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

REJECTS = "_rejects"
# Texts that mean true and false.
TRUE_TEXTS = ("true", "True", "1")
FALSE_TEXTS = ("false", "False", "0")

_REJECT = "array<struct<column: string, value: string, reason: string>>"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


def reject(column: Column | str, value: Column, reason: Column | str) -> Column:
    """One reject as a struct."""
    column, reason = (F.lit(x) if isinstance(x, str) else x for x in (column, reason))
    return F.struct(column.alias("column"), value.cast("string").alias("value"), reason.alias("reason"))


def listed(*tests: tuple[Column, Column]) -> Column:
    """Array of the rejects whose test holds, given as (test, reject)."""
    return F.filter(F.array(*[F.when(test, entry) for test, entry in tests]).cast(_REJECT), lambda x: x.isNotNull())


def from_text(text: Column, kind: T.DataType) -> Column:
    """A text as a value of the kind; NULL where it is none. Booleans are the fixed texts only."""
    if isinstance(kind, T.BooleanType):
        return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))
    return text.try_cast(kind.simpleString())


def _scalar(v: Column, kind: T.DataType) -> Column:
    """A variant as a value of the kind; NULL where it is of another. Numbers and times may also be given as text."""
    text, of = F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)
    number = of.isin("BIGINT", "DOUBLE", "FLOAT") | of.startswith("DECIMAL")
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return from_text(text, kind)
    if isinstance(kind, _WHOLE):
        whole, real = F.try_variant_get(v, "$", kind.simpleString()), F.try_variant_get(v, "$", "double")
        return F.when(number & (whole.cast("double") == real), whole).when(of == "STRING", from_text(text, kind))
    if isinstance(kind, _REAL):
        real = F.try_variant_get(v, "$", kind.simpleString())
        return F.when(number & (F.abs(real) != float("inf")), real).when(of == "STRING", from_text(text, kind))
    if isinstance(kind, T.DecimalType):
        return F.when(number | (of == "STRING"), from_text(text, kind))
    return F.when(of == "STRING", from_text(text, kind))


def from_variant(v: Column, kind: T.DataType, name: Column) -> tuple[Column, Column]:
    """(value, rejects) of a variant read as the kind, through nested types; `name` says where in the document it stands."""
    given = v.isNotNull() & ~F.is_variant_null(v)
    text = F.try_variant_get(v, "$", "string")
    if isinstance(kind, T.StructType):
        of = F.coalesce(F.schema_of_variant(v), F.lit(""))
        parts = [from_variant(F.try_variant_get(v, f"$['{f.name}']", "variant"), f.dataType, _below(name, f.name)) for f in kind.fields]
        fields = F.struct(*[value.alias(f.name) for f, (value, _) in zip(kind.fields, parts)])
        missing = [(given & (value.isNull()) & (F.size(bad) == 0), reject(_below(name, f.name), F.lit(None), "missing")) for f, (value, bad) in zip(kind.fields, parts) if not f.nullable]
        wrong = listed((given & ~of.startswith("OBJECT"), reject(name, text, "not an object")), *[(of.startswith("OBJECT") & t, r) for t, r in missing])
        inside = F.when(of.startswith("OBJECT"), F.concat(*[bad for _, bad in parts])).otherwise(F.array().cast(_REJECT)) if parts else F.array().cast(_REJECT)
        return F.when(of.startswith("OBJECT"), fields), F.concat(wrong, inside)
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(v, "$", "array<variant>")
        at = lambda i: F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))
        bad = F.flatten(F.transform(items, lambda x, i: from_variant(x, kind.elementType, at(i))[1]))
        wrong = listed((given & items.isNull(), reject(name, text, "not an array")))
        return F.transform(items, lambda x: from_variant(x, kind.elementType, name)[0]), F.concat(wrong, F.coalesce(bad, F.array().cast(_REJECT)))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        items = F.try_variant_get(v, "$", "map<string,variant>")
        bad = F.flatten(F.transform(F.map_entries(items), lambda e: from_variant(e["value"], kind.valueType, F.concat(name, F.lit("."), e["key"]))[1]))
        wrong = listed((given & items.isNull(), reject(name, text, "not a map")))
        return F.transform_values(items, lambda _, x: from_variant(x, kind.valueType, name)[0]), F.concat(wrong, F.coalesce(bad, F.array().cast(_REJECT)))
    if isinstance(kind, T.VariantType):
        return v, F.array().cast(_REJECT)
    value = _scalar(v, kind)
    return value, listed((given & value.isNull(), reject(name, text, f"not a {kind.simpleString()}")))


def _below(name: Column, field: str) -> Column:
    return F.when(name == "", F.lit(field)).otherwise(F.concat(name, F.lit(f".{field}")))


def channel(df: DataFrame, keep: tuple[str, ...] = (), rejects: str = REJECTS) -> DataFrame:
    """A row per reject: (*keep, column, value, reason)."""
    return df.select(*keep, F.explode(rejects).alias("__r")).select(*keep, "__r.column", "__r.value", "__r.reason")


def counts(df: DataFrame, rejects: str = REJECTS) -> DataFrame:
    """(column, reason, rejects): how many values were rejected, in one aggregate."""
    return channel(df, (), rejects).groupBy("column", "reason").agg(F.count("*").alias("rejects"))


def totals(df: DataFrame, rejects: str = REJECTS) -> DataFrame:
    """One row (records, rejected_records, rejects): every record of the input is in one of the two outputs."""
    return df.agg(
        F.count("*").alias("records"), F.count_if(F.size(rejects) > 0).alias("rejected_records"),
        F.coalesce(F.sum(F.size(rejects)).cast("bigint"), F.lit(0).cast("bigint")).alias("rejects"),
    )
