"""Information loss, privacy scores and detection quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkveil.config import DIFFERENTIAL_PRIVACY, K_ANONYMITY, TOKENIZATION, Anonymization
from sparkveil.operators import anonymize as an

_NUMERIC = (T.NumericType, T.BooleanType)


def as_number(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, _NUMERIC):
        return column.cast("double")
    if isinstance(data_type, T.StringType):
        return column.try_cast("double")
    return F.lit(None).cast("double")


def field_loss(
    original: Column, original_type: T.DataType, changed: Column, changed_type: T.DataType, value_range: Column | None
) -> Column:
    """Loss of one field in [0, 1]: relative distance for numbers, edit distance for texts.

    Equal values, two NULLs included, lose nothing; a value that became NULL is lost.
    """
    before, after = as_number(original, original_type), as_number(changed, changed_type)
    text_before, text_after = original.cast("string"), changed.cast("string")
    magnitude = F.when(F.abs(before) > 0, F.abs(before)).otherwise(F.lit(1.0))
    scale = magnitude if value_range is None else F.coalesce(F.nullif(value_range, F.lit(0.0)), magnitude)
    numeric = F.least(F.lit(1.0), F.abs(before - after) / scale)
    textual = F.least(
        F.lit(1.0), F.levenshtein(text_before, text_after) / F.greatest(F.length(text_before), F.lit(1))
    )
    return (
        F.when(text_before.eqNullSafe(text_after), F.lit(0.0))
        .when(text_before.isNull() | text_after.isNull(), F.lit(1.0))
        .when(before.isNotNull() & after.isNotNull(), numeric)
        .otherwise(textual)
    )


def numeric_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with `<column>_min`, `<column>_max` of every column that can be read as a number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in (columns or df.columns) if isinstance(types[c], (*_NUMERIC, T.StringType))]
    aggregates = []
    for c in wanted:
        number = as_number(F.col(c), types[c])
        aggregates += [F.min(number).alias(f"{c}_min"), F.max(number).alias(f"{c}_max")]
    return df.agg(*aggregates)


def _range_columns(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """max - min per column as one scalar subquery: an aggregate of the scan, no join."""
    if not columns:
        return {}
    ranges = numeric_ranges(df, columns)
    have = [c for c in columns if f"{c}_min" in ranges.columns]
    if not have:
        return {}
    packed = ranges.select(F.struct(*[(F.col(f"{c}_max") - F.col(f"{c}_min")).alias(c) for c in have]).alias("r"))
    scalar = packed.scalar()
    return {c: scalar.getField(c) for c in have}


def with_losses(
    df: DataFrame, settings: list[Anonymization], key: str = "id", secret: bytes = b"", seed: str = ""
) -> tuple[DataFrame, list[dict[str, Column]]]:
    """Records with the changed values of every setting beside the original ones, and the loss per changed field.

    The changed values stand in a projection of their own, so that a token or a noisy value is
    computed once although its loss looks at it several times.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    prepared = df
    for s in settings:
        prepared = an.prepare(prepared, s, key, seed)
    effects = [an.effect(s) for s in settings]
    source = [effects.index(e) for e in effects]  # settings with the same effect share their columns
    changed = [an.changed_columns(df.schema, s, secret, seed) for s in settings]
    staged = prepared.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[v.alias(f"__c{i}_{c}") for i, columns in enumerate(changed) if source[i] == i for c, v in columns.items()],
    )
    after = {f.name: f.dataType for f in staged.schema.fields}
    # Ranges only matter where original and changed value are both numbers.
    numeric = sorted({
        c for i, columns in zip(source, changed) for c in columns
        if isinstance(types[c], _NUMERIC) and isinstance(after[f"__c{i}_{c}"], _NUMERIC)
    })
    ranges = _range_columns(df, numeric)
    losses = [
        {
            c: field_loss(F.col(c), types[c], F.col(f"__c{i}_{c}"), after[f"__c{i}_{c}"], ranges.get(c))
            for c in columns
        }
        for i, columns in zip(source, changed)
    ]
    return staged, losses


def _mean_loss(losses: dict[str, Column], fields: int) -> Column:
    """Mean over the fields of a record; untouched fields count as 0 without being read."""
    total = F.lit(0.0)
    for value in losses.values():
        total = total + value
    return total / F.lit(float(fields))


def _field_count(df: DataFrame) -> int:
    return sum(not c.startswith("_") for c in df.columns)


def record_loss(df: DataFrame, settings: Anonymization, key: str = "id", **kwargs) -> DataFrame:
    """Loss and utility per record."""
    staged, (losses,) = with_losses(df, [settings], key, **kwargs)
    scored = staged.select(key, _mean_loss(losses, _field_count(df)).alias("information_loss"))
    return scored.select("*", (F.lit(1.0) - F.col("information_loss")).alias("utility_preservation"))


def field_losses(df: DataFrame, settings: Anonymization, key: str = "id", **kwargs) -> DataFrame:
    """Mean loss per changed field, one row."""
    staged, (losses,) = with_losses(df, [settings], key, **kwargs)
    return staged.agg(*[F.avg(v).alias(f"{c}_loss") for c, v in losses.items()])


def grid_loss(df: DataFrame, settings: list[Anonymization], key: str = "id", **kwargs) -> DataFrame:
    """Mean loss, utility and privacy level of all settings over all records in one scan.

    The grid of the experiment is a cross of settings and records; here the records are read
    once and no row is multiplied: every setting is one aggregate column.
    """
    staged, losses = with_losses(df, settings, key, **kwargs)
    fields, effects = _field_count(df), [an.effect(s) for s in settings]
    source = [effects.index(e) for e in effects]
    means = staged.agg(
        F.count("*").alias("records"),
        *[F.avg(_mean_loss(l, fields)).alias(f"m{i}") for i, l in enumerate(losses) if source[i] == i],
    )
    rows = [
        F.struct(
            F.lit(s.method).alias("method"), F.lit(s.label).alias("setting"), F.col("records").alias("records"),
            F.col(f"m{i}").alias("information_loss"),
            (F.lit(1.0) - F.col(f"m{i}")).alias("utility_preservation"),
            F.lit(privacy_level(s)).alias("privacy_level"),
        )
        for i, s in zip(source, settings)
    ]
    return means.select(F.inline(F.array(*rows)))


def dataset_loss(df: DataFrame, settings: Anonymization, key: str = "id", **kwargs) -> DataFrame:
    """The same for one setting."""
    return grid_loss(df, [settings], key, **kwargs)


def joined_loss(original: DataFrame, anonymized: DataFrame, key: str) -> DataFrame:
    """Loss per record when both sides are stored tables: an equi-join on the record key."""
    fields = [c for c in original.columns if c in anonymized.columns and not c.startswith("_")]
    left_types = {f.name: f.dataType for f in original.schema.fields}
    right_types = {f.name: f.dataType for f in anonymized.schema.fields}
    numeric = [
        c for c in fields if isinstance(left_types[c], _NUMERIC) and isinstance(right_types[c], _NUMERIC) and c != key
    ]
    ranges = _range_columns(original, numeric)
    right = anonymized.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__a_{c}") for c in fields if c != key])
    joined = original.join(right, F.col(key) == F.col("__key"))
    total = F.lit(0.0)
    for c in fields:
        if c != key:
            total = total + field_loss(F.col(c), left_types[c], F.col(f"__a_{c}"), right_types[c], ranges.get(c))
    loss = total / F.lit(float(len(fields)))
    return joined.select(key, loss.alias("information_loss"), (F.lit(1.0) - loss).alias("utility_preservation"))


def privacy_level(settings: Anonymization) -> float:
    """Score of a setting; for noise it rises with epsilon, as published."""
    if settings.method == K_ANONYMITY and settings.k:
        return 1.0 - 1.0 / max(1, settings.k)
    if settings.method == DIFFERENTIAL_PRIVACY and settings.epsilon is not None:
        return 1.0 - math.exp(-settings.epsilon)
    if settings.method == TOKENIZATION and settings.key_bits:
        return min(1.0, settings.key_bits / 512.0)
    return 0.5


def corrected_privacy_level(settings: Anonymization) -> float:
    """The same score with the direction of noise put right: less epsilon, more privacy."""
    if settings.method == DIFFERENTIAL_PRIVACY and settings.epsilon is not None:
        return math.exp(-settings.epsilon)
    return privacy_level(settings)


def report_privacy_column(method: Column, k: Column, epsilon: Column) -> Column:
    """Privacy level as the job report computes it, per row of a job table."""
    return (
        F.when((method == K_ANONYMITY) & (k > 0), F.least(F.lit(1.0), k / F.lit(20.0)))
        .when((method == DIFFERENTIAL_PRIVACY) & (epsilon > 0), F.greatest(F.lit(0.1), F.lit(1.0) - epsilon))
        .when(method == TOKENIZATION, F.lit(0.7))
        .otherwise(F.lit(0.5))
    )


def detection_quality(df: DataFrame, detected: Column, label: Column) -> DataFrame:
    """Precision, recall, F1 and error rates of a check against planted labels, in one pass."""
    flags = df.select(F.coalesce(detected, F.lit(False)).alias("d"), F.coalesce(label, F.lit(False)).alias("l"))
    d, l = F.col("d"), F.col("l")
    counts = flags.agg(
        F.count_if(d & l).alias("tp"), F.count_if(d & ~l).alias("fp"),
        F.count_if(~d & l).alias("fn"), F.count_if(~d & ~l).alias("tn"),
    )

    def share(part: Column, rest: Column) -> Column:
        return F.try_divide(part, part + rest).cast("double")

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        share(tp, fp).alias("precision"),
        share(tp, fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).cast("double").alias("f1"),
        share(fp, tn).alias("false_positive_rate"),
        share(fn, tp).alias("false_negative_rate"),
    )


def rule_coverage(df: DataFrame, rules_by_regulation: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """Share of a regulation's rules that the columns of a record set allow to monitor, with records covered."""
    rows = []
    for regulation, needs in rules_by_regulation.items():
        usable = sum(all(n in df.columns for n in need) for need in needs)
        rows.append(F.struct(
            F.lit(regulation).alias("regulation"), F.lit(usable).alias("monitored"), F.lit(len(needs)).alias("rules"),
            F.lit(usable / len(needs)).alias("coverage"), F.col("records").alias("records"),
        ))
    return df.agg(F.count("*").alias("records")).select(F.inline(F.array(*rows)))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of a column, from its value counts."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # H = log2(N) - sum(n log2 n) / N needs no second pass for N.
    return counts.agg(
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy")
    )


def entropy_loss(
    df: DataFrame, settings: Anonymization, columns: list[str], key: str = "id", secret: bytes = b"", seed: str = ""
) -> DataFrame:
    """Entropy before and after per column: all value counts in one grouped pass."""
    changed = an.changed_columns(df.schema, settings, secret, seed)
    pairs = []
    for c in columns:
        for side, value in (("original", F.col(c)), ("anonymized", changed.get(c, F.col(c)))):
            pairs.append(F.struct(F.lit(c).alias("field"), F.lit(side).alias("side"), value.cast("string").alias("value")))
    counts = (
        an.prepare(df, settings, key, seed).select(F.inline(F.array(*pairs))).groupBy("field", "side", "value").agg(F.count("*").alias("n"))
    )
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    sides = counts.groupBy("field").pivot("side", ["original", "anonymized"]).agg(h.alias("h"))
    return sides.select(
        "field", F.col("original").alias("entropy_original"), F.col("anonymized").alias("entropy_anonymized"),
        (F.col("original") - F.col("anonymized")).alias("entropy_loss"),
    )


def correlation_kept(
    df: DataFrame, settings: Anonymization, pairs: list[tuple[str, str]], key: str = "id", secret: bytes = b"", seed: str = ""
) -> DataFrame:
    """Pearson correlation before and after per column pair, in one aggregate."""
    changed = an.changed_columns(df.schema, settings, secret, seed)
    names = sorted({c for pair in pairs for c in pair})
    numbers = an.prepare(df, settings, key, seed).select(
        *[F.col(c).cast("double").alias(f"o_{c}") for c in names],
        *[changed.get(c, F.col(c)).cast("double").alias(f"n_{c}") for c in names],
    )
    aggregates = [
        F.corr(f"{side}_{a}", f"{side}_{b}").alias(f"{side}{i}") for i, (a, b) in enumerate(pairs) for side in "on"
    ]
    rows = [
        F.struct(
            F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"o{i}").alias("original"),
            F.col(f"n{i}").alias("anonymized"), F.abs(F.col(f"o{i}") - F.col(f"n{i}")).alias("difference"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return numbers.agg(*aggregates).select(F.inline(F.array(*rows)))


def query_accuracy(
    before: DataFrame, after: DataFrame, group: list[str], measure: Column, tolerance: float
) -> DataFrame:
    """Aggregate answers on original and anonymized records and whether they agree within a tolerance."""
    left = before.groupBy(*group).agg(measure.alias("original"))
    right = after.groupBy(*group).agg(measure.alias("anonymized"))
    joined = left.join(right, group, "full_outer")
    error = F.abs(F.col("original") - F.col("anonymized")) / F.nullif(F.abs(F.col("original")), F.lit(0.0))
    return joined.select(
        *group, "original", "anonymized", F.coalesce(error <= F.lit(tolerance), F.lit(False)).alias("accurate")
    )
