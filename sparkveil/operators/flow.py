"""Check, anonymize and tag records: the same projection for tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkveil.config import Anonymization
from sparkveil.operators import anonymize as an, compliance as co


def process(
    df: DataFrame, data_type: str, settings: Anonymization, via: str, processed_at: Column, key: str = "id",
    secret: bytes = b"", seed: str = "", unconditional: bool = False,
) -> DataFrame:
    """Records with violations, anonymized where they violate, with provenance.

    The rules run once per record; anonymization reads the original values next to the result.
    """
    checked = df.select("*", co.violations(df, data_type).alias("violations"))
    bad = F.size("violations") > 0
    safe = an.anonymize(checked, settings, key, secret, seed, where=None if unconditional else bad)
    tagged = an.with_provenance(safe, settings, via, processed_at, F.lit(True) if unconditional else bad)
    return tagged.select("*", bad.alias("has_violations"), (~bad).alias("is_compliant"))


def grid_records(
    df: DataFrame, settings: list[Anonymization], fields: list[str], key: str = "id", secret: bytes = b"", seed: str = ""
) -> DataFrame:
    """Every record under every setting, as one expansion of the scan: rows (setting, key, fields as text)."""
    versions, prepared = [], df
    for s in settings:
        prepared = an.prepare(prepared, s, key, seed)
        changed = an.changed_columns(df.schema, s, secret, seed)
        versions.append(F.struct(
            F.lit(s.label).alias("setting"), *[changed.get(c, F.col(c)).cast("string").alias(c) for c in fields]
        ))
    return prepared.select(key, F.inline(F.array(*versions)))


def map_records(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Last resort for a rule that cannot be written as columns: a function of Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)
