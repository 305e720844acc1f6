"""Files in: CSV with declared or detected schema, multi-run folders, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkveil import schemas as sc
from sparkveil.sources import rejects as rj
from sparkveil.sources.rejects import TRUE_TEXTS

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema the types are inferred from all rows, so that every value fits."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with all columns as text: reads the header line only until an action runs."""
    return spark.read.option("header", True).csv(path)


@dataclass(frozen=True)
class LoadReport:
    """How a file fits its schema. `tagged` has the rows with what could not be read, in one pass over the file."""

    schema_name: str | None
    matched: bool
    missing: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    tagged: DataFrame | None = None

    @property
    def rejects(self) -> DataFrame | None:
        """(file, key, column, value, reason) per value, or per line without a column, that could not be read."""
        return None if self.tagged is None else rj.channel(self.tagged, ("file", "key"))

    @property
    def counts(self) -> DataFrame | None:
        """(column, reason, rejects)."""
        return None if self.tagged is None else rj.counts(self.tagged)


def conform(df: DataFrame, schema: sc.Schema, rejects: str | None = None) -> DataFrame:
    """Columns in schema order with declared types; unreadable values become NULL.

    Dates and date texts of timestamp fields become timestamps, and flags are the accepted texts. With `rejects`, a
    column of that name lists what could not be read, as (column, value, reason), values missing from required
    fields included; it is empty for a row that was read whole.
    """
    columns, tests = [], []
    for f in schema.spark().fields:
        text = F.nullif(F.col(f"`{f.name}`").cast("string"), F.lit(""))
        value = rj.from_text(text, f.dataType)
        tests.append((text.isNotNull() & value.isNull(), rj.reject(f.name, text, f"not a {f.dataType.simpleString()}")))
        if not f.nullable:
            tests.append((text.isNull(), rj.reject(f.name, text, "missing")))
        columns.append(value.alias(f.name, metadata=f.metadata))
    if rejects:
        columns.append(rj.listed(*tests).alias(rejects))
    return df.select(*columns)


def as_boolean(value):
    """True for the accepted texts, NULL stays NULL, everything else is false."""
    return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(value.cast("string").isin(*TRUE_TEXTS))


def _read_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All columns as text, with the file, and the whole line in CORRUPT where its width differs from the header."""
    wide = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    # Without pruning, a line is parsed whole whatever columns are asked for, so its width is always seen.
    return reader.option("columnPruning", False).schema(wide).csv(path).select("*", F.col("_metadata.file_path").alias("file"))


def load_checked(spark: SparkSession, path: str) -> tuple[DataFrame, LoadReport]:
    """Load a CSV under the schema its path or header points to.

    With equal column sets the declared types are applied: a value that does not fit is NULL in the rows and stands
    in the report's rejects, and a line that is too short or too long stands there as a whole. Otherwise types are
    inferred and the difference is reported.
    """
    raw = read_csv_text(spark, path)
    name = sc.choose(path, raw.columns)
    schema = sc.REGISTRY.get(name)
    if schema is None:
        return read_csv(spark, path), LoadReport(None, False)
    missing = tuple(c for c in schema.names if c not in raw.columns)
    extra = tuple(c for c in raw.columns if c not in schema.names)
    if missing or extra:
        return read_csv(spark, path), LoadReport(name, False, missing, extra)
    tagged = _tagged(_read_lines(spark, path, raw.columns), schema)
    rows = tagged.where("whole").select(*schema.names)
    return rows, LoadReport(name, True, tagged=tagged.drop("whole"))


def _tagged(lines: DataFrame, schema: sc.Schema) -> DataFrame:
    """The declared columns with (file, key, _rejects, whole) of each line; a line of another width has no values."""
    first = schema.names[0]
    # The reader refuses a query of the corrupt column alone, as a count of the rows would be: another column takes part.
    torn = F.coalesce(F.col(CORRUPT), F.nullif(F.col(f"`{first}`"), F.col(f"`{first}`")))
    carried = conform(lines.withColumns({"__torn": torn}), _with_texts(schema, ("file", "__torn")), rejects="__found")
    line = rj.listed((F.col("__torn").isNotNull(), rj.reject(F.lit(None).cast("string"), F.col("__torn"), "number of fields")))
    whole = F.col("__torn").isNull()
    return carried.select(
        *[F.when(whole, F.col(f"`{n}`")).alias(n, metadata=f.metadata) for n, f in zip(schema.names, schema.spark().fields)],
        "file", F.when(whole, F.col(f"`{first}`").cast("string")).alias("key"),
        F.when(whole, F.col("__found")).otherwise(line).alias(rj.REJECTS), whole.alias("whole"),
    )


def _with_texts(schema: sc.Schema, names: tuple[str, ...]) -> sc.Schema:
    return sc.Schema(schema.name, schema.data_type, (*schema.fields, *[sc.Field(n) for n in names]))


def coerce(df: DataFrame) -> DataFrame:
    """Types of the common fields: times to timestamps, flag texts to booleans (never NULL)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    changes = {}
    for c in ("treatment_date", "timestamp"):
        if c in types and not isinstance(types[c], (T.TimestampType, T.TimestampNTZType)):
            changes[c] = F.try_to_timestamp(F.col(c).cast("string"))
    for c in ("has_violation", "has_violations"):
        if c in types:
            changes[c] = F.coalesce(as_boolean(F.col(c)), F.lit(False))
    return df.select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and the text 'nan' are missing values after loading."""
    out = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        elif isinstance(f.dataType, T.StringType):
            value = F.when(F.lower(value) != "nan", value)
        out.append(value.alias(f.name))
    return df.select(*out)


def read_runs(spark: SparkSession, root: str, file_name: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """One result file over all `*run-*` folders: good rows with their folder, and misaligned rows.

    Rows whose width differs from the schema are kept apart, with their raw text, instead of
    being shifted.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .schema(wide).csv(f"{root}/*run-*/{file_name}")
        .withColumn("run", F.regexp_extract(F.input_file_name(), r"/([^/]*run-[^/]*)/", 1))
    )
    bad = F.col(CORRUPT).isNotNull()
    return rows.filter(~bad).drop(CORRUPT), rows.filter(bad)


def fingerprints(spark: SparkSession, path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """SHA-256 and size of every file below a path.

    The listing carries no content; each file is then read in chunks by the task that owns it,
    so memory does not depend on file size. Spark's file scan leaves empty files out.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            hashes = []
            for uri in batch["path"]:
                filesystem, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                state = hashlib.sha256()
                with filesystem.open_input_stream(name) as stream:
                    while chunk := stream.read(chunk_bytes):
                        state.update(chunk)
                hashes.append(state.hexdigest())
            yield batch.assign(file_hash=hashes)

    return listing.mapInPandas(digest, "path string, length long, file_hash string")


def stored_name(original, loaded_at):
    """File name with a time prefix, as uploads are stored."""
    return F.concat(F.date_format(loaded_at, "yyyyMMdd_HHmmss"), F.lit("_"), original)
