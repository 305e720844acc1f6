"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, secret scan, best-fit packing.

Each stage works on all rows its predecessor kept and is written as Parquet before the next reads it. All but
the last return the columns of `documents`; the last returns a row per packed piece. Stages that drop rows or
lines decide by a key of the row, with doc_id only as order, so repeated and null ids are handled row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import line_dedup, packing, quality, secret_scan, simhash
from sparkveil.llm.common import ROW_KEY, materialize, ready, with_row_keys
from sparkveil.views import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; every row is judged by its own text, also where doc_ids repeat or are null."""
    keyed = with_row_keys(docs)
    scores = quality.quality_scores(keyed, table(spark, sf_dir, "labels"), ROW_KEY)
    rejected = scores.where("predicted = 0").select(F.col(ROW_KEY).alias("rejected"))
    return keyed.join(rejected, keyed[ROW_KEY] == rejected["rejected"], "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one."""
    return line_dedup.drop_lines(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first with the smallest id, or without id where none has one."""
    keyed = with_row_keys(docs)
    groups = simhash.near_duplicates(keyed.select(F.col(ROW_KEY).alias("doc_id"), "text"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    return keyed.join(gone, keyed[ROW_KEY] == gone["gone"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with the sequence and place it is packed at."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: No stage but the line dedup can be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
