"""Exact deduplication by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import SPACES, materialize, plain_documents


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def exact_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of `docs`.

    `content_hash` takes the normalised text. Rows are grouped by it together with the whole text, so
    the engine compares bytes; the hash only places the groups. A text is counted inside each task before
    it travels, so a group with a third of the rows sends one row per task. Rows then find their group by
    hash, or, for hashes that more than one text has, by hash and text.

    Null text counts as empty. Null doc_ids take part; keep_id is null only where a group has no other.
    A row that repeats the kept doc_id and text is kept like its twin. Other columns are ignored. An
    empty table gives no rows.
    """
    texts = plain_documents(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    hashed = texts.select("doc_id", "norm", content_hash(F.col("norm")).alias("hash"))
    groups = hashed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-groups")
    shared = groups.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash")
    rows = hashed.select("doc_id", "hash")
    if shared.isEmpty():
        found = rows.join(groups, "hash")
    else:  # different texts with one hash: tell them apart by their text's SHA-256 as well
        rows = hashed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
        found = rows.join(groups, ["hash", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that `exact_duplicates` drops; all columns stay. Rows with null doc_id go."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
