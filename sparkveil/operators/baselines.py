"""Baselines stored by ranges of hashed ids, with a tree of digests that tells which ranges differ.

The SHA-256 of an id deals records evenly over 16^DIGITS ranges, whatever the ids look like. Records are stored in a
folder per range; beside them stands a tree: a digest of the record hashes per range, and above it a digest of up
to 16 digests per node. Two baselines are compared from the root down, so only nodes below a difference are looked
at, and only the folders of ranges that differ are read and joined.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkveil.functions.hashing import record_hash
from sparkveil.operators.integrity import DIFF, as_events, field_diff, keyed, multiset_digest

#: Hex digits of a range: 256 ranges here; four (65,536 ranges) suit some 10^11 records.
DIGITS = 2


def range_of(record_id: Column, digits: int = DIGITS) -> Column:
    """Number of the range an id belongs to."""
    return F.conv(F.substring(F.sha2(record_id, 256), 1, digits), 16, 10).cast("int")


def store(df: DataFrame, path: str, id_column: str = "record_id", digits: int = DIGITS, secret: bytes | None = None) -> None:
    """Write `df` as a baseline: `records` by range, then `tree`, whose presence says that the baseline is whole.

    Records are brought together by range with a rebalance, which splits a range that is far bigger than the others.
    With a secret the digests are keyed.
    """
    fields = [c for c in df.columns if c != id_column]
    record_id = F.col(f"`{id_column}`").cast("string")
    rows = df.select(
        range_of(record_id, digits).alias("node"), record_id.alias("record_id"), record_hash(df.schema).alias("record_hash"),
        F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in fields]).alias("fields"),
    )
    rows.hint("rebalance", "node").write.partitionBy("node").parquet(f"{path}/records")
    spark = df.sparkSession
    spark.range(1).select(F.lit(rows.schema.json()).alias("schema")).write.parquet(f"{path}/schema")
    stored = _records(spark, path)
    own = F.col("record_hash") if secret is None else keyed(F.col("record_hash"), secret)
    level = stored.groupBy("node").agg(F.count("*").alias("records"), multiset_digest(own).alias("digest"))
    out = level.select(F.lit(digits).alias("level"), "node", "records", "digest")
    for depth in reversed(range(digits)):
        below = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])))
        level = level.groupBy(F.shiftright("node", 4).alias("node")).agg(F.sum("records").alias("records"), F.sha2(below, 256).alias("digest"))
        out = out.union(level.select(F.lit(depth).alias("level"), "node", "records", "digest"))
    out.coalesce(1).write.parquet(f"{path}/tree")  # at most 16/15 rows for each range


def _records(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()[0]))  # an empty baseline has no files to tell it
    return spark.read.schema(schema).parquet(f"{path}/records")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(level, node, records, digest); level 0 is the root, the highest level the ranges."""
    return spark.read.parquet(f"{path}/tree")


def _levels(spark: SparkSession, path: str) -> int:
    return tree(spark, path).agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]


def changed_ranges(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(node, old_records, new_records) of the ranges whose digests differ, found from the root down."""
    depth = max(_levels(spark, old), _levels(spark, new))
    a = tree(spark, old).select("level", "node", F.col("digest").alias("old_digest"), F.col("records").alias("old_records"))
    b = tree(spark, new).select("level", "node", F.col("digest").alias("new_digest"), F.col("records").alias("new_records"))
    both = a.join(b, ["level", "node"], "full_outer").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    found = both.where("level = 0")
    for level in range(1, depth + 1):
        above = found.select(F.col("node").alias("above"))
        found = both.where(F.col("level") == level).join(above, F.shiftright("node", 4) == F.col("above"), "left_semi")
    zero = F.lit(0).cast("bigint")
    return found.select("node", F.coalesce("old_records", zero).alias("old_records"), F.coalesce("new_records", zero).alias("new_records"))


def report(spark: SparkSession, old: str, new: str) -> DataFrame:
    """One row (ranges, changed_ranges, records, records_read): what `changes` reads of the two baselines, from their trees alone."""
    depth = max(_levels(spark, old), _levels(spark, new))
    leaves = tree(spark, old).union(tree(spark, new)).where(F.col("level") == depth)
    everything = leaves.agg(F.countDistinct("node").alias("ranges"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    changed = changed_ranges(spark, old, new).agg(
        F.count("*").alias("changed_ranges"), F.coalesce(F.sum(F.col("old_records") + F.col("new_records")), F.lit(0)).alias("records_read")
    )
    return everything.join(F.broadcast(changed)).select("ranges", "changed_ranges", "records", "records_read")  # two single rows


def read_ranges(spark: SparkSession, path: str, nodes: list[int]) -> DataFrame:
    """The records of some ranges: their folders only, by partition pruning."""
    return _records(spark, path).where(F.col("node").isin(nodes) if nodes else F.lit(False))


def changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Change events between two stored baselines, as `integrity.detect_changes` gives them, with `copies`.

    Only ranges that differ are read; their numbers, at most 16^DIGITS, come to the driver. Equal copies of a record
    are counted before the one full outer join, so an event stands for `copies` rows of the same content. Ids of the
    old baseline are unique.
    """
    nodes = [r.node for r in changed_ranges(spark, old, new).select("node").collect()]

    def side(path: str, prefix: str) -> DataFrame:
        rows = read_ranges(spark, path, nodes).groupBy("node", "record_id", "record_hash", "fields").agg(F.count("*").alias("n"))
        return rows.select("node", "record_id", *[F.col(c).alias(f"{prefix}_{t}") for c, t in (("record_hash", "hash"), ("fields", "fields"), ("n", "n"))])

    a, b = side(old, "old"), side(new, "new")
    joined = a.join(b, ["node", "record_id"], "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "record_added").when(F.col("new_hash").isNull(), "record_deleted").otherwise("record_modified")
    before, after = ({c: F.col(f"{p}_fields.`{c}`") for c in df.schema[f"{p}_fields"].dataType.names} for p, df in (("old", a), ("new", b)))
    diff = F.when(F.col("old_hash").isNotNull() & F.col("new_hash").isNotNull(), field_diff(before, after)).otherwise(F.lit(None).cast(DIFF))
    copies = F.coalesce("new_n", "old_n")
    return as_events(joined.select("record_id", "old_hash", "new_hash", kind.alias("change_type"), diff.alias("affected_fields"), copies.alias("copies")), "copies")
