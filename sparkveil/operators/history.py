"""Histories by record: versions with the time each was valid, and who made them under the name of that time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkveil.plans.numbering import running_sum


def numbered(changes: DataFrame, key: str, at: str, change: str, name: str = "version") -> DataFrame:
    """Changes with their number within the key, by time and then by change id; one key with most changes is spread over ranges."""
    return running_sum(changes, [at, change], {name: F.lit(1).cast("bigint")}, partition=(key,))


def intervals(changes: DataFrame, key: str, at: str, change: str) -> DataFrame:
    """Changes with `version`, `valid_from` and `valid_to` (NULL for the newest).

    The end of a version is the start of the next one, found by an equi-join on key and number instead of a window
    over the key, so a busy key is dealt over all partitions.
    """
    own = numbered(changes, key, at, change)
    following = own.select(F.col(key).alias("__k"), (F.col("version") - 1).alias("__v"), F.col(at).alias("valid_to"))
    joined = own.join(following, F.col(key).eqNullSafe(F.col("__k")) & (F.col("version") == F.col("__v")), "left")
    return joined.select(*changes.columns, "version", F.col(at).alias("valid_from"), "valid_to")


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """Rows with the value that was valid for their key at their time; NULL before the first version.

    `versions` has (key, value, valid_from, valid_to) with intervals that do not overlap, so a row meets at most one.
    """
    side = versions.select(F.col(key).alias("__k"), F.col(value).alias(name), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    inside: Column = (F.col(at) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(at) < F.col("__to")))
    return rows.join(side, (F.col(key) == F.col("__k")) & inside, "left").select(*rows.columns, name)


def record_history(changes: DataFrame, names: DataFrame, record: str, at: str, change: str, user: str) -> DataFrame:
    """All versions of all records, newest first within a record, with the user's name at the time of the change.

    `names` has a row per user and name: (user, name, since, name_id); a user may have borne several.
    """
    versions = intervals(changes, record, at, change)
    borne = intervals(names.select(user, "name", "since", "name_id"), user, "since", "name_id")
    return as_of(versions, borne, user, at, "name", "username").orderBy(record, F.desc("version"))
