"""Group statistics and joins that stay even when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_group_stats(df: DataFrame, keys: list[str], **stats) -> DataFrame:
    """Aggregate per group and join the result back.

    Unlike a window this needs no sort of a whole group in one task: the aggregate combines
    map-side, and adaptive execution splits a hot partition of the row side of the join.
    NULL keys form groups of their own.
    """
    # One struct as join key: it is never NULL, and NULL fields inside compare equal.
    grouped = df.groupBy(*keys).agg(*[v.alias(n) for n, v in stats.items()])
    right = grouped.select(F.struct(*keys).alias("__key"), *stats)
    return df.select("*", F.struct(*keys).alias("__key")).join(right, "__key", "left").drop("__key")


def left_join_many(few: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Left join of a side with unique keys to one that may hold very many rows per key.

    Spark can split a hot partition of a left join on the preserved side only, and can broadcast
    only the other side. Written as an inner join plus the keys without partner, the big side may
    be split, or the small side broadcast. The keys of the big side are reduced before the anti join.
    """
    matched = many.join(few, key)
    alone = few.join(many.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
