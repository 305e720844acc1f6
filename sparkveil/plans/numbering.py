"""Running sums and row numbers that never put one ordering into one task.

A window without PARTITION BY, or with one hot key, sorts everything in a single task. Here the ordering is cut
into ranges first. The range limits come from a sample: rows whose key hashes below a share of the hash space that
makes about SAMPLES_PER_RANGE of them per range, so a recomputed task finds the same rows. The sample is an
aggregate of the plan (a scalar subquery over the key columns), not a job of its own, and a row finds its range by
a binary search in it. Limits need not be exact for the result to be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLES_PER_RANGE = 16


def _range_limits(df: DataFrame, unique: list[str], order: list[str], ranges: int) -> Column:
    """Sorted array of about `ranges` keys, as a scalar subquery; `unique` columns tell the rows apart.

    The hash of a unique key is even, so the sample has the wanted size whatever the distribution of the keys.
    """
    share = F.lit(float(ranges * SAMPLES_PER_RANGE)) / df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    draw = F.shiftrightunsigned(F.xxhash64(*unique), 1) / F.lit(float(1 << 63))
    keys = df.where(draw < share).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("keys"))
    every = F.greatest(F.lit(1), F.size("keys").cast("int") / F.lit(ranges)).cast("int")
    return keys.select(F.filter("keys", lambda _, i: (i + 1) % every == 0)).scalar()


def _with_range(df: DataFrame, limits: Column, order: list[str], ranges: int, name: str) -> DataFrame:
    """`df` with the number of limits at or below its key: a binary search, a projection for each halving step.

    There are fewer than twice `ranges` limits, since they are every n-th key for the largest n that leaves `ranges`.
    """
    key, at = F.struct(*order), F.col(name)
    out = df.select("*", limits.alias("__limits"), F.lit(0).alias(name))  # read once, passed on by reference within the stage
    for step in (1 << i for i in reversed(range((2 * ranges).bit_length()))):
        out = out.withColumn(name, at + F.when(F.get("__limits", at + (step - 1)) <= key, step).otherwise(0))
    return out.drop("__limits")


def running_sum(
    df: DataFrame,
    order: list[str],
    sums: dict[str, Column],
    partition: tuple[str, ...] = (),
    ranges: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums along `order` (which must be unique within a partition).

    Three cheap steps: totals per (partition, range) with map-side combine, offsets from
    those totals, and a window inside each range. A key that holds a third of all rows is
    still spread over all ranges. Nothing runs before the action; it reads the order columns three times
    (count, sample, totals) and the other columns once.
    """
    if ranges is None:
        ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limits = _range_limits(df, [*partition, *order], order, ranges)
    # One struct as partition key: never NULL itself and NULL fields compare equal, so the
    # join and the window share one shuffle.
    key_columns = [F.struct(*partition).alias("__p")] if partition else []
    cut = _with_range(df, limits, order, ranges, "__r").select(
        "*",
        *key_columns,
        *[value.alias(f"__v_{name}") for name, value in sums.items()],
    )
    outer = ["__p"] if partition else []
    keys = [*outer, "__r"]
    totals = cut.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*outer).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    if not partition:
        offsets = F.broadcast(offsets)  # fewer than 2 * ranges rows
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    results = [
        (F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n) for n in sums
    ]
    return cut.join(offsets, keys, "left").select(*[c for c in df.columns if c not in sums], *results)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number", ranges: int | None = None) -> DataFrame:
    """Global 1-based row number along a unique order."""
    return running_sum(df, order, {name: F.lit(1).cast("bigint")}, ranges=ranges)


def batch_numbers(df: DataFrame, order: list[str], size: int = 1000, name: str = "processing_batch") -> DataFrame:
    """Number of the batch of `size` rows a row falls in, counted from 1."""
    numbered = row_numbers(df, order, "__n")
    return numbered.select(*df.columns, F.ceil(F.col("__n") / F.lit(size)).cast("bigint").alias(name))
