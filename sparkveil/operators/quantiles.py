"""Exact quantiles of very many groups without sorting a group.

`percentile` holds the values of a group in one task and `percentile_approx` is off by a share of the rank. Here a
value becomes a whole number of 64 bits in the same order, and four counting passes fix 16 bits each of the value at
every wanted rank: a pass counts the rows that share the bits found so far by their next 16 bits. Counts combine
map-side, so a group that holds a third of all rows sends at most 65,536 counts per task, and no window sees more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

_BITS, _STEP = 64, 16
_MANTISSA = 1 << 52  # of a double


def ordered_bits(value: Column, kind: T.DataType) -> Column:
    """Whole number in the order of the values; equal values (0.0 and -0.0 too) have equal numbers.

    Floating values are laid out by exponent, then mantissa, below zero mirrored; infinities and NaN come last, NaN the greatest.
    """
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        raise TypeError(f"exact quantiles need whole or floating numbers, not {kind.simpleString()}")
    x = F.abs(value.cast("double"))
    two = F.lit(2.0)
    near = F.floor(F.log2(x)).cast("int")  # may be one off beside a power of two
    power = near + F.when(x < F.pow(two, near), -1).when(x >= F.pow(two, near + 1), 1).otherwise(0)
    whole = (power + 1023).cast("bigint") * _MANTISSA + ((x / F.pow(two, power) - 1) * float(_MANTISSA)).cast("bigint")
    half = F.pow(two, F.lit(537))
    size = (
        F.when(F.isnan(x), F.lit(2047 * _MANTISSA + 1)).when(x == float("inf"), F.lit(2047 * _MANTISSA))
        .when(x < F.pow(two, F.lit(-1022)), (x * half * half).cast("bigint")).otherwise(whole)
    )
    return F.when(value < 0, -size).otherwise(size)


def _ranks(total: Column, shares: list[float]) -> Column:
    """Ranks (from 0) between which the shares lie, each with the rank that is left to go."""
    at = [(total - 1) * F.lit(float(share)) for share in shares]
    ranks = F.array_distinct(F.array(*[F.floor(a) for a in at], *[F.ceil(a) for a in at]))
    return F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("rest")))


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(*keys, one column per share): values at the shares, between two ranks in proportion, as doubles.

    NULL values take no part; a group without values has no row; NULL keys are groups of their own. Without keys the
    whole table is one group. Whole numbers beyond 2^53 are rounded to doubles only after they are found. The input is
    read four times, three of them joined with the bits found so far: at most two rows per group and share.
    """
    if not shares or not all(0 <= s <= 1 for s in shares.values()):
        raise ValueError("shares lie between 0 and 1")
    kind = df.schema[value].dataType
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(
        group.alias("g"), ordered_bits(F.col(value), kind).alias("b"), F.col(value).cast("double").alias("v")
    )
    found = None
    for known in range(0, _BITS, _STEP):
        left = _BITS - known - _STEP
        following = F.shiftright("b", left).alias("next")
        if found is None:
            counted = rows.groupBy("g", following).agg(F.count("*").alias("n"))
            counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy("g")))
            counted = counted.select("*", F.lit(0).alias("head"), _ranks(F.col("total"), list(shares.values())).alias("open"))
        else:
            near = rows.withColumn("head", F.shiftright("b", _BITS - known)).join(found, ["g", "head"])
            values = [] if left else [F.min("v").alias("v")]  # the bits are whole: one value each
            counted = near.groupBy("g", "head", "total", "open", following).agg(F.count("*").alias("n"), *values)
        upto = F.sum("n").over(Window.partitionBy("g", "head").orderBy("next"))
        placed = counted.withColumn("before", upto - F.col("n"))
        moved = F.transform("open", lambda o: F.struct(o["rank"].alias("rank"), (o["rest"] - F.col("before")).alias("rest")))
        found = placed.withColumn("open", F.filter(moved, lambda o: (o["rest"] >= 0) & (o["rest"] < F.col("n"))))
        found = found.where(F.size("open") > 0).select("g", F.col("next").alias("head"), "total", "open", *([] if left else ["v"]))
    pairs = found.select("g", "total", "v", F.explode("open.rank").alias("rank")).groupBy("g", "total").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")  # at most two entries per share
    )
    out = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.col("at")[F.floor(at)], F.col("at")[F.ceil(at)]
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return pairs.select(*[F.col("g")[k].alias(k) for k in keys], *out)
