"""Measured privacy: group sizes, suppression, risk, budgets and attack rates.

All measures work on group counts. Counting combines map-side, so a quasi-identifier group
that holds a third of all rows costs one small row per task, and no operator sorts or
collects the members of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkveil.operators import anonymize as an
from sparkveil.plans.numbering import running_sum

# One struct as join key: it is never NULL, and NULL fields inside compare equal.
_KEY = "__qi"


def _key(columns: list[str]) -> Column:
    return F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(_KEY)


def group_sizes(df: DataFrame, quasi_identifiers: list[str]) -> DataFrame:
    return df.groupBy(*quasi_identifiers).agg(F.count("*").alias("group_size"))


def k_level(df: DataFrame, quasi_identifiers: list[str], k: int) -> DataFrame:
    """Achieved k (smallest group), groups, records, and the records in groups below k."""
    n = F.col("group_size")
    return group_sizes(df, quasi_identifiers).agg(
        F.min(n).alias("k_level"), F.max(n).alias("largest_group"), F.count("*").alias("groups"),
        F.sum(n).alias("records"), F.coalesce(F.sum(F.when(n < k, n)), F.lit(0)).alias("records_below_k"),
    )


def reidentification_risk(df: DataFrame, quasi_identifiers: list[str]) -> DataFrame:
    """Risk 1/group size per record: its maximum and its mean (= groups / records)."""
    n = F.col("group_size")
    return group_sizes(df, quasi_identifiers).agg(
        (F.lit(1.0) / F.min(n)).alias("max_risk"),
        (F.count("*") / F.sum(n)).alias("mean_risk"),
        F.coalesce(F.sum(F.when(n == 1, n)), F.lit(0)).alias("unique_records"),
    )


def _free(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def flag_possible(df: DataFrame, quasi_identifiers: list[str], groups: DataFrame, bits: int, name: str) -> DataFrame:
    """`df` with a flag: false only for records whose group is surely not among `groups`.

    `groups` has the quasi-identifier struct as only column. Their bits go into words of 64, at most bits / 64 rows
    whatever the number of groups, so the table may be broadcast and is tested within the scan.
    """
    bit, word, filled = (_free(df, c) for c in ("__bit", "__word", "__set"))
    at = groups.select(F.pmod(F.xxhash64(_KEY), F.lit(bits)).alias(bit))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(bit) % 64).cast("int"))
    words = at.groupBy(F.floor(F.col(bit) / 64).alias(word)).agg(F.bit_or(one).alias(filled))
    cell = F.pmod(F.xxhash64(_key(quasi_identifiers)), F.lit(bits))
    tested = df.withColumn(bit, cell).withColumn(word, F.floor(F.col(bit) / 64))
    hit = F.coalesce(F.getbit(filled, F.col(bit) % 64) == 1, F.lit(False))
    return tested.join(F.broadcast(words), word, "left").select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(name))


def suppress(df: DataFrame, quasi_identifiers: list[str], k: int, bits: int = 1 << 22) -> DataFrame:
    """Records whose group has at least k members.

    A bit table of the groups below k is tested in the scan: only records that share a bit with such a group meet the
    anti join, the others are passed on without a shuffle. About (groups below k) / bits of the records in big groups
    share a bit by chance, so `bits` should be several times the number of groups below k; the result is the same with
    any number. The table takes bits / 64 rows of two numbers, 65,536 by default.
    """
    small = group_sizes(df, quasi_identifiers).filter(F.col("group_size") < k).select(_key(quasi_identifiers))
    maybe = _free(df, "__maybe")
    flagged = flag_possible(df, quasi_identifiers, small, bits, maybe)
    clear = flagged.where(~F.col(maybe)).drop(maybe)
    doubtful = flagged.where(F.col(maybe)).drop(maybe).select("*", _key(quasi_identifiers))
    return clear.unionByName(doubtful.join(small, _KEY, "left_anti").drop(_KEY))


def completeness(df: DataFrame, quasi_identifiers: list[str], k: int) -> DataFrame:
    """Share of records kept when groups below k are suppressed."""
    n = F.col("group_size")
    kept = F.coalesce(F.sum(F.when(n >= k, n)), F.lit(0))
    return group_sizes(df, quasi_identifiers).agg(
        F.sum(n).alias("records"), kept.alias("retained"), (kept / F.sum(n)).alias("completeness")
    )


def ladder_levels(schema: T.StructType, quasi_identifiers: list[str], ks=(None, 3, 5, 15)) -> list[dict[str, Column]]:
    """Quasi-identifiers per level: unchanged first, then the three rungs of the ladders."""
    levels = []
    for k in ks:
        changed = an.k_columns(schema, k) if k else {}
        levels.append({c: changed.get(c, F.col(c)).cast("string") for c in quasi_identifiers})
    return levels


def level_report(df: DataFrame, levels: list[dict[str, Column]], k: int) -> DataFrame:
    """Group statistics of every level in one scan: rows (level, groups, k_level, records, suppressed)."""
    names = list(levels[0])
    packed = [
        F.struct(F.lit(i).alias("level"), *[level[c].alias(c) for c in names]) for i, level in enumerate(levels)
    ]
    n = F.col("n")
    counted = df.select(F.inline(F.array(*packed))).groupBy("level", *names).agg(F.count("*").alias("n"))
    return counted.groupBy("level").agg(
        F.count("*").alias("groups"), F.min(n).alias("k_level"), F.sum(n).alias("records"),
        F.coalesce(F.sum(F.when(n < k, n)), F.lit(0)).alias("suppressed"),
    )


def generalize_to_k(
    df: DataFrame, levels: list[dict[str, Column]], k: int, max_suppressed: float = 0.01
) -> tuple[DataFrame, int]:
    """Lowest level whose groups below k hold at most `max_suppressed` of the records, then suppression.

    The report has one row per level, which is all the driver sees. If no level meets the
    share, the highest level is used and the rest is suppressed, so the result always has k.
    """
    report = {r["level"]: r for r in level_report(df, levels, k).collect()}
    chosen = len(levels) - 1
    for i in range(len(levels)):
        row = report.get(i)
        if row is not None and row["suppressed"] <= max_suppressed * row["records"]:
            chosen = i
            break
    names = list(levels[chosen])
    general = df.select(*[levels[chosen][c].alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])
    return suppress(general, names, k), chosen


def budget_ledger(
    spending: DataFrame, subject: str, order: list[str], epsilon: Column, allocated: float, ranges: int | None = None
) -> DataFrame:
    """Running epsilon per subject and whether a query goes over the allocation.

    Sums are exact decimals. `order` must be unique per subject. A subject with very many
    queries is split over time ranges instead of being sorted in one task.
    """
    ledger = running_sum(
        spending.select("*", epsilon.cast("decimal(18,6)").alias("epsilon")),
        order, {"spent": F.col("epsilon")}, partition=(subject,), ranges=ranges,
    )
    limit = F.lit(allocated).cast("decimal(18,6)")
    return ledger.select(
        "*", (limit - F.col("spent")).alias("remaining"), (F.col("spent") > limit).alias("over_budget")
    )


def budget_use(spending: DataFrame, subject: str, epsilon: Column, allocated: float) -> DataFrame:
    """Spent epsilon, share of the allocation and unused rest per subject."""
    limit = F.lit(allocated).cast("decimal(18,6)")
    spent = F.sum(epsilon.cast("decimal(18,6)"))
    return spending.groupBy(subject).agg(
        spent.alias("spent"),
        (spent.cast("double") / F.lit(float(allocated))).alias("utilization"),
        F.greatest(limit - spent, F.lit(0).cast("decimal(18,6)")).alias("conserved"),
    )


def linkage_rate(anonymized: DataFrame, external: DataFrame, quasi_identifiers: list[str]) -> DataFrame:
    """Share of anonymized records that match exactly one external record.

    Both sides are counted per group before the join, which then has unique keys.
    """
    left = anonymized.select(_key(quasi_identifiers)).groupBy(_KEY).agg(F.count("*").alias("released"))
    right = external.select(_key(quasi_identifiers)).groupBy(_KEY).agg(F.count("*").alias("known"))
    joined = left.join(right, _KEY, "left")
    linked = F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("released"))), F.lit(0))
    return joined.agg(
        F.sum("released").alias("records"), linked.alias("linked"),
        (linked / F.sum("released")).alias("linkage_rate"),
    )


def attribute_inference(df: DataFrame, quasi_identifiers: list[str], sensitive: str) -> DataFrame:
    """Accuracy of guessing the majority sensitive value per group, and of guessing it globally."""
    pairs = df.groupBy(*quasi_identifiers, sensitive).agg(F.count("*").alias("n"))
    per_group = pairs.groupBy(*quasi_identifiers).agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    guessed = per_group.agg(F.sum("best").alias("hits"), F.sum("size").alias("records"))
    overall = pairs.groupBy(sensitive).agg(F.sum("n").alias("n")).agg(F.max("n").alias("top"))
    top = overall.scalar()
    return guessed.select(
        "records", (F.col("hits") / F.col("records")).alias("accuracy"),
        (top / F.col("records")).alias("baseline_accuracy"),
    )


def membership_inference(
    candidates: DataFrame, released: DataFrame, value: str, member: str, threshold: int
) -> DataFrame:
    """Attack "a released value lies within `threshold`": confusion counts and accuracy.

    `value` holds whole units (say cents). Released values are reduced to the smallest and
    largest value per bucket of width `threshold`; a candidate then needs its own and the two
    neighbouring buckets only. That is exact and no pair of records is ever formed.
    """
    width = F.lit(threshold)
    bucket = F.floor(F.col(value) / width).cast("bigint")
    edges = released.groupBy(bucket.alias("b")).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    # Each edge row serves the own bucket and, shifted, both neighbours: one join instead of three.
    reach = edges.select(
        F.inline(F.array(
            F.struct(F.col("b").alias("b"), F.lit(True).alias("own"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")),
            F.struct((F.col("b") + 1).alias("b"), F.lit(False).alias("own"), F.lit(None).cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high")),
            F.struct((F.col("b") - 1).alias("b"), F.lit(False).alias("own"), F.col("low").cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")),
        ))
    ).groupBy("b").agg(F.bool_or("own").alias("own"), F.min("low").alias("above"), F.max("high").alias("below"))
    near = (
        F.col("own")
        | (F.col("above") - F.col(value) <= width)
        | (F.col(value) - F.col("below") <= width)
    )
    joined = candidates.select(F.col(value), F.col(member).alias("m"), bucket.alias("b")).join(reach, "b", "left")
    guessed = joined.select("m", F.coalesce(near, F.lit(False)).alias("g"))
    g, m = F.col("g"), F.col("m")
    return guessed.agg(
        F.count_if(g & m).alias("tp"), F.count_if(g & ~m).alias("fp"),
        F.count_if(~g & m).alias("fn"), F.count_if(~g & ~m).alias("tn"),
        F.avg((g == m).cast("double")).alias("accuracy"),
    )
