"""Tests and correlations from grouped moments.

The data is reduced to counts, means and variances per group in Spark; what is left to do
by formula are single rows. Distribution functions are small numeric helpers on those rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkveil.plans.numbering import running_sum
from sparkveil.session import run_dir

BLOCK_GROUPS = 1_000  # groups of a block of the pairwise comparison
PRECISION = 1e-22  # squared residual, against the first one, at which the two-way fit ends


def _tails():
    """Tail probabilities; of Student's t within 10^-6 of the normal limit at 5 * 10^8 degrees of freedom and 10^-5 at 5 * 10^10. Local functions travel to tasks by value, so tasks need no copy of the package."""

    def beta_fraction(a: float, b: float, x: float) -> float:
        """Continued fraction of the incomplete beta function (modified Lentz); it takes some sqrt(a + b) steps."""
        tiny = 1e-300

        def away(v: float) -> float:
            return v if abs(v) > tiny else tiny

        c, d = 1.0, 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
        h, m, change = d, 0, 2.0
        while abs(change - 1.0) >= 1e-13 and m < 10_000 + 50 * math.sqrt(a + b):
            m += 1
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for step in (even, odd):
                d = 1.0 / away(1.0 + step * d)
                c = away(1.0 + step / c)
                change = d * c
                h *= change
        return h

    def stirling_rest(x: float) -> float:
        """lgamma(x) less (x - 1/2) log x - x + log(2 pi) / 2, without cancellation for large x."""
        if x < 16.0:
            return math.lgamma(x) - ((x - 0.5) * math.log(x) - x + 0.5 * math.log(2.0 * math.pi))
        y = 1.0 / (x * x)
        return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x

    def deviance(x: float, mean: float, gap: float) -> float:
        """x log(x / mean) + mean - x, by its series where the two are close; `gap` is x - mean."""
        v = gap / (x + mean)
        if abs(v) > 0.1:
            return x * math.log(x / mean) + mean - x
        total, power, n = gap * v, 2.0 * x * v, 1
        while True:
            power *= v * v
            n += 2
            if total + power / n == total:
                return total
            total += power / n

    def incomplete_beta(a: float, b: float, x: float, y: float) -> float:
        """Regularized, with y = 1 - x given apart; the factor in front follows Loader (2000), exact for huge a and b."""
        if x <= 0.0:
            return 0.0
        if y <= 0.0:
            return 1.0
        n, gap = a + b, a * y - b * x  # gap: a less its mean n x
        height = stirling_rest(n) - stirling_rest(a) - stirling_rest(b) - deviance(a, n * x, gap) - deviance(b, n * y, -gap)
        front = math.exp(height) * math.sqrt(a * b / (2.0 * math.pi * n))
        if x < (a + 1.0) / (n + 2.0):
            return min(1.0, front * beta_fraction(a, b, x) / a)
        return max(0.0, 1.0 - front * beta_fraction(b, a, y) / b)

    def student(t: float, df: float) -> float:
        """Two-sided p-value of Student's t."""
        return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))

    def fisher(f: float, d1: float, d2: float) -> float:
        return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)) if f > 0 else 1.0

    def studentized_range(q: float, k: float, df: float) -> float:
        """Upper tail, by quadrature over the range and the scale."""
        z = np.linspace(-8.0, 8.0, 801)
        density = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)

        def normal(x):
            return 0.5 * (1.0 + np.vectorize(math.erf)(x / math.sqrt(2.0)))

        lower = normal(z)

        def below(w: float) -> float:
            return float(np.trapezoid(k * density * (lower - normal(z - w)) ** (k - 1), z))

        half = 8.0 / math.sqrt(2.0 * df)
        s = np.linspace(max(1e-3, 1.0 - half), 1.0 + half, 121)
        u = s - 1.0
        log_density = 0.5 * math.log(df / 2.0) - 0.5 * math.log(2.0 * math.pi) - stirling_rest(df / 2.0) + math.log(2.0) - np.log(s) + df * (np.log1p(u) - u - u * u / 2.0)
        mixed = np.exp(log_density) * np.array([below(q * x) for x in s])
        return max(0.0, 1.0 - float(np.trapezoid(mixed, s)))

    return student, fisher, studentized_range


t_p_value, f_p_value, studentized_range_p = _tails()


def _per_row(tail, *columns: str) -> Column:
    """A tail probability over the few rows of a test result."""

    @F.pandas_udf("double")
    def apply(*values: pd.Series) -> pd.Series:
        rows = zip(*values)
        return pd.Series([tail(*r) if all(v == v and v is not None for v in r) else None for r in rows], dtype="float64")

    return apply(*[F.col(c).cast("double") for c in columns])


def _moments(df: DataFrame, value: str, group: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull()).groupBy(F.col(group).alias("g")).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var")
    )


def t_test(df: DataFrame, value: str, group: str, first: str, second: str, equal_variance: bool = True) -> DataFrame:
    """Two-sample t-test (pooled, or Welch) with Cohen's d."""
    moments = _moments(df.filter(F.col(group).isin(first, second)), value, group)

    def of(name: str, which: str) -> Column:
        return F.max(F.when(F.col("g") == which, F.col(name)))

    row = moments.agg(*[of(n, w).alias(f"{n}{i}") for i, w in ((1, first), (2, second)) for n in ("n", "mean", "var")])
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    difference = F.col("mean1") - F.col("mean2")
    if equal_variance:
        t = difference / F.sqrt(pooled * (1 / n1 + 1 / n2))
        freedom = (n1 + n2 - 2).cast("double")
    else:
        a, b = v1 / n1, v2 / n2
        t = difference / F.sqrt(a + b)
        freedom = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    tested = row.select(F.col("mean1"), F.col("mean2"), t.alias("t"), freedom.alias("df"), (difference / F.sqrt(pooled)).alias("cohens_d"))
    return tested.select("mean1", "mean2", "t", "df", _per_row(t_p_value, "t", "df").alias("p_value"), "cohens_d")


def _within(moments: DataFrame) -> DataFrame:
    """Sums of squares from group moments: one row."""
    n, mean = F.col("n"), F.col("mean")
    grand = moments.agg((F.sum(n * mean) / F.sum(n)).alias("grand")).scalar()
    return moments.select("*", grand.alias("grand")).agg(
        F.sum(n * (mean - F.col("grand")) ** 2).alias("ss_between"), F.sum((n - 1) * F.col("var")).alias("ss_within"),
        F.count("*").alias("groups"), F.sum(n).alias("n"),
    )


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance with eta squared."""
    sums = _within(_moments(df, value, group))
    between, within = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    table = sums.select(
        "ss_between", "ss_within", between.alias("df_between"), within.alias("df_within"),
        ((F.col("ss_between") / between) / (F.col("ss_within") / within)).alias("f"),
        (F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))).alias("eta_squared"),
    )
    return table.select("*", _per_row(f_p_value, "f", "df_between", "df_within").alias("p_value"))


def _written(df: DataFrame, label: str) -> DataFrame:
    """A table of one step, written to the shared folder so that the plan of the next step begins with a scan."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _components(cells: DataFrame, levels: DataFrame) -> int:
    """Parts of a design that share no level: the smallest level number reachable, spread over the cells until it stays."""
    mark = _written(levels.select("b", F.xxhash64("b").alias("c")), "anova-part")
    while True:
        side = cells.join(mark, "b").groupBy("a").agg(F.min("c").alias("c"))
        lower = cells.join(side, "a").groupBy("b").agg(F.min("c").alias("low"))
        spread = _written(mark.join(lower, "b").select("b", F.least("c", "low").alias("c"), (F.col("low") < F.col("c")).alias("moved")), "anova-part")
        mark = spread.select("b", "c")
        if spread.where("moved").isEmpty():
            return mark.select("c").distinct().count()


def _effects(cells: DataFrame, levels: DataFrame) -> tuple[DataFrame, float]:
    """(b, x) least-squares effects of factor b next to factor a, and the sum of squares that they explain beyond a.

    `levels` has (b, n, res): records and the sum of deviations from the means of a. The normal equations of b, with a
    taken out, are solved by conjugate gradients scaled by n. A step is two joins of cells with levels; the driver
    sees two sums. In exact arithmetic there are no more steps than levels of b; in practice the better the factors
    are mixed, the fewer.
    """
    zero = F.lit(0.0)
    state = levels.select("b", "n", zero.alias("x"), "res", (F.col("res") / F.col("n")).alias("p"))
    rz = first = state.agg(F.sum(F.col("res") * F.col("p"))).first()[0] or 0.0
    explained = 0.0
    while rz > 0 and rz > PRECISION * first:
        means = cells.join(state.select("b", "p"), "b").groupBy("a").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("m"))
        pulled = cells.join(means, "a").groupBy("b").agg(F.sum(F.col("n") * F.col("m")).alias("pull"))
        step = _written(state.join(pulled, "b").withColumn("q", F.col("n") * F.col("p") - F.col("pull")), "anova-step")
        curve = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if curve <= 0:  # nothing left to explain but rounding
            break
        length = rz / curve
        rest = F.col("res") - F.lit(length) * F.col("q")
        left = step.agg(F.sum(rest * rest / F.col("n"))).first()[0]
        state = step.select(
            "b", "n", (F.col("x") + F.lit(length) * F.col("p")).alias("x"), rest.alias("res"),
            (rest / F.col("n") + F.lit(left / rz) * F.col("p")).alias("p"),
        )
        explained += length * rz
        rz = left
    return state.select("b", "x"), explained


def two_way_anova(df: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """Additive two-way analysis of variance, type II sums of squares: a row per factor and one for the residual.

    Records with a NULL value or factor take no part. Spark reduces the data to one row per factor combination, of
    which there may be any number; the fit over them is a loop of Spark jobs (`_effects`). F and its p-value are NULL
    where a factor has one level only or no degree of freedom is left; an empty table gives zeros.
    """
    x = F.col(value).cast("double")
    a, b = F.col(first).cast("string"), F.col(second).cast("string")
    cells = _written(
        df.filter(x.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(a.alias("a"), b.alias("b"))
        .agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("y"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var")),
        "anova-cells",
    )

    def within(factor: str) -> DataFrame:
        mean = (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean")
        return cells.groupBy(factor).agg(F.sum("n").alias("total"), mean)

    def squares(about: DataFrame, on: str, centre: Column) -> float:
        return cells.join(about, on).agg(F.sum(F.col("n") * (F.col("y") - centre) ** 2)).first()[0] or 0.0

    by_a, by_b = within("a"), within("b")
    counts = {"a": by_a.count(), "b": by_b.count()}
    inner, n = cells.agg(F.sum((F.col("n") - 1) * F.col("var")), F.sum("n")).first()
    inner, n = inner or 0.0, n or 0.0
    deviations = F.sum(F.col("n") * (F.col("y") - F.col("mean"))).alias("res")
    levels = _written(cells.join(by_a, "a").groupBy("b").agg(F.sum("n").alias("n"), deviations), "anova-levels")
    effects, explained = _effects(cells.select("a", "b", "n"), levels)
    # Residuals are summed from the fit itself: the difference of two large sums would lose a small one.
    fitted = _written(cells.join(effects, "b").withColumn("y", F.col("y") - F.col("x")), "anova-fitted")
    centre = fitted.groupBy("a").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean"))
    rest = inner + (fitted.join(centre, "a").agg(F.sum(F.col("n") * (F.col("y") - F.col("mean")) ** 2)).first()[0] or 0.0)
    parts = {"a": inner + squares(by_b, "b", F.col("mean")) - rest, "b": explained}
    free = n - (counts["a"] + counts["b"] - (_components(cells.select("a", "b"), levels) if n else 0))
    total = sum(parts.values()) + rest
    out = []
    for name, factor in ((first, "a"), (second, "b")):
        own = float(max(counts[factor] - 1, 0))
        f = (parts[factor] / own) / (rest / free) if own and free > 0 and rest > 0 else None
        p_value = f_p_value(f, own, free) if f is not None else None
        out.append((name, parts[factor], own, f, p_value, parts[factor] / total if total else None))
    out.append(("residual", rest, free, None, None, rest / total if total else None))
    return df.sparkSession.createDataFrame(
        out, "factor string, sum_sq double, df double, f double, p_value double, eta_squared double"
    )


def tukey_hsd(df: DataFrame, value: str, group: str) -> DataFrame:
    """All pairs of group means with the studentized range test (Tukey-Kramer), of any number of groups.

    Pairs are formed over group moments, one small row per group, never over records. Groups are dealt into blocks of
    about `BLOCK_GROUPS`, and an equi-join on pairs of blocks forms the pairs: a group travels once per block. A NULL
    group takes no part.
    """
    moments = _moments(df.filter(F.col(group).isNotNull()), value, group)
    whole = moments.agg(
        F.count("*").alias("k"), (F.sum("n") - F.count("*")).cast("double").alias("free"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK_GROUPS))).cast("int").alias("blocks"),
    )
    blocks = whole.select("blocks").scalar()
    dealt = moments.select(F.struct("g", "n", "mean").alias("m"), F.pmod(F.xxhash64("g"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select(F.col("m").alias("a"), F.col("own").alias("i"), every.alias("j"))
    right = dealt.select(F.col("m").alias("b"), F.col("own").alias("j"), every.alias("i"))
    pairs = left.join(right, ["i", "j"]).where(F.col("a.g") < F.col("b.g"))
    pairs = pairs.select("a", "b", *[whole.select(c).scalar().alias(c) for c in ("k", "free", "ss")])
    spread = F.sqrt(F.col("ss") / F.col("free") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    difference = F.col("b.mean") - F.col("a.mean")
    tested = pairs.select(
        F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), difference.alias("difference"),
        (F.abs(difference) / spread).alias("q"), "k", "free",
    )
    return tested.select(
        "group_a", "group_b", "difference", "q", _per_row(studentized_range_p, "q", "k", "free").alias("p_value")
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair with its p-value: all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    row = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(test).alias(f"n{i}") for i, test in enumerate(both)],
    )
    flat = row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)
    ])))
    free = (F.col("n") - 2).cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(free, 1 - F.col("r") * F.col("r")))
    tested = flat.select("field_a", "field_b", "r", "n", t.alias("t"), free.alias("free"))
    return tested.select("field_a", "field_b", "r", "n", F.coalesce(_per_row(t_p_value, "t", "free"), F.lit(0.0)).alias("p_value"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Records with the average rank of a column.

    Ranks come from running counts over distinct values, cut into ranges, so neither one
    global sort in one task nor a heavily repeated value is a bottleneck.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__x")).agg(F.count("*").alias("__n"))
    below = running_sum(counts, ["__x"], {"__below": F.col("__n")}, inclusive=False)
    ranks = below.select("__x", (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("__x"), "left").drop("__x")


def spearman(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rank correlation of two columns with its p-value."""
    both = df.select(first, second).filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    ranked = average_ranks(average_ranks(both, first, "__ra"), second, "__rb")
    return correlation_matrix(ranked.select("__ra", "__rb"), ["__ra", "__rb"]).select(
        F.lit(first).alias("field_a"), F.lit(second).alias("field_b"), "r", "n", "p_value"
    )
