"""Personal data in free text: counts, matches and masking over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkveil.functions.patterns import IPV4, ISO_DATE, TEXT_PATTERNS, URL


def pattern_counts(text: Column, patterns: dict[str, str] = TEXT_PATTERNS) -> dict[str, Column]:
    return {name: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for name, p in patterns.items()}


def scan(df: DataFrame, text: str, keys: list[str], patterns: dict[str, str] = TEXT_PATTERNS) -> DataFrame:
    """Hits per record and pattern."""
    return df.select(*keys, *[c.alias(f"{n}_hits") for n, c in pattern_counts(F.col(text), patterns).items()])


def matches(df: DataFrame, text: str, keys: list[str], patterns: dict[str, str] = TEXT_PATTERNS) -> DataFrame:
    """One row per match: key, pattern, value."""

    def tagged(name: str, pattern: str) -> Column:
        values = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("pattern"), v.alias("value")))

    found = F.flatten(F.array(*[tagged(n, p) for n, p in patterns.items()]))
    return df.select(*keys, F.inline(found))


def pattern_totals(df: DataFrame, text: str, patterns: dict[str, str] = TEXT_PATTERNS) -> DataFrame:
    """Records with a hit and hits per pattern, in one aggregate."""
    counts = df.select(*[c.alias(n) for n, c in pattern_counts(F.col(text), patterns).items()])
    totals = counts.agg(
        *[F.count_if(F.col(n) > 0).alias(f"r_{n}") for n in patterns], *[F.sum(n).alias(f"h_{n}") for n in patterns]
    )
    rows = [
        F.struct(F.lit(n).alias("pattern"), F.col(f"r_{n}").alias("records"), F.coalesce(F.col(f"h_{n}"), F.lit(0)).alias("hits"))
        for n in patterns
    ]
    return totals.select(F.inline(F.array(*rows)))


def mask(text: Column, patterns: dict[str, str] = TEXT_PATTERNS) -> Column:
    """Every match replaced by the name of its pattern in brackets."""
    for name, p in patterns.items():
        text = F.regexp_replace(text, p, f"[{name.upper()}]")
    return text


def safe_harbor(text: Column) -> Column:
    """Dates cut to the year, web and network addresses removed."""
    years = F.regexp_replace(text, ISO_DATE.replace(r"\d{4}-", r"(\d{4})-", 1), "$1")
    return F.regexp_replace(F.regexp_replace(years, URL, "[URL]"), IPV4, "[IP_ADDRESS]")


def capped_age(age: Column) -> Column:
    """Ages over 89 form one class."""
    return F.when(age > 89, F.lit("90+")).otherwise(age.cast("string"))


def short_zip(zip_code: Column, population: Column | None = None) -> Column:
    """First three digits, or 000 when the area has at most 20,000 people."""
    prefix = F.substring(zip_code, 1, 3)
    return prefix if population is None else F.when(population > 20000, prefix).otherwise(F.lit("000"))
