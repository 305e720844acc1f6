"""Noise from reproducible uniforms.

A known seed gives no privacy: a release needs a secret seed of its own, and the budget
ledger in `operators.privacy` accounts for the epsilon it spends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def laplace(uniform: Column, scale: float) -> Column:
    """Inverse distribution function of the Laplace law with mean 0."""
    centred = uniform - F.lit(0.5)
    tail = F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(centred), F.lit(1e-16))
    return F.lit(-float(scale)) * F.signum(centred) * F.ln(tail)


def truth_probability(epsilon: float, categories: int) -> float:
    return math.exp(epsilon) / (math.exp(epsilon) + categories - 1)


def randomized_response(value: Column, domain: tuple[str, ...], epsilon: float, coin: Column, pick: Column) -> Column:
    """Keep the value with the truth probability, else draw one of the other categories."""
    truthful = truth_probability(epsilon, len(domain))
    others = F.filter(F.array(*[F.lit(d) for d in domain]), lambda d: d != value)
    index = F.least(F.floor(pick * F.size(others)), F.size(others).cast("bigint") - 1).cast("int") + 1
    return F.when(coin < F.lit(truthful), value).otherwise(F.element_at(others, index))
