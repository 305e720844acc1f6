"""Small helpers on columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F, types as T


def present(column: Column, data_type: T.DataType | None = None) -> Column:
    """True where a value counts as given: not NULL, not '', not NaN, not zero."""
    if isinstance(data_type, T.NumericType):
        filled = column != F.lit(0)
        if isinstance(data_type, (T.DoubleType, T.FloatType)):
            filled = filled & ~F.isnan(column)
    elif isinstance(data_type, T.BooleanType):
        filled = column
    elif data_type is None or isinstance(data_type, T.StringType):
        filled = column != F.lit("")
    else:
        filled = column.isNotNull()
    return F.coalesce(filled, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions) if conditions else F.lit(False)


def pick(choices: dict, key: Column, default=None) -> Column:
    """`CASE key WHEN ..` from a dict."""
    items = list(choices.items())
    chain = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for value, result in items[1:]:
        chain = chain.when(key == F.lit(value), F.lit(result))
    return chain.otherwise(F.lit(default))
