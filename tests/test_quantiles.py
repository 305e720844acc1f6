import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from sparkveil.operators import reports as rp
from sparkveil.operators.quantiles import exact_quantiles, ordered_bits

SHARES = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}
EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999, 1.0000000000000002,
         2.0, 1.9999999999999998, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1e-300, 3e300]


def by_group(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {g: [float(np.quantile(vs, s)) for s in SHARES.values()] for g, vs in groups.items()}


def found(df, value="v", *keys):
    out = exact_quantiles(df, value, SHARES, *keys).collect()
    return {tuple(r[k] for k in keys): [r[s] for s in SHARES] for r in out}


def test_bits_of_doubles_are_in_order(spark):
    draw = random.Random(5)
    values = EDGES + [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(3000)] + [2.0**e for e in range(-1074, 1024)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["b"] for r in df.select("v", ordered_bits(F.col("v"), T.DoubleType()).alias("b")).collect()}
    plain = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert all(b == plain(v) for v, b in got.items())
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(ordered_bits(F.col("v"), T.DoubleType())).first()[0]
    assert nan > max(got.values())


def test_against_numpy_with_a_hot_group_ties_and_nulls(spark):
    draw = random.Random(7)
    rows = [("hot", draw.choice([1.5, draw.lognormvariate(0, 20), -draw.random()])) for _ in range(3000)]
    rows += [(f"g{i % 40}", draw.gauss(0, 10 ** draw.randrange(-5, 9))) for i in range(1000)]
    rows += [(None, 3.0), (None, 4.0), ("alone", 2.5), ("none", None), ("same", 7.0), ("same", 7.0), ("same", None)]
    expected = by_group(rows)
    got = found(spark.createDataFrame(rows, "k string, v double").repartition(7), "v", "k")
    assert {k for k, in got} == set(expected) and "none" not in expected
    for (k,), values in got.items():
        assert values == pytest.approx(expected[k], rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("kind", ["bigint", "int", "float"])
def test_other_numbers_without_keys(spark, kind):
    draw = random.Random(9)
    top = 2**62 if kind == "bigint" else 2**24
    values = [draw.randrange(-top, top) for _ in range(500)] + [0, 0, -1, 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select(F.col("v").cast(kind).alias("v"))
    got = found(df)[()]
    assert got == pytest.approx([float(np.quantile(np.array(values, dtype=float), s)) for s in SHARES.values()], rel=1e-12)


def test_empty_and_refused(spark):
    assert found(spark.createDataFrame([], "k string, v double"), "v", "k") == {}
    assert found(spark.createDataFrame([(None,)], "v double")) == {}
    one = spark.createDataFrame([("a",)], "v string")
    with pytest.raises(TypeError):
        exact_quantiles(one, "v", SHARES)
    with pytest.raises(ValueError):
        exact_quantiles(one, "v", {"p": 2.0})


def test_columns_of_the_input_may_have_any_name(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 6)], "head string, next double, n int")
    assert found(df, "next", "head")[("a",)][2] == 2.0


def test_latency_statistics_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("a", None), ("b", None), (None, 5)], "k string, ms int")
    out = {r["k"]: r for r in rp.latency_statistics(df, "ms", "k").collect()}
    assert out["a"]["p50_latency"] == 15.0 and out["a"]["avg_latency"] == 15.0
    assert out["b"]["p95_latency"] is None and out[None]["p99_latency"] == 5.0
