import math
import random

import numpy as np
import pytest

from sparkveil.operators import stats as st


def test_tails_against_known_values():
    # Textbook quantiles: t(0.975; 10) = 2.228, F(0.95; 2, 10) = 4.103, q(0.95; 3, 10) = 3.877.
    assert st.t_p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert st.f_p_value(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert st.studentized_range_p(3.877, 3, 10) == pytest.approx(0.05, abs=2e-3)
    assert st.studentized_range_p(3.314, 3, 1e6) == pytest.approx(0.05, abs=1e-3)
    assert st.t_p_value(0.0, 5) == pytest.approx(1.0) and st.t_p_value(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a, b = rng.choice("pqr"), rng.choice("xy")
        rows.append((a, b, 10 + 2 * (a == "q") + 3 * (b == "y") + rng.gauss(0, 1), rng.randrange(30)))
    return spark.createDataFrame(rows, "a string, b string, v double, w int"), rows


def test_t_test(runs):
    df, rows = runs
    row = st.t_test(df, "v", "b", "x", "y").first()
    x, y = (np.array([r[2] for r in rows if r[1] == g]) for g in "xy")
    pooled = ((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / (len(x) + len(y) - 2)
    t = (x.mean() - y.mean()) / math.sqrt(pooled * (1 / len(x) + 1 / len(y)))
    assert row["t"] == pytest.approx(t) and row["cohens_d"] == pytest.approx((x.mean() - y.mean()) / math.sqrt(pooled))
    assert row["p_value"] < 1e-10
    welch = st.t_test(df, "v", "b", "x", "y", equal_variance=False).first()
    assert welch["df"] < row["df"]


def test_two_way_anova_equals_a_direct_fit(runs):
    df, rows = runs
    got = {r["factor"]: r for r in st.two_way_anova(df, "v", "a", "b").collect()}
    y = np.array([r[2] for r in rows])

    def residual(*factors):
        columns = [np.ones(len(rows))]
        for f in factors:
            levels = sorted({r[f] for r in rows})[1:]
            columns += [np.array([r[f] == level for r in rows], dtype=float) for level in levels]
        m = np.column_stack(columns)
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        return float(((y - m @ beta) ** 2).sum())

    rest = residual(0, 1)
    assert got["residual"]["sum_sq"] == pytest.approx(rest)
    assert got["a"]["sum_sq"] == pytest.approx(residual(1) - rest) and got["b"]["sum_sq"] == pytest.approx(residual(0) - rest)
    assert got["a"]["f"] == pytest.approx(((residual(1) - rest) / 2) / (rest / (400 - 4)))


def direct(rows):
    """Type II sums of squares, residual and its degrees of freedom by a dense fit."""
    y = np.array([r[2] for r in rows])

    def residual(*factors):
        columns = [np.ones(len(rows))]
        for f in factors:
            columns += [np.array([r[f] == level for r in rows], dtype=float) for level in sorted({r[f] for r in rows})[1:]]
        m = np.column_stack(columns)
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        return float(((y - m @ beta) ** 2).sum()), len(rows) - np.linalg.matrix_rank(m)

    rest, free = residual(0, 1)
    return residual(1)[0] - rest, residual(0)[0] - rest, rest, free


def test_two_way_anova_of_a_sparse_uneven_design(spark):
    """Most combinations are missing, one level holds a third of the records, and two parts share no level."""
    draw = random.Random(21)
    rows = []
    for i in range(600):
        a = "hot" if i % 3 == 0 else f"a{draw.randrange(12)}"
        b = f"b{draw.randrange(5)}" if a == "hot" else f"b{(int(a[1:]) + draw.randrange(2)) % 9}"
        rows.append((a, b, draw.gauss(0, 1) + len(a) + int(b[1:]) ** 1.5))
    rows += [("apart", f"z{i % 2}", draw.gauss(9, 1)) for i in range(20)]
    nulls = [(None, "b1", 5.0), ("a1", None, 5.0), ("a1", "b1", None)]
    df = spark.createDataFrame(rows + nulls, "a string, b string, v double")
    got = {r["factor"]: r for r in st.two_way_anova(df, "v", "a", "b").collect()}
    first, second, rest, free = direct(rows)
    assert got["a"]["sum_sq"] == pytest.approx(first, rel=1e-8) and got["b"]["sum_sq"] == pytest.approx(second, rel=1e-8)
    assert got["residual"]["sum_sq"] == pytest.approx(rest, rel=1e-10) and got["residual"]["df"] == free


def test_two_way_anova_without_freedom_or_rows(spark):
    empty = st.two_way_anova(spark.createDataFrame([], "a string, b string, v double"), "v", "a", "b").collect()
    assert [(r["factor"], r["sum_sq"], r["f"]) for r in empty] == [("a", 0.0, None), ("b", 0.0, None), ("residual", 0.0, None)]
    one = {r["factor"]: r for r in st.two_way_anova(spark.createDataFrame([("x", "p", 1.0), ("x", "q", 3.0)], "a string, b string, v double"), "v", "a", "b").collect()}
    assert one["b"]["sum_sq"] == pytest.approx(2.0) and one["b"]["f"] is None and one["a"]["p_value"] is None and one["residual"]["df"] == 0


def test_tukey_pairs_are_the_same_in_blocks(runs, monkeypatch):
    key = lambda r: (r["group_a"], r["group_b"])
    df = runs[0].selectExpr("v", "w % 9 AS w")
    whole = {key(r): r for r in st.tukey_hsd(df, "v", "w").collect()}
    assert len(whole) == 9 * 8 // 2
    monkeypatch.setattr(st, "BLOCK_GROUPS", 2)
    blocks = st.tukey_hsd(df, "v", "w").collect()
    assert len(blocks) == len(whole)
    for r in blocks:
        assert r["q"] == pytest.approx(whole[key(r)]["q"]) and r["p_value"] == pytest.approx(whole[key(r)]["p_value"], abs=1e-9)


def test_tukey_finds_the_shifted_group(runs):
    rows = {(r["group_a"], r["group_b"]): r["p_value"] for r in st.tukey_hsd(runs[0], "v", "a").collect()}
    assert set(rows) == {("p", "q"), ("p", "r"), ("q", "r")}
    assert rows[("p", "q")] < 1e-3 and rows[("q", "r")] < 1e-3 and rows[("p", "r")] > 0.01


def test_spearman_with_ties(runs):
    df, rows = runs

    def ranks(values):
        order = sorted(values)
        return np.array([order.index(v) + (order.count(v) + 1) / 2 for v in values])

    expected = np.corrcoef(ranks([r[2] for r in rows]), ranks([r[3] for r in rows]))[0, 1]
    row = st.spearman(df, "v", "w").first()
    assert row["r"] == pytest.approx(expected) and row["n"] == 400 and 0 <= row["p_value"] <= 1


def test_perfect_correlation(spark):
    row = st.correlation_matrix(spark.range(20).selectExpr("id a", "2 * id b"), ["a", "b"]).first()
    assert row["r"] == pytest.approx(1.0) and row["p_value"] == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("free", [1.0, 7.0, 5e3, 5e8, 5e10])
def test_tails_hold_at_any_degrees_of_freedom(free):
    assert st.f_p_value(1.0, free, free) == pytest.approx(0.5, abs=1e-9)
    for t in (0.3, 1.0, 1.959964, 4.0):
        assert st.t_p_value(t, free) == pytest.approx(st.f_p_value(t * t, 1.0, free), rel=1e-9)
        if free >= 5e8:
            assert st.t_p_value(t, free) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-5)
    if free >= 1e6:  # chi-squared of two degrees in the limit
        assert st.f_p_value(3.0, 2.0, free) == pytest.approx(math.exp(-3.0), rel=1e-6)


def test_the_studentized_range_has_no_step():
    below, above = st.studentized_range_p(3.4, 3, 5000), st.studentized_range_p(3.4, 3, 5001)
    assert 0 <= below - above < 1e-6
    limit = st.studentized_range_p(3.4, 3, 1e12)
    assert st.studentized_range_p(3.4, 3, 1e8) == pytest.approx(limit, abs=1e-6) and limit < above
