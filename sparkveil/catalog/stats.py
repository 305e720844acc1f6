"""Statistical tests over job runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkveil.catalog.registry import query
from sparkveil.catalog.reports import _RUNS, _runs
from sparkveil.operators import stats as st
from sparkveil.views import view


def _rounded(df, digits, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


def _p_values(tests: str) -> str:
    """SQL of (test, p_value) for the rows (test, f, d1, d2) of `tests`: the tail of F, summed over the angle whose sine is the root of the beta variable."""
    steps = 1_000_000
    return f"""
SELECT test, round(sum(exp(scale + (d2 - 1) * ln(sin(width * (i + 0.5))) + (d1 - 1) * ln(cos(width * (i + 0.5))))) * 2 * any_value(width), 5) AS p_value
FROM (SELECT test, d1, d2, asin(sqrt(d2 / (d2 + d1 * f))) / {steps} AS width, lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) AS scale FROM {tests}) u, range({steps}) r(i) GROUP BY test"""


@query("k1_ttest", ("v_jobs",), f"""
WITH {_RUNS}, m AS (SELECT count(*) FILTER (pipeline_type = 'batch') AS n1, avg(throughput) FILTER (pipeline_type = 'batch') AS m1, var_samp(throughput) FILTER (pipeline_type = 'batch') AS v1,
  count(*) FILTER (pipeline_type = 'stream') AS n2, avg(throughput) FILTER (pipeline_type = 'stream') AS m2, var_samp(throughput) FILTER (pipeline_type = 'stream') AS v2 FROM runs),
p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled FROM m)
SELECT round(m1, 4) AS mean1, round(m2, 4) AS mean2, round((m1 - m2) / sqrt(pooled * (1.0 / n1 + 1.0 / n2)), 6) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df,
  round((m1 - m2) / sqrt(pooled), 6) AS cohens_d FROM p""")
def t_test(spark, sf_dir):
    out = st.t_test(_runs(spark, sf_dir), "throughput", "pipeline_type", "batch", "stream")
    return _rounded(_rounded(out.drop("p_value"), 4, "mean1", "mean2"), 6, "t", "cohens_d")


@query("k2_anova", ("v_jobs",), f"""
WITH {_RUNS}, g AS (SELECT technique, count(*) AS n, avg(throughput) AS m, var_samp(throughput) AS v FROM runs GROUP BY 1),
s AS (SELECT sum(n * pow(m - (SELECT avg(throughput) FROM runs), 2)) AS b, sum((n - 1) * v) AS w, count(*) AS k, sum(n) AS n FROM g)
SELECT round(b, 0) AS ss_between, round(w, 0) AS ss_within, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within, round((b / (k - 1)) / (w / (n - k)), 6) AS f,
  round(b / (b + w), 9) AS eta_squared FROM s""")
def anova(spark, sf_dir):
    out = st.anova(_runs(spark, sf_dir), "throughput", "technique").drop("p_value")
    return _rounded(_rounded(_rounded(out, 0, "ss_between", "ss_within"), 6, "f"), 9, "eta_squared")


@query("k2_two_way_anova", ("v_jobs",), f"""
WITH {_RUNS}, cell AS (SELECT pipeline_type AS a, technique AS b, dense_rank() OVER (ORDER BY technique) AS j, count(*) AS n, avg(throughput) AS y, var_samp(throughput) AS v FROM runs GROUP BY 1, 2),
ma AS (SELECT a, sum(n) AS na, sum(n * y) / sum(n) AS m FROM cell GROUP BY a), mb AS (SELECT b, sum(n * y) / sum(n) AS m FROM cell GROUP BY b),
w AS (SELECT sum((n - 1) * v) AS inner_sq, sum(n) AS n FROM cell),
r AS (SELECT sum(n * (y - m)) FILTER (j = 2) AS r2, sum(n * (y - m)) FILTER (j = 3) AS r3, sum(n * (y - m) * (y - m)) AS sq FROM cell JOIN ma USING (a)),
e AS (SELECT a, na, coalesce(sum(n) FILTER (j = 2), 0) AS n2, coalesce(sum(n) FILTER (j = 3), 0) AS n3 FROM cell JOIN ma USING (a) GROUP BY a, na),
q AS (SELECT sum(n2 - n2 * n2 / na) AS s22, sum(n3 - n3 * n3 / na) AS s33, -sum(n2 * n3 / na) AS s23 FROM e),
f AS (SELECT (s33 * r2 * r2 - 2 * s23 * r2 * r3 + s22 * r3 * r3) / (s22 * s33 - s23 * s23) AS ss_b FROM q, r),
sums AS (SELECT ss_b, inner_sq + sq - ss_b AS rest, (SELECT sum(n * (y - m) * (y - m)) FROM cell JOIN mb USING (b)) - sq + ss_b AS ss_a, CAST(n - 5 AS DOUBLE) AS free FROM f, r, w),
parts AS (SELECT 'pipeline_type' AS factor, ss_a AS ss, 2.0 AS d, ss_a / 2 / (rest / free) AS f FROM sums UNION ALL SELECT 'technique', ss_b, 2.0, ss_b / 2 / (rest / free) FROM sums
  UNION ALL SELECT 'residual', rest, free, NULL FROM sums),
tests AS (SELECT factor AS test, f, CAST(d AS DOUBLE) AS d1, free AS d2 FROM parts, sums WHERE f IS NOT NULL), p AS ({_p_values("tests")})
SELECT factor, round(ss, -3) AS sum_sq, CAST(d AS DOUBLE) AS df, round(f, 6) AS f, p_value, round(ss / (SELECT sum(ss) FROM parts), 9) AS eta_squared FROM parts LEFT JOIN p ON test = factor""")
def two_way(spark, sf_dir):
    """The SQL takes the three techniques' normal equations by hand; other designs are compared with a direct fit in the tests."""
    out = st.two_way_anova(_runs(spark, sf_dir), "throughput", "pipeline_type", "technique")
    return _rounded(_rounded(_rounded(_rounded(out, -3, "sum_sq"), 6, "f"), 5, "p_value"), 9, "eta_squared")


@query("k3_tukey", ("v_jobs",), f"""
WITH {_RUNS}, g AS (SELECT technique, count(*) AS n, avg(throughput) AS m, var_samp(throughput) AS v FROM runs GROUP BY 1),
s AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS ms FROM g)
SELECT a.technique AS group_a, b.technique AS group_b, round(b.m - a.m, 4) AS difference, round(abs(b.m - a.m) / sqrt((SELECT ms FROM s) / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q
FROM g a JOIN g b ON a.technique < b.technique""")
def tukey(spark, sf_dir):
    out = st.tukey_hsd(_runs(spark, sf_dir), "throughput", "technique").drop("p_value")
    return _rounded(_rounded(out, 4, "difference"), 6, "q")


@query("k4_corr", ("v_jobs",), """
SELECT 'records_processed' AS field_a, 'processing_time_seconds' AS field_b, round(corr(records_processed, processing_time_seconds), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM v_jobs
UNION ALL SELECT 'records_processed', 'file_id', round(corr(records_processed, file_id), 6), count(*) FROM v_jobs
UNION ALL SELECT 'processing_time_seconds', 'file_id', round(corr(processing_time_seconds, file_id), 6), count(*) FROM v_jobs""")
def pearson(spark, sf_dir):
    out = st.correlation_matrix(view(spark, sf_dir, "v_jobs"), ["records_processed", "processing_time_seconds", "file_id"])
    return _rounded(out.drop("p_value"), 6, "r")


@query("k4_spearman", ("v_jobs",), """
WITH r AS (SELECT rank() OVER (ORDER BY records_processed) + (count(*) OVER (PARTITION BY records_processed) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY processing_time_seconds) + (count(*) OVER (PARTITION BY processing_time_seconds) - 1) / 2.0 AS b FROM v_jobs)
SELECT 'records_processed' AS field_a, 'processing_time_seconds' AS field_b, round(corr(a, b), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM r""")
def rank_correlation(spark, sf_dir):
    out = st.spearman(view(spark, sf_dir, "v_jobs"), "records_processed", "processing_time_seconds")
    return _rounded(out.drop("p_value"), 6, "r")


@query("k4_p_values", ("v_jobs",), f"""
WITH {_RUNS}, m AS (SELECT count(*) FILTER (pipeline_type = 'batch') AS n1, avg(throughput) FILTER (pipeline_type = 'batch') AS m1, var_samp(throughput) FILTER (pipeline_type = 'batch') AS v1,
  count(*) FILTER (pipeline_type = 'stream') AS n2, avg(throughput) FILTER (pipeline_type = 'stream') AS m2, var_samp(throughput) FILTER (pipeline_type = 'stream') AS v2 FROM runs),
g AS (SELECT technique, count(*) AS n, avg(throughput) AS m, var_samp(throughput) AS v FROM runs GROUP BY 1),
s AS (SELECT sum(n * pow(m - (SELECT avg(throughput) FROM runs), 2)) AS b, sum((n - 1) * v) AS w, count(*) AS k, sum(n) AS n FROM g),
r AS (SELECT rank() OVER (ORDER BY records_processed) + (count(*) OVER (PARTITION BY records_processed) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY processing_time) + (count(*) OVER (PARTITION BY processing_time) - 1) / 2.0 AS b FROM runs), c AS (SELECT corr(a, b) AS c, count(*) AS n FROM r),
tests AS (SELECT 't_test' AS test, pow(m1 - m2, 2) / (((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS f, 1.0::DOUBLE AS d1, (n1 + n2 - 2)::DOUBLE AS d2 FROM m
  UNION ALL SELECT 'anova', (b / (k - 1)) / (w / (n - k)), (k - 1)::DOUBLE, (n - k)::DOUBLE FROM s UNION ALL SELECT 'spearman', c * c * (n - 2) / (1 - c * c), 1.0, (n - 2)::DOUBLE FROM c)
{_p_values("tests")}""")
def p_values(spark, sf_dir):
    """p-values of the tests above; the SQL integrates the density of F, the operators expand its tail."""
    runs = _runs(spark, sf_dir)
    parts = (
        st.t_test(runs, "throughput", "pipeline_type", "batch", "stream").select(F.lit("t_test").alias("test"), "p_value"),
        st.anova(runs, "throughput", "technique").select(F.lit("anova").alias("test"), "p_value"),
        st.spearman(runs, "records_processed", "processing_time").select(F.lit("spearman").alias("test"), "p_value"),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _rounded(out, 5, "p_value")
