"""Privacy measures, information loss and detection quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkveil.catalog.anonymization import TEST_SEED, dp_age_sql, dp_amount_sql, k_sql, token_sql
from sparkveil.catalog.core import _COUNT_FIN, TEST_SECRET
from sparkveil.catalog.registry import query
from sparkveil.config import differential_privacy, grid, k_anonymity, tokenization
from sparkveil.operators import anonymize as an, compliance as co, privacy as pr, utility as ut
from sparkveil.views import view

QI = ["age", "gender", "location"]
_QI_SQL = "age, gender, location"


@query("a22_k_level", ("v_pat",), f"""
SELECT min(n) AS k_level, max(n) AS largest_group, CAST(count(*) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS records,
  CAST(coalesce(sum(CASE WHEN n < 3 THEN n END), 0) AS BIGINT) AS records_below_k
FROM (SELECT {k_sql(3)['age']} AS age, gender, {k_sql(3)['location']} AS location, CAST(count(*) AS BIGINT) AS n FROM v_pat GROUP BY ALL) g""")
def achieved_k(spark, sf_dir):
    general = an.anonymize(view(spark, sf_dir, "v_pat"), k_anonymity(3))
    return pr.k_level(general, QI, 3)


def _level_sql(k) -> str:
    changed = k_sql(k) if k else {}
    age = changed.get("age", "CAST(age AS STRING)")
    return f"{age} AS age, gender, {changed.get('location', 'location')} AS location"


_LEVELS = " UNION ALL ".join(
    f"SELECT {i} AS level, {_level_sql(k)}, id FROM v_pat" for i, k in enumerate((None, 3, 5, 15))
)
_LEVEL_STATS = f"""
SELECT level, CAST(count(*) AS BIGINT) AS groups, min(n) AS k_level, CAST(sum(n) AS BIGINT) AS records,
  CAST(coalesce(sum(CASE WHEN n < 5 THEN n END), 0) AS BIGINT) AS suppressed
FROM (SELECT level, {_QI_SQL}, CAST(count(*) AS BIGINT) AS n FROM lv GROUP BY ALL) g GROUP BY level"""


@query("a22_levels", ("v_pat",), f"WITH lv AS ({_LEVELS}) {_LEVEL_STATS}")
def levels(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    return pr.level_report(df, pr.ladder_levels(df.schema, QI), 5)


@query("a22_k_anonymous", ("v_pat",), f"""
WITH lv AS ({_LEVELS}), st AS ({_LEVEL_STATS}),
pick AS (SELECT coalesce(min(CASE WHEN suppressed <= 0.02 * records THEN level END), 3) AS level FROM st),
chosen AS (SELECT lv.*, count(*) OVER (PARTITION BY {_QI_SQL}) AS n FROM lv WHERE level = (SELECT level FROM pick))
SELECT id, {_QI_SQL} FROM chosen WHERE n >= 5""")
def k_anonymous(spark, sf_dir):
    df = view(spark, sf_dir, "v_pat")
    out, _ = pr.generalize_to_k(df, pr.ladder_levels(df.schema, QI), 5, 0.02)
    return out.select("id", *QI)


@query("a23_reid_risk", ("v_pat",), f"""
SELECT round(1.0 / min(n), 9) AS max_risk, round(count(*) / CAST(sum(n) AS DOUBLE), 9) AS mean_risk,
  CAST(coalesce(sum(CASE WHEN n = 1 THEN n END), 0) AS BIGINT) AS unique_records
FROM (SELECT {_QI_SQL}, count(*) AS n FROM v_pat GROUP BY ALL) g""")
def risk(spark, sf_dir):
    out = pr.reidentification_risk(view(spark, sf_dir, "v_pat"), QI)
    return out.select(F.round("max_risk", 9).alias("max_risk"), F.round("mean_risk", 9).alias("mean_risk"), "unique_records")


@query("a24_completeness", ("v_pat",), f"""
SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS BIGINT) AS retained,
  round(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS completeness
FROM (SELECT {k_sql(5)['age']} AS age, gender, location, count(*) AS n FROM v_pat GROUP BY ALL) g""")
def kept(spark, sf_dir):
    general = an.anonymize(view(spark, sf_dir, "v_pat"), k_anonymity(5), fields=("age",))
    return pr.completeness(general, QI, 5).withColumn("completeness", F.round("completeness", 9))


# Every audit event is a query that spends 0.1, 0.5, 1 or 2 of its user's budget.
_EPS = "CASE CAST(id % 4 AS INT) WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 2.0 END"


def _epsilon():
    return F.expr(_EPS)


@query("a25_budget", ("v_audit",), f"""
SELECT id, user_id, CAST(spent AS DOUBLE) AS spent, spent > 50 AS over_budget
FROM (SELECT id, user_id, sum(CAST({_EPS} AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY created_at, id) AS spent FROM v_audit) x""")
def budget(spark, sf_dir):
    out = pr.budget_ledger(view(spark, sf_dir, "v_audit"), "user_id", ["created_at", "id"], _epsilon(), 50.0)
    return out.select("id", "user_id", F.col("spent").cast("double").alias("spent"), "over_budget")


@query("a25_budget_use", ("v_audit",), f"""
SELECT user_id, CAST(sum(CAST({_EPS} AS DECIMAL(18,6))) AS DOUBLE) AS spent,
  round(CAST(sum(CAST({_EPS} AS DECIMAL(18,6))) AS DOUBLE) / 50.0, 9) AS utilization,
  CAST(greatest(50 - sum(CAST({_EPS} AS DECIMAL(18,6))), 0) AS DOUBLE) AS conserved
FROM v_audit GROUP BY user_id""")
def budget_share(spark, sf_dir):
    out = pr.budget_use(view(spark, sf_dir, "v_audit"), "user_id", _epsilon(), 50.0)
    return out.select(
        "user_id", F.col("spent").cast("double").alias("spent"), F.round("utilization", 9).alias("utilization"),
        F.col("conserved").cast("double").alias("conserved"),
    )


@query("a26_linkage", ("v_pat", "v_fin"), f"""
WITH released AS (SELECT {k_sql(3)['age']} AS age, {k_sql(3)['location']} AS location, count(*) AS n FROM v_pat GROUP BY ALL),
known AS (SELECT {k_sql(3)['age']} AS age, {k_sql(3)['location']} AS location, count(*) AS n
  FROM (SELECT DISTINCT customer_name, age, location FROM v_fin) f GROUP BY ALL)
SELECT CAST(sum(r.n) AS BIGINT) AS records, CAST(coalesce(sum(CASE WHEN k.n = 1 THEN r.n END), 0) AS BIGINT) AS linked,
  round(coalesce(sum(CASE WHEN k.n = 1 THEN r.n END), 0) / CAST(sum(r.n) AS DOUBLE), 9) AS linkage_rate
FROM released r LEFT JOIN known k ON r.age = k.age AND r.location = k.location""")
def linkage(spark, sf_dir):
    released = an.anonymize(view(spark, sf_dir, "v_pat"), k_anonymity(3))
    people = view(spark, sf_dir, "v_fin").select("customer_name", "age", "location").distinct()
    known = an.anonymize(people, k_anonymity(3))
    return pr.linkage_rate(released, known, ["age", "location"]).withColumn("linkage_rate", F.round("linkage_rate", 9))


@query("a27_attr_inference", ("v_pat",), f"""
WITH p AS (SELECT {k_sql(5)['age']} AS age, gender, diagnosis, count(*) AS n FROM v_pat GROUP BY ALL),
g AS (SELECT age, gender, max(n) AS best, sum(n) AS size FROM p GROUP BY age, gender),
t AS (SELECT max(n) AS top FROM (SELECT diagnosis, sum(n) AS n FROM p GROUP BY diagnosis) d)
SELECT CAST(sum(size) AS BIGINT) AS records, round(sum(best) / CAST(sum(size) AS DOUBLE), 9) AS accuracy,
  round((SELECT top FROM t) / CAST(sum(size) AS DOUBLE), 9) AS baseline_accuracy FROM g""")
def inference(spark, sf_dir):
    general = an.anonymize(view(spark, sf_dir, "v_pat"), k_anonymity(5), fields=("age",))
    out = pr.attribute_inference(general, ["age", "gender"], "diagnosis")
    return out.select(
        "records", F.round("accuracy", 9).alias("accuracy"), F.round("baseline_accuracy", 9).alias("baseline_accuracy")
    )


@query("a28_membership", ("v_fin",), f"""
WITH rel AS (SELECT CAST(round({dp_amount_sql(2.0)} * 100) AS BIGINT) AS cents FROM v_fin WHERE processing_status = 'done'),
cand AS (SELECT CAST(round(transaction_amount * 100) AS BIGINT) AS cents, processing_status = 'done' AS member FROM v_fin),
below AS (SELECT c.cents, c.member, r.cents AS y FROM cand c ASOF LEFT JOIN rel r ON c.cents >= r.cents),
above AS (SELECT c.cents, min(y) AS y FROM (SELECT DISTINCT cents FROM cand) c ASOF LEFT JOIN (SELECT cents AS y FROM rel) r ON c.cents <= r.y GROUP BY c.cents),
g AS (SELECT b.member AS m, coalesce(b.cents - b.y <= 500, false) OR coalesce(a.y - b.cents <= 500, false) AS g FROM below b JOIN above a ON b.cents = a.cents)
SELECT CAST(count(*) FILTER (g AND m) AS BIGINT) AS tp, CAST(count(*) FILTER (g AND NOT m) AS BIGINT) AS fp,
  CAST(count(*) FILTER (NOT g AND m) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT g AND NOT m) AS BIGINT) AS tn,
  round(avg(CASE WHEN g = m THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM g""")
def membership(spark, sf_dir):
    """Finished transactions are released with noise; are the active ones told apart?"""
    df = view(spark, sf_dir, "v_fin")
    member = F.col("processing_status") == "done"
    cents = F.round(F.col("transaction_amount") * 100).cast("bigint").alias("cents")
    released = an.anonymize(df.filter(member), differential_privacy(2.0), seed=TEST_SEED).select(cents)
    out = pr.membership_inference(df.select(cents, member.alias("member")), released, "cents", "member", 500)
    return out.withColumn("accuracy", F.round("accuracy", 9))


# ---------------------------------------------------------------------- information loss

_PAT_FIELDS, _FIN_FIELDS = 11, 13  # columns of v_pat and v_fin


def text_loss(original: str, changed: str) -> str:
    """Loss SQL of a text field (both sides text that is no number)."""
    return f"""CASE WHEN {original} IS NOT DISTINCT FROM {changed} THEN 0.0 WHEN {original} IS NULL OR {changed} IS NULL THEN 1.0
  ELSE least(1.0, levenshtein({original}, {changed}) / CAST(greatest(length({original}), 1) AS DOUBLE)) END"""


def _k_loss_sql(k: int) -> str:
    changed = k_sql(k)
    terms = [text_loss("CAST(age AS STRING)", f"({changed['age']})")]
    terms += [text_loss(c, f"({changed[c]})") for c in ("ssn", "phone", "diagnosis", "location")]
    return f"({' + '.join(f'({t})' for t in terms)}) / {_PAT_FIELDS}.0"


def _dp_loss_sql(eps: float) -> str:
    age = f"least(1.0, abs(age - {dp_age_sql(eps)}) / (SELECT CAST(max(age) - min(age) AS DOUBLE) FROM v_fin))"
    amount = f"least(1.0, abs(transaction_amount - {dp_amount_sql(eps)}) / (SELECT max(transaction_amount) - min(transaction_amount) FROM v_fin))"
    return f"({age} + {amount}) / {_FIN_FIELDS}.0"


def _token_loss_sql(bits: int) -> str:
    terms = [text_loss(c, f"({token_sql(c, bits)})") for c in ("ssn", "phone", "email", "patient_name")]
    return f"({' + '.join(f'({t})' for t in terms)}) / {_PAT_FIELDS}.0"


def _scored(df, settings, **kwargs):
    out = ut.record_loss(df, settings, **kwargs)
    return out.select(
        "id", F.round("information_loss", 6).alias("information_loss"), F.round("utility_preservation", 6).alias("utility")
    )


def _loss_sql(expression: str, source: str) -> str:
    return f"SELECT id, round({expression}, 6) AS information_loss, round(1.0 - {expression}, 6) AS utility FROM {source}"


query("u4_loss_k", ("v_pat",), _loss_sql(_k_loss_sql(3), "v_pat"))(
    lambda spark, sf: _scored(view(spark, sf, "v_pat"), k_anonymity(3)))
query("u4_loss_dp", ("v_fin",), _loss_sql(_dp_loss_sql(0.5), "v_fin"))(
    lambda spark, sf: _scored(view(spark, sf, "v_fin", heavy=True), differential_privacy(0.5), seed=TEST_SEED))
query("u4_loss_token", ("v_pat",), _loss_sql(_token_loss_sql(256), "v_pat"))(
    lambda spark, sf: _scored(view(spark, sf, "v_pat"), tokenization(256), secret=TEST_SECRET))


@query("u1_field_loss", ("v_pat",), "SELECT " + ", ".join(
    f"round(avg({text_loss('CAST(age AS STRING)' if c == 'age' else c, f'({s})')}), 6) AS {c}_loss" for c, s in k_sql(5).items()
) + " FROM v_pat")
def field_losses(spark, sf_dir):
    out = ut.field_losses(view(spark, sf_dir, "v_pat"), k_anonymity(5))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("u4_loss_joined", ("v_pat",), _loss_sql(_k_loss_sql(10), "v_pat"))
def joined_loss(spark, sf_dir):
    """Loss of two separately stored record sets, matched by key."""
    df = view(spark, sf_dir, "v_pat")
    out = ut.joined_loss(df, an.anonymize(df, k_anonymity(10)), "id")
    return out.select(
        "id", F.round("information_loss", 6).alias("information_loss"), F.round("utility_preservation", 6).alias("utility")
    )


@query("u7_ranges", ("v_fin",), """
SELECT CAST(min(transaction_amount) AS DOUBLE) AS transaction_amount_min, max(transaction_amount) AS transaction_amount_max,
  CAST(min(age) AS DOUBLE) AS age_min, CAST(max(age) AS DOUBLE) AS age_max,
  min(TRY_CAST(location AS DOUBLE)) AS location_min, max(TRY_CAST(location AS DOUBLE)) AS location_max,
  min(TRY_CAST(id AS DOUBLE)) AS id_min, max(TRY_CAST(id AS DOUBLE)) AS id_max FROM v_fin""")
def ranges(spark, sf_dir):
    return ut.numeric_ranges(view(spark, sf_dir, "v_fin"), ["transaction_amount", "age", "location", "id"])


def _grid_row(label, method, expression, level, source):
    return f"""SELECT '{method}' AS method, '{label}' AS setting, CAST(count(*) AS BIGINT) AS records, round(avg(l), 6) AS information_loss,
  round(1.0 - avg(l), 6) AS utility_preservation, CAST(round({level!r}, 6) AS DOUBLE) AS privacy_level FROM (SELECT {expression} AS l FROM {source}) x"""


_FIN_K = {k: f"(({text_loss('CAST(age AS STRING)', '(' + k_sql(k)['age'] + ')')}) + ({text_loss('location', '(' + k_sql(k)['location'] + ')')})) / {_FIN_FIELDS}.0" for k in (3, 5, 10, 15)}
_FIN_T = {b: f"(({text_loss('customer_name', '(' + token_sql('customer_name', b) + ')')}) + ({text_loss('account_number', '(' + token_sql('account_number', b) + ')')})) / {_FIN_FIELDS}.0" for b in (128, 256, 512)}
_GRID_SQL = " UNION ALL ".join(
    [_grid_row(f"k={k}", "k_anonymity", _FIN_K[k], 1 - 1 / k, "v_fin") for k in (3, 5, 10, 15)]
    + [_grid_row(f"eps={e}", "differential_privacy", _dp_loss_sql(e), 1 - math.exp(-e), "v_fin") for e in (0.1, 0.5, 1.0, 2.0)]
    + [_grid_row(f"{b}-bit", "tokenization", _FIN_T[b], min(1.0, b / 512), "v_fin") for b in (128, 256, 512)]
)


@query("u8_grid_loss", ("v_fin",), _GRID_SQL)
def grid_losses(spark, sf_dir):
    """The eleven settings of the experiment over all financial records in one scan."""
    out = ut.grid_loss(view(spark, sf_dir, "v_fin", heavy=True), grid(), secret=TEST_SECRET, seed=TEST_SEED)
    return out.select(
        "method", "setting", "records",
        *[F.round(c, 6).alias(c) for c in ("information_loss", "utility_preservation", "privacy_level")],
    )


@query("u5_privacy", ("v_jobs",), """
SELECT pipeline_type, round(avg(p), 6) AS privacy_level, round(avg(c), 6) AS corrected FROM (
  SELECT pipeline_type, CASE job_id % 3 WHEN 0 THEN 1.0 - 1.0 / 5 WHEN 1 THEN 1.0 - exp(-0.5) ELSE 0.5 END AS p,
    CASE job_id % 3 WHEN 0 THEN 1.0 - 1.0 / 5 WHEN 1 THEN exp(-0.5) ELSE 0.5 END AS c FROM v_jobs) x GROUP BY pipeline_type""")
def privacy_levels(spark, sf_dir):
    """Mean privacy level of jobs that ran with k = 5, epsilon = 0.5 or 256-bit keys."""
    settings = (k_anonymity(5), differential_privacy(0.5), tokenization(256))

    def level(score):
        which = F.col("job_id") % 3
        return F.when(which == 0, score(settings[0])).when(which == 1, score(settings[1])).otherwise(score(settings[2]))

    return view(spark, sf_dir, "v_jobs").groupBy("pipeline_type").agg(
        F.round(F.avg(level(ut.privacy_level)), 6).alias("privacy_level"),
        F.round(F.avg(level(ut.corrected_privacy_level)), 6).alias("corrected"),
    )


@query("u6_report_privacy", ("v_jobs",), """
SELECT job_id, CAST(CASE job_id % 3 WHEN 0 THEN least(1.0, (1 + job_id % 30) / 20.0) WHEN 1 THEN greatest(0.1, 1.0 - (1 + job_id % 20) / 10.0) ELSE 0.7 END AS DOUBLE) AS privacy_level FROM v_jobs""")
def report_privacy(spark, sf_dir):
    df = view(spark, sf_dir, "v_jobs")
    method = F.expr("CASE job_id % 3 WHEN 0 THEN 'k_anonymity' WHEN 1 THEN 'differential_privacy' ELSE 'tokenization' END")
    k, eps = F.col("job_id") % 30 + 1, (F.col("job_id") % 20 + 1) / 10.0
    return df.select("job_id", ut.report_privacy_column(method, k, eps).alias("privacy_level"))


@query("u9_detection", ("v_fin",), f"""
WITH f AS (SELECT {_COUNT_FIN} > 0 AS d, has_violation AS l FROM v_fin),
c AS (SELECT CAST(count(*) FILTER (d AND l) AS BIGINT) AS tp, CAST(count(*) FILTER (d AND NOT l) AS BIGINT) AS fp,
  CAST(count(*) FILTER (NOT d AND l) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT d AND NOT l) AS BIGINT) AS tn FROM f)
SELECT tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall,
  round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(CAST(fp AS DOUBLE) / (fp + tn), 6) AS false_positive_rate,
  round(CAST(fn AS DOUBLE) / (fn + tp), 6) AS false_negative_rate FROM c""")
def detection(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    out = ut.detection_quality(df, co.violates(df, "financial"), F.col("has_violation"))
    rates = ("precision", "recall", "f1", "false_positive_rate", "false_negative_rate")
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in rates])


@query("u10_rule_coverage", ("v_fin",), """
SELECT regulation, monitored, rules, round(CAST(monitored AS DOUBLE) / rules, 6) AS coverage, (SELECT CAST(count(*) AS BIGINT) FROM v_fin) AS records
FROM (VALUES ('HIPAA', 0, 4), ('GDPR', 3, 4), ('PCI-DSS', 0, 1)) r(regulation, monitored, rules)""")
def coverage(spark, sf_dir):
    needs: dict[str, list[tuple[str, ...]]] = {}
    for rule in co.DEFAULT_BOOK.rules("all"):
        needs.setdefault(rule.regulation, []).append(rule.needs)
    return ut.rule_coverage(view(spark, sf_dir, "v_fin"), needs).withColumn("coverage", F.round("coverage", 6))


def _entropy_sql(field: str, value: str) -> str:
    return f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT {value} AS v, count(*) AS n FROM v_pat GROUP BY 1) h)"


@query("u11_entropy", ("v_pat",), " UNION ALL ".join(
    f"SELECT '{c}' AS field, round({_entropy_sql(c, c)}, 6) AS entropy_original, round({_entropy_sql(c, s)}, 6) AS entropy_anonymized, "
    f"round({_entropy_sql(c, c)} - {_entropy_sql(c, s)}, 6) AS entropy_loss"
    for c, s in k_sql(3).items() if c in ("age", "diagnosis", "location")))
def entropies(spark, sf_dir):
    out = ut.entropy_loss(view(spark, sf_dir, "v_pat"), k_anonymity(3), ["age", "diagnosis", "location"])
    return out.select("field", *[
        F.round(F.col(c), 6).alias(c) for c in ("entropy_original", "entropy_anonymized", "entropy_loss")
    ])


@query("u12_corr", ("v_fin",), f"""
SELECT 'age' AS field_a, 'credit_score' AS field_b, round(corr(age, credit_score), 6) AS original,
  round(corr({dp_age_sql(1.0)}, credit_score), 6) AS anonymized, round(abs(corr(age, credit_score) - corr({dp_age_sql(1.0)}, credit_score)), 6) AS difference FROM v_fin
UNION ALL SELECT 'age', 'transaction_amount', round(corr(age, transaction_amount), 6), round(corr({dp_age_sql(1.0)}, {dp_amount_sql(1.0)}), 6),
  round(abs(corr(age, transaction_amount) - corr({dp_age_sql(1.0)}, {dp_amount_sql(1.0)})), 6) FROM v_fin""")
def correlations(spark, sf_dir):
    out = ut.correlation_kept(
        view(spark, sf_dir, "v_fin"), differential_privacy(1.0),
        [("age", "credit_score"), ("age", "transaction_amount")], seed=TEST_SEED,
    )
    return out.select("field_a", "field_b", *[F.round(c, 6).alias(c) for c in ("original", "anonymized", "difference")])


@query("u13_query_accuracy", ("v_fin",), f"""
SELECT location, round(avg(transaction_amount), 2) AS original, round(avg({dp_amount_sql(0.1)}), 2) AS anonymized,
  abs(avg(transaction_amount) - avg({dp_amount_sql(0.1)})) / avg(transaction_amount) <= 0.0005 AS accurate FROM v_fin GROUP BY location""")
def answers(spark, sf_dir):
    df = view(spark, sf_dir, "v_fin")
    after = an.anonymize(df, differential_privacy(0.1), seed=TEST_SEED)
    out = ut.query_accuracy(df, after, ["location"], F.avg("transaction_amount"), 0.0005)
    return out.select(
        "location", F.round("original", 2).alias("original"), F.round("anonymized", 2).alias("anonymized"), "accurate"
    )
