"""The operators as registered queries over the whole given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import exact_dedup, license_scan, line_dedup, packing, periodic_runs, quality, secret_scan, sentencepiece_lattice, simhash, spelling, topk, toxicity, warc
from sparkveil.llm.common import ready
from sparkveil.views import table


def _op8(docs: DataFrame) -> DataFrame:
    decoded = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs))
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


_ON_DOCUMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "op1_packing": packing.pack,
    "op2_secrets": lambda docs: secret_scan.digest(secret_scan.scan(docs)),
    "op5_exact_dedup": exact_dedup.exact_duplicates,
    "op7_line_dedup": line_dedup.line_report,
    "op8_sentencepiece": _op8,
    "op9_licenses": license_scan.license_report,
    "op10_simhash": simhash.near_duplicates,
    "op11_spelling": spelling.spelling_forms,
    "op13_periodic_runs": periodic_runs.periodic_runs,
}


def _over_documents(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(table(ready(spark), sf_dir, "documents"))


def _with_labels(build: Callable[[DataFrame, DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _over_documents(build) for name, build in _ON_DOCUMENTS.items()},
    "op3_toxicity": _with_labels(toxicity.toxicity_scores),
    "op4_topk": lambda spark, sf_dir: topk.top_k(table(ready(spark), sf_dir, "embeddings")),
    "op6_quality": _with_labels(quality.quality_scores),
    "op12_warc": lambda spark, sf_dir: warc.round_trip(table(ready(spark), sf_dir, "pages")),
}

ORACLES = {
    "op4_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op5_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t
""",
    # The same set join in another order of words (exact counts): sets of words, rarest first, prefixes joined, Jaccard of the sets.
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
w AS (SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS words FROM l),
s AS (SELECT words, min((doc_id, no)) AS id FROM w WHERE len(words) > 0 GROUP BY words),
t AS (SELECT id, len(words) AS size, unnest(words) AS word FROM s),
f AS (SELECT word, count(*) AS n FROM t GROUP BY word),
p AS (SELECT id, size, word, row_number() OVER (PARTITION BY id ORDER BY n, word) AS place FROM t JOIN f USING (word)),
q AS (SELECT id, size, word FROM p WHERE place <= size - CAST((4 * size + 4) // 5 AS BIGINT) + 1),
c AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM q a JOIN q b ON a.word = b.word AND a.id > b.id AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)),
m AS (SELECT DISTINCT later FROM c JOIN s a ON a.id = c.later JOIN s b ON b.id = c.earlier
  WHERE 5 * len(list_intersect(a.words, b.words)) >= 4 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))),
k AS (SELECT id[1] AS doc_id, id[2] AS no FROM s WHERE id NOT IN (SELECT later FROM m)),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(words) > 0) AS worded FROM w GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS kept_lines FROM k GROUP BY doc_id)
SELECT n.doc_id, n_lines, worded - coalesce(j.n, 0) AS n_removed, coalesce(kept_lines, '') AS kept_lines FROM n LEFT JOIN j USING (doc_id)
""",
    # Another way to the pairs: words that agree when one letter, of one or of both at the same place, is left out. The checksum is taken byte by byte from its table.
    "op11_spelling": """
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END)) AS steps),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda l: CASE WHEN ord(l) < 128 THEN [CAST(ord(l) AS BIGINT)] ELSE [CAST(192 + ord(l) // 64 AS BIGINT), CAST(128 + ord(l) % 64 AS BIGINT)] END))),
  lambda x, y: xor(x // 256, steps[xor(x, y) % 256 + 1]))) AS drawn FROM g, c),
o AS (SELECT CASE WHEN drawn % 31 = 0 THEN left(run, CAST(drawn % length(run) AS BIGINT)) || substr(run, CAST(drawn % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
l AS (SELECT word, n, unnest(range(-1, length(word))) AS pos FROM w),
k AS (SELECT word, n, pos, CASE WHEN pos < 0 THEN word ELSE left(word, pos) || substr(word, pos + 2) END AS key FROM l),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word WHERE a.pos = b.pos OR least(a.pos, b.pos) < 0),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form AS at FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.at AS root FROM t JOIN f ON f.word = t.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
""",
    "op12_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT page_id, payload, octet_length(payload) AS size, CASE WHEN octet_length(payload) >= 100 THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS sound FROM f
""",
}
