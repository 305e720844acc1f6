"""Spelling forms, archives and periodic runs against brute force, and on nulls, odd texts, ties, repeats, empty tables and clashing columns."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from sparkveil.llm import periodic_runs, spelling, warc
from sparkveil.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, word string, n long, a string, signature long, n_runs long"
LONG = "etiamque aliquam sollicitudin " * 30000
ODD = [
    (1, "etiamque aliquam sollicitudin"), (2, None), (3, ""), (4, LONG), (5, "etiamque aliquam"), (5, "etiamque aliquam"),
    (None, "aliquam nobody Étiamqué ÷÷÷÷÷÷÷×"), (7, " \t\r\n\x0b "), (8, "ABCDEFGH abcdefgh \u0000 日本語日本語日本語 ſſſſſſſſ"),
    (None, "a b " * 40), (9, "x " * 24 + "y z " * 12), (0, "one"), (-3, "minus " * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "clash", 1, "a", 2, 3) for d, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# spelling

def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _forms(rows):
    """By the definition: all pairs of words."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and _one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return out


def test_forms_by_definition(spark, odd, empty):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(25)]
    texts = []
    for doc in range(60):
        words = []
        for _ in range(200):
            word = rng.choice(stems[:4]) if rng.random() < 0.8 else rng.choice(stems)
            for _ in range(rng.choice((0, 0, 0, 0, 1, 2))):
                at, kind = rng.randrange(len(word)), rng.randrange(3)
                word = word[:at] + (rng.choice("abéÉ") if kind else "") + word[at + (kind < 2):]
            words.append(word.upper() if rng.random() < 0.1 else word)
        texts.append((doc, rng.choice((" ", "-", "1")).join(words)))
    chain = [(100 + i, " ".join(["abcdefgh"] * 500 + ["abcdefgx"] * 40 + ["abcdefyx"] * 3)) for i in range(2)]
    given = spark.createDataFrame(texts + chain, "doc_id long, text string")
    for df in (given, odd):
        rows = spelling.spelling_forms(df).collect()
        assert len(rows) == len({r.word for r in rows})
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == _forms([(r.doc_id, r.text) for r in df.collect()])
    by_word = {r.word: r for r in spelling.spelling_forms(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert by_word["abcdefyx"].form == "abcdefgx" and by_word["abcdefyx"].root == "abcdefgh"
    assert spelling.spelling_forms(empty).count() == 0


@pytest.mark.parametrize("groups", [3, 4, 6])
def test_pairs_do_not_depend_on_the_groups(spark, groups):
    rng = random.Random(groups)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) for _ in range(700)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = sorted((r.a, r.b) for r in spelling.near_pairs(df, groups).collect())
    assert got == sorted((a, b) for a in words for b in words if a < b and _one_edit(a, b))


# archives

PAGES = "page_id long, url string, html string, key long, payload string, doc_id long"
MARK = "\r\n\r\nWARC/1.1\r\n"


def _pages():
    htmls = [
        "x" * 99, "x" * 99, "y" * 100, "y" * 100, None, "", MARK * 3000, MARK * 3000, "WARC/1.1", MARK, "\r\n\r\n", "a\r\n\r\nWARC/1.1", "WARC/1.1\r\n",
        "é😀" * 40000, "b" * 65536, "c" * 65537, "WARC-Type: warcinfo\r\n\r\nContent-Length: 3", "é" * 50, "d" * 49,
    ]
    urls = ["http://a/b?c=d", None, "", "http://é/ \r\nWARC-Type: x", "u" * 5000]
    rows = [(i, urls[i % len(urls)], h, 1, "p", 2) for i, h in enumerate(htmls)]
    return rows + [(None, "u", "y" * 100, 1, "p", 2), (None, None, "only without an id " * 9, 1, "p", 2), (30, "u", "q" * 200, 1, "p", 2), (30, "u", "q" * 200, 1, "p", 2)]


def _archived(rows):
    out, first = Counter(), {}
    for page, payload in sorted(((p, (h or "").encode()) for p, _, h, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        again = len(payload) >= 100 and payload in first
        out[page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[payload] if again else None, True] += 1
        first.setdefault(payload, page)
    return out


@pytest.mark.parametrize("compression,chunk", [("gzip", warc.CHUNK), ("none", warc.CHUNK), ("gzip", 1000), ("none", 333)])
def test_archives_come_back_whole(spark, tmp_path, compression, chunk):
    df = spark.createDataFrame(_pages(), PAGES).repartition(3)
    path = warc.write_archives(df, f"{tmp_path}/w", compression, chunk, "2024-01-01T00:00:00Z")
    rows = warc.read_pages(spark, path).collect()
    assert Counter(tuple(r) for r in rows) == _archived(_pages())
    assert all(len(r.data) <= chunk for r in warc.read_chunks(spark, path).select("data").collect())


def test_archives_are_valid_files(spark, tmp_path):
    """Read record by record by the lengths alone, as any other reader does."""
    df = spark.createDataFrame(_pages(), PAGES).coalesce(2)
    warc.write_archives(df, f"{tmp_path}/w", "gzip", 5000)
    payloads, kinds, ids = {}, Counter(), set()
    for file in (tmp_path / "w").glob("part-*"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("ascii").split("\r\n")
            assert lines[0] == "WARC/1.1"
            head = dict(line.split(": ", 1) for line in lines[1:])
            block = data[end + 4:end + 4 + int(head["Content-Length"])]
            at = end + 4 + len(block) + 4
            assert data[at - 4:at] == b"\r\n\r\n"
            kinds[head["WARC-Type"]] += 1
            assert head["WARC-Record-ID"] not in ids
            ids.add(head["WARC-Record-ID"])
            if head["WARC-Type"] == "response":
                http, block = block.split(b"\r\n\r\n", 1)
                payloads[head["WARC-Record-ID"]] = block
                assert f"Content-Length: {len(block)}".encode() in http or "WARC-Segment-Number" in head
            elif head["WARC-Type"] == "continuation":
                payloads[head["WARC-Segment-Origin-ID"]] += block
                if "WARC-Segment-Total-Length" in head:
                    whole = payloads[head["WARC-Segment-Origin-ID"]]
                    assert len(whole) == int(head["WARC-Segment-Total-Length"]) and head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(whole).hexdigest()
            else:
                assert head["WARC-Refers-To"].startswith("<urn:uuid:") and block == b""
    assert kinds["revisit"] == sum(n for r, n in _archived(_pages()).items() if r[3] == "revisit")
    assert Counter(payloads.values()) == Counter((h or "").encode() for _, _, h, *_ in _pages()) - Counter({(h or "").encode(): n - 1 for h, n in Counter(p[2] for p in _pages()).items() if n > 1 and len((h or "").encode()) >= 100})


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 3000), (2, "u", "y" * 150), (3, "u", "y" * 150)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"{tmp_path}/w", "none", 1000)
    for file in (tmp_path / "w").glob("part-*"):
        raw = file.read_bytes()
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / file.name.replace("part", "cut")).write_bytes(raw.replace(b"x" * 10, b"x" * 9 + b"z", 1).replace(b"y" * 150, b"y" * 149 + b"z"))
    assert sorted((r.page_id, r.sound) for r in warc.read_pages(spark, f"{tmp_path}/bad").collect()) == [(1, False), (2, False), (3, False)]


def test_empty_pages(spark):
    out = warc.round_trip(spark.createDataFrame([], PAGES))
    assert out.count() == 0 and out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]


def test_cuts_leave_no_separator():
    rng = random.Random(2)
    for _ in range(3000):
        data = b"".join(rng.choice((b"\r\n", b"WARC/1.1", b"WARC/1.1\r\n", b"\r", b"\n", b"x", b"WARC")) for _ in range(rng.randrange(12)))
        pieces = warc.cuts(data)
        assert b"".join(pieces) == data and all(warc.SEPARATOR.encode() not in b"\r\n\r\n" + p + b"\r\n" for p in pieces)


# periodic runs

def _runs(x):
    """By the definition: every period, every maximal stretch."""
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                out.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def _run_row(doc_id, text):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()


def test_runs_by_definition():
    rng = random.Random(11)
    for _ in range(400):
        n, letters = rng.randrange(0, 300), rng.choice((1, 2, 3, 30))
        x = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(5)):
            if n > 30:
                p, s = rng.randrange(1, n // 3), rng.randrange(n)
                for i in range(s + p, min(n, s + rng.randrange(1, n))):
                    x[i] = x[i - p]
        assert periodic_runs.find_runs(np.array(x, np.int64)) == _runs(x)


def test_fibonacci_and_nested_runs():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    nested = (([1] * 30 + [2]) * 10 + [3]) * 4
    for x in (b, nested, [0] * 24, [0] * 23, list(range(8)) * 3, (list(range(9)) * 3)[:26], list(range(500)) * 3):
        assert periodic_runs.find_runs(np.array(x, np.int64)) == _runs(x)


def test_transforms_are_exact():
    rng = np.random.default_rng(4)
    blocks, windows = rng.integers(0, 1 << 20, (5, 64)), rng.integers(0, 1 << 20, (5, 127))
    windows[2, 31:95] = blocks[2]
    windows[4, :64] = blocks[4]
    assert [tuple(t) for t in np.argwhere(periodic_runs._matches(blocks, windows))] == [(2, 31), (4, 0)]


def test_run_rows_by_definition(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (docs.where("length(text) < 6000"), odd.where("doc_id is null or doc_id <> 4")):
        got = Counter(tuple(r) for r in periodic_runs.periodic_runs(df).collect())
        assert got == Counter(_run_row(r.doc_id, r.text) for r in df.collect())
    assert periodic_runs.periodic_runs(docs).where("n_runs > 0").count() > 5
    long = periodic_runs.periodic_runs(odd.where("doc_id = 4")).first()
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 90000, 3)
    assert periodic_runs.periodic_runs(empty).count() == 0


# the registered queries

@pytest.mark.parametrize("name", ["op11_spelling", "op12_warc"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(cursor.fetchall())
