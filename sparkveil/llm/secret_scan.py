"""Secret scan: three base patterns, and name-literal pairs lexed from source and configuration syntax.

The lexer reads `name = literal`, `name: literal`, `name => literal`, `name := literal` and `"name": literal`,
with quoted literals, bare values, sums of literals and names (`a + "x"`). A name on the right stands for the
literals last assigned to it in the same document, so a constant that reaches a sensitive name is found where
it was written. A literal's score is that of the most sensitive name it reaches, weighted by how random it
looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import plain_documents, text_rows

# The base patterns, the order of kinds, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: How much a part of a name says that its value is secret.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "bearer": 0.8, "auth": 0.6,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "none", "null", "true", "false", "todo", "dummy")
LEAST_SCORE = 0.5

_SIGN = re.compile(r":=|=>|[:=]")
_NAME_START = re.compile(r"[A-Za-z_]")
_NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_TERM = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9_+/.\-]+={0,2}))""")
_PLUS = re.compile(r"[ \t]*\+")
_HAS_HEX_RUN = re.compile(r"[0-9a-f]{24}")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_VALUE_PARTS = re.compile(r"[A-Z]?[a-z]+[0-9]*|[A-Z]+(?![a-z])[0-9]*|[0-9]+")
_PLAIN = re.compile(r"[A-Za-z0-9 _.\-/<>(){}\[\]$%*]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _HAS_HEX_RUN.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def name_weight(name: str) -> float:
    """Weight of a target name by its parts: db_password, apiKey, service.auth-token."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_WEIGHT.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def is_placeholder(value: str) -> bool:
    """Whether a separate part of the value is a placeholder, digits behind it aside, and all others are plain words: your-api-key, changeme1.

    A placeholder inside a word (trueblue), or beside a part with digits or other signs (Horse9!), leaves the value a literal.
    """
    if not _PLAIN.fullmatch(value):
        return False
    parts = _VALUE_PARTS.findall(value)
    words = [p.lower().rstrip("0123456789") for p in parts]
    marks = [w in PLACEHOLDERS or len(w) >= 4 and not w.strip("x") for w in words]
    return any(marks) and all(mark or p.isalpha() for mark, p in zip(marks, parts))


def literal_weight(value: str) -> float:
    """0 to 1: length, bits per character and kinds of characters; placeholders and plain words weigh little."""
    if len(value) < 6 or is_placeholder(value):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.4 * min(1.0, bits / 3.5) + 0.3 * min(1.0, len(value) / 12) + 0.3 * (min(kinds, 3) - 1) / 2)


def name_before(text: str, at: int) -> str | None:
    """The whole name that ends before the sign at `at`: behind it at most a quote, a bracket, blanks and a line's end.

    Signs are neither blanks nor name characters, so no character is passed for two signs.
    """
    if at and text[at - 1] == "\n":
        at -= 1
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] == "]":
        at -= 1
    if at and text[at - 1] in "\"'":
        at -= 1
    start = at
    while start and text[start - 1] in _NAME_CHARACTERS:
        start -= 1
    first = _NAME_START.search(text, start, at)
    return text[first.start():at] if first else None


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int] | str]]]:
    """(name, terms) for every assignment: a term is a literal (value, start, end) or the name of another constant."""
    after = 0
    for sign in _SIGN.finditer(text):
        if sign.start() < after:
            continue
        name = name_before(text, sign.start())
        if not name:
            continue
        terms, at = [], sign.end()
        while (term := _TERM.match(text, at)) and term.end() > at:
            group = term.lastindex
            value, (start, end) = term[group], term.span(group)
            if group == 3 and re.fullmatch(r"[A-Za-z_]\w*", value, re.ASCII):
                terms.append(value)
            if group < 3 or not value.isalpha():
                terms.append((value, start, end))
            at = term.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if terms:
            after = sign.end()
            yield name, terms


def literal_spans(text: str, least: float = LEAST_SCORE) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) of literals that reach a sensitive name."""
    if ":" not in text and "=" not in text:
        return []
    # A constant is a node: its literals and the nodes it was built from, and the weight it has been scored with.
    constants: dict[str, list] = {}
    best: dict[tuple[int, int], float] = {}
    for name, terms in pairs(text):
        node = [[constants[t] if isinstance(t, str) else t for t in terms if not isinstance(t, str) or t in constants], 0.0]
        constants[name] = node
        weight, rest = name_weight(name), [node]
        while weight and rest:
            node = rest.pop()
            if node[1] >= weight:
                continue
            node[1] = weight
            for part in node[0]:
                if isinstance(part, list):
                    rest.append(part)
                    continue
                value, start, end = part
                score = weight * literal_weight(value)
                if score >= least:
                    best[start, end] = max(score, best.get((start, end), 0.0))
    return sorted((start, 3, end, score) for (start, end), score in best.items())


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans by start, then kind; base spans have score 1."""
    spans = [(*s, 1.0) for s in base_spans(text)] + literal_spans(text)
    return [(KINDS[kind], start, end, score) for start, kind, end, score in sorted(spans)]


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """`text` with every found span, overlapping ones together, replaced by `mark`."""
    out, at = [], 0
    for _, start, end, _ in find(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) per row of `docs`; places are code points, ends exclusive.

    Null text counts as empty and has no spans. Rows are handled one by one, so repeated rows, null doc_ids
    and other columns change nothing; an empty table gives no rows.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, texts in text_rows(batches):
            spans = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return plain_documents(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets in `text` replaced; rows, order of columns and nulls stay."""
    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redacted, na_action="ignore")

    return docs.withColumn("text", clean("text"))


def digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from the rows of `scan`."""
    def joined(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests and single records."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()
