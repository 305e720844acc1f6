"""WARC archives from page tables and back, through a table of chunks.

A payload travels as rows (record, chunk number) of at most 64 KiB. Tasks see one chunk at a time and carry the
running SHA-256 of the record they are in, so no task outside the scan holds a whole oversized payload. In the
archive a payload of one chunk is one record; a larger one is a segmented record of the format: a `response`
with segment number 1, then `continuation` records, the last of which names the total length and the digest of
the whole payload. Payloads that repeat an earlier one are `revisit` records without a payload.

A record ends in two line ends and the next one begins with the version line, so Spark's text reader takes that
sequence as its separator and a row is one record or segment. The writer cuts a payload inside any such
sequence, which keeps the separator unambiguous. Reading and writing go through Spark's own text source:
any file system it knows will do.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm.common import ROW_KEY, materialize, with_row_keys
from sparkveil.session import run_dir

CHUNK = 1 << 16
#: Payloads below this many bytes are stored again rather than referred to.
LEAST_REVISIT = 100
#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
SEPARATOR = f"{END}{VERSION}\r\n"
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
_SAFE_URL = "".join(map(chr, range(33, 127)))


# from pages to chunks

def page_rows(pages: DataFrame) -> DataFrame:
    """(ROW_KEY, page_id, url, payload): the columns an archive takes, with a key of the row that rises with page_id."""
    named = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return with_row_keys(named).withColumnRenamed("doc_id", "page_id")


def chunk_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """`rows` with (chunk, final, data) in place of `payload`: a row per chunk, in order; an empty payload is one empty chunk."""
    last = F.expr(f"cast(greatest(octet_length(payload) - 1, 0) div {size} as int)")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("payload", i * size + 1, F.lit(size)))
    cut = rows.select(*[c for c in rows.columns if c != "payload"], last.alias("last"), F.posexplode(parts).alias("chunk", "data"))
    return cut.withColumn("final", F.expr("chunk = last")).drop("last")


class _Running:
    """The digest and length of the record whose chunks are passing by."""

    def __init__(self):
        self.key, self.sha, self.size, self.chunks = None, None, 0, 0

    def add(self, key, data: bytes) -> None:
        if self.chunks == 0 or key != self.key:
            self.key, self.sha, self.size, self.chunks = key, hashlib.sha256(), 0, 0
        self.sha.update(data)
        self.size += len(data)
        self.chunks += 1

    def close(self) -> tuple[int, str]:
        out = self.size, self.sha.hexdigest()
        self.chunks = 0
        return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, page_id, url, final, data) -> one row per record, when its final chunk passes."""
    run = _Running()
    for batch in batches:
        out = []
        keys, ids, urls, finals = (batch.column(i).to_pylist() for i in range(4))
        for i, key in enumerate(keys):
            run.add(key, batch.column(4)[i].as_py())
            if finals[i]:
                out.append((key, ids[i], urls[i], *run.close()))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page_id", "url", "payload_bytes", "payload_digest"])


def record_table(chunks: DataFrame) -> DataFrame:
    """(key, page_id, url, payload_bytes, payload_digest) per record of a chunk table whose tasks hold records whole and in order."""
    return chunks.select(ROW_KEY, "page_id", "url", "final", "data").mapInArrow(_digest, "key long, page_id long, url string, payload_bytes long, payload_digest string")


# records as bytes

def _urn(collection: str, key: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{collection}/{key}')}>"


def _header(kind: str, record_id: str, at: str, length: int, fields: list[tuple[str, object]]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {at}", f"Content-Length: {length}"]
    lines += [f"{name}: {value}" for name, value in fields if value is not None]
    return ("\r\n".join(lines) + END).encode("ascii")


def _address(url: str | None) -> str | None:
    """The address with blanks, line ends and other than ASCII letters escaped."""
    return None if url is None else quote(url, safe=_SAFE_URL)


def cuts(data: bytes) -> list[bytes]:
    """The chunk in pieces, such that none next to a header or the end of a record makes up a separator."""
    probe, mark, pieces, at, found = END.encode() + data + b"\r\n", SEPARATOR.encode(), [], 0, -1
    while (found := probe.find(mark, found + 1)) >= 0:
        pieces.append(data[at:found + 2])
        at = found + 2
    return [*pieces, data[at:]]


def _response_writer(collection: str, at: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Running()
        for batch in batches:
            out = []
            keys, ids, urls, sizes, finals = (batch.column(i).to_pylist() for i in range(5))
            for i, key in enumerate(keys):
                pieces = cuts(batch.column(5)[i].as_py())
                for n, piece in enumerate(pieces):
                    final = finals[i] and n == len(pieces) - 1
                    run.add(key, piece)
                    number, origin = run.chunks, _urn(collection, key)
                    fields: list[tuple[str, object]] = []
                    if number == 1:
                        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {sizes[i]}{END}".encode("ascii")
                        fields += [("WARC-Target-URI", _address(urls[i])), ("Content-Type", "application/http;msgtype=response"), ("WARC-Page-ID", ids[i])]
                    else:
                        head = b""
                        fields += [("WARC-Segment-Origin-ID", origin)]
                    if number > 1 or not final:
                        fields += [("WARC-Segment-Number", number)]
                    if final:
                        total, digest = run.close()
                        fields += [("WARC-Payload-Digest", f"sha256:{digest}")]
                        if number > 1:
                            fields += [("WARC-Segment-Total-Length", total)]
                    name = origin if number == 1 else _urn(collection, f"{key}/{number}")
                    block = head + piece
                    out.append(_header("response" if number == 1 else "continuation", name, at, len(block), fields) + block + END.encode()[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return write


def _revisit_writer(collection: str, at: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                _header("revisit", _urn(collection, key), at, 0, [
                    ("WARC-Target-URI", _address(url)), ("WARC-Page-ID", page), ("WARC-Refers-To", _urn(collection, first)),
                    ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE),
                ]) + END.encode()[:-1]
                for key, page, url, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5)))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return write


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", chunk: int = CHUNK, at: str | None = None) -> str:
    """Write a record per row of `pages` (page_id, url, html) as WARC files below `path`, and return the path.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, told by their SHA-256, the first by page_id is a
    response and the others refer to it. Digests are counted per payload before anything is joined, so a payload
    with a third of the rows sends one row per task; only rows of identifiers and digests are shuffled. Payloads
    are not, unless the revisits are more than Spark broadcasts (spark.sql.autoBroadcastJoinThreshold).

    Null html is an empty payload. Null urls and page_ids leave their field out. Rows that repeat a page_id are
    records of their own, in no particular order among themselves. Other columns are ignored. `at` is the date
    of all records, else now. An empty table gives an archive without records.
    """
    collection, at = uuid.uuid4().hex, at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = page_rows(pages)
    records = materialize(record_table(chunk_rows(rows, chunk)), "warc-records")
    firsts = records.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.where("copies > 1").drop("copies")
    revisits = materialize(records.join(firsts, "payload_digest").where("key <> first").select("key", "page_id", "url", "payload_digest", "first"), "warc-revisits")
    again = revisits.select(F.col("key").alias("again"))
    first_seen = rows.withColumn("size", F.octet_length("payload").cast("long")).join(again, F.col(ROW_KEY) == F.col("again"), "left_anti")
    responses = chunk_rows(first_seen, chunk).select(ROW_KEY, "page_id", "url", "size", "final", "data").mapInArrow(_response_writer(collection, at), "record binary")
    both = responses.union(revisits.mapInArrow(_revisit_writer(collection, at), "record binary"))
    # the text source ends each row with the line feed that the record still lacks
    both.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)
    return path


# and back

def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A row per record or segment below `path`: record_id, type, page_id, url, refers_to_id, digest, segment, origin_id, total, whole, data.

    `data` is the payload without headers; `whole` tells whether the block is as long as it says, which fails in
    archives written elsewhere whose payloads hold the separator. Files are split by Spark where their
    compression allows it.
    """
    text = spark.read.option("lineSep", SEPARATOR).text(path)
    rows = text.select(F.col("value").cast("binary").alias("row"), F.substring_index("value", END, 1).alias("header"))
    rows = rows.withColumn("length", _field("Content-Length").cast("long"))
    rows = rows.withColumn("block", F.substring("row", F.octet_length("header") + 5, F.col("length").cast("int")))
    segment = _field("WARC-Segment-Number").cast("int")
    over_http = F.coalesce(_field("Content-Type").startswith("application/http"), F.lit(False)) & (F.coalesce(segment, F.lit(1)) == 1)
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    return rows.select(
        _field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("type"), _field("WARC-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Refers-To").alias("refers_to_id"),
        F.regexp_extract(F.coalesce(_field("WARC-Payload-Digest"), F.lit("")), "^sha256:([0-9a-f]{64})$", 1).alias("digest"), segment.alias("segment"),
        _field("WARC-Segment-Origin-ID").alias("origin_id"), _field("WARC-Segment-Total-Length").cast("long").alias("total"),
        (F.octet_length("block") == F.col("length")).alias("whole"),
        F.when(over_http, F.substring("block", http + 1, F.octet_length("block"))).otherwise(F.col("block")).alias("data"),
    )


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin, segment, page_id, digest, total, whole, data), ordered -> one row per segmented record."""
    run, sound, page = _Running(), True, None
    for batch in batches:
        out = []
        origins, segments, pages, digests, totals, wholes = (batch.column(i).to_pylist() for i in range(6))
        for i, origin in enumerate(origins):
            run.add(origin, batch.column(6)[i].as_py())
            if run.chunks == 1:
                sound, page = True, pages[i]
            sound = sound and wholes[i] and segments[i] == run.chunks
            if totals[i] is not None:  # the last segment
                size, digest = run.close()
                out.append((origin, page, size, digest, sound and size == totals[i] and digest == digests[i]))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "page_id", "payload_bytes", "payload_digest", "sound"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, sound) per record of the archives below `path`.

    Lengths and digests are those of the payloads read, a revisit's those of the response it refers to; `sound`
    tells whether they are what the archive states. Segments of oversized payloads, and only these, are sorted
    by record and number and digested as they pass; such a record is read by one task, a chunk at a time. A
    segmented record without its last segment, and a revisit without its response, give no row.
    """
    chunks = read_chunks(spark, path)
    single = chunks.where("type = 'response' AND segment IS NULL").withColumn("own", F.sha2("data", 256)).select(
        "record_id", "page_id", F.octet_length("data").cast("long").alias("payload_bytes"), F.col("own").alias("payload_digest"),
        (F.col("whole") & (F.col("own") == F.col("digest"))).alias("sound"),
    )
    segments = chunks.where("segment IS NOT NULL").select(
        F.coalesce("origin_id", "record_id").alias("origin"), "segment", "page_id", "digest", "total", "whole", "data"
    ).repartition("origin").sortWithinPartitions("origin", "segment")
    responses = single.union(segments.mapInArrow(_assemble, "record_id string, page_id long, payload_bytes long, payload_digest string, sound boolean"))
    responses = materialize(responses, "warc-read")
    revisits = chunks.where("type = 'revisit'").select("page_id", "refers_to_id", "digest")
    first = responses.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", "sound")
    found = revisits.join(first, F.col("refers_to_id") == F.col("record_id")).select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to",
        (F.col("sound") & (F.col("digest") == F.col("payload_digest"))).alias("sound"),
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "sound"
    ).union(found)


def round_trip(pages: DataFrame) -> DataFrame:
    """`pages` written to archives in a new folder below spark.checkpoint.dir and read back; see the two functions."""
    spark = pages.sparkSession
    return read_pages(spark, write_archives(pages, run_dir(spark, "warc")))
