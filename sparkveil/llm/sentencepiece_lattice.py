"""SentencePiece encoding over a relational lattice, and decoding.

Documents are read in blocks; a block is one row with its distinct parts of words and, per document, the order
they come in. Blocks are dealt by one shuffle, the only one. Every substring of a part up to the longest piece is
joined to the piece table; the joined substrings are the edges of the part's lattice, grouped by block and part
(which needs no shuffle of its own, the blocks being partitioned already) and folded by Spark's `aggregate`.

The model at hand is a byte-pair model: its pieces carry merge ranks, not log probabilities, so the best path
is not the one with the largest sum of scores. The fold takes the edges in merge order over the set of piece
boundaries of the part instead: an edge that spans exactly two current pieces joins them. What remains is the
path, and characters without a piece become byte pieces. The set is the bits of one number; the rare part too
long for that has it as a string.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sparkveil.llm.common import plain_documents

SPACE = "▁"
#: Bytes of text in a block.
BLOCK = 4_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(1)
def pieces(path: str) -> tuple[tuple[str, int, int, int, int], ...]:
    """(piece, id, turn, shift, span) of the pieces that merging can make, control and byte pieces left out.

    `turn` is the rank of the last merge a piece needs when it is built alone, `shift` the place in the piece
    where that merge begins (the last such place among merges of one rank) and `span` its length. Edges taken
    by turn, then by start plus shift, span and length never come before their parts. The table has as many
    rows as the vocabulary file.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in plain}
    ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    rank = {p: ranks[s] for p, s in score.items()}
    if len(ranks) >= 1 << 17:
        raise ValueError("more merge ranks than an edge can hold")

    def built(piece: str) -> tuple[int, int, int]:
        parts, last = list(piece), (0, 0, 1)
        while len(parts) > 1:
            options = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not options:
                return (1 << 17) - 1, 0, len(piece)  # cannot be reached
            order, i = min(options)
            last = max(last, (order, sum(map(len, parts[:i])), len(parts[i]) + len(parts[i + 1])))
            parts[i:i + 2] = ["".join(parts[i:i + 2])]
        return last

    return tuple((p, model.piece_to_id(p), *built(p)) for p in rank)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, turn, shift, span): as many rows as the vocabulary file has pieces."""
    return spark.createDataFrame([*pieces(path)], "piece string, id int, turn int, shift int, span int")


#: Cells of the table of character pairs; a pair that shares a cell with a piece's pair is only cut too little.
_PAIRS = 1 << 20


def _pair_cells(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(40503) + right) & np.uint32(_PAIRS - 1)


@functools.lru_cache(1)
def neighbours(path: str) -> np.ndarray:
    """By cell, whether two characters stand side by side in some piece. Between others no piece can reach across."""
    pairs = "".join({p[i:i + 2] for p, *_ in pieces(path) for i in range(len(p) - 1)})
    codes = np.frombuffer(pairs.encode("utf-32-le"), np.uint32).reshape(-1, 2)
    table = np.zeros(_PAIRS, bool)
    table[_pair_cells(codes[:, 0], codes[:, 1])] = True
    return table


def split_parts(texts: pa.Array, pairs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts that merging works on apart, one after the other, and how many each text has.

    A text stands after a space mark, with its spaces as marks; an empty one has none.
    """
    marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), "")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", marked)
    borders = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset:marked.offset + len(marked) + 1]
    data = marked.buffers()[2].slice(int(borders[0]), int(borders[-1] - borders[0])) if borders[-1] > borders[0] else pa.py_buffer(b"")
    borders = borders - borders[0]
    codes = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    cut = np.ones(len(codes) + 1, bool)
    if len(codes):
        np.logical_not(pairs[_pair_cells(codes[:-1], codes[1:])], out=cut[1:-1])
    first = np.empty(len(data) + 1, bool)  # bytes a part or text begins at, and the end
    first[-1] = True
    first[:-1] = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    first[first] = cut
    first[borders] = True
    offsets = np.flatnonzero(first).astype(np.int32)
    counts = np.diff(np.searchsorted(offsets, borders))
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), data]), counts


def _block_scan(path: str):
    def row(block: int, ids: list, texts: list) -> pa.RecordBatch:
        parts, counts = split_parts(pa.concat_arrays(texts), neighbours(path))
        coded = parts.dictionary_encode()
        order = coded.indices.to_numpy().astype(np.uint32)
        # Places take fewer bytes apart by their high and low bytes.
        body = np.concatenate([np.array([len(counts)], np.int64).view(np.uint8), pa.concat_arrays(ids).to_numpy(zero_copy_only=False).view(np.uint8), counts.astype(np.int64).view(np.uint8), order.view(np.uint8).reshape(-1, 4).T.ravel()])
        body = len(body).to_bytes(8, "little") + pa.compress(body.tobytes(), "zstd", asbytes=True)
        words = pa.concat_arrays([pa.array([""]), coded.dictionary])  # the first row of a block is that of its body
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([body], pa.binary())], ["block", "words", "body"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            doc, null, text = batch.column(0).fill_null(0), batch.column(0).is_null(), batch.column(1).cast(pa.string())
            doc = pa.array(np.stack([doc.to_numpy(zero_copy_only=False), null.to_numpy(zero_copy_only=False).astype(np.int64)], 1).ravel())  # a pair per row
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(text):
                done = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, done + BLOCK - size)) + 1, len(text))
                ids.append(doc[2 * at:2 * to])
                texts.append(text[at:to])
                size, at = size + int(ends[to - 1]) - done, to
                if size >= BLOCK:
                    yield row(block, ids, texts)
                    ids, texts, size, block = [], [], 0, block + 1
        if ids:
            yield row(block, ids, texts)

    return scan


#: Bits of the filter that substrings pass before the join; it only ever lets too many through.
FILTER_BITS = 1 << 18
#: Characters up to which the boundaries of a part are the bits of one number.
SHORT = 62
# An edge is its place in merge order, turn (17 bits), start plus shift, span and length, then start and id: one number in
# a short part, with 6 bits for each of the middle four but 5 for the length, and two in others. An id has 22 bits; a
# character without a piece is the highest of them and the character's code.
_ID, _START, _LENGTH, _SPAN, _AT, _TURN = (1 << n for n in (22, 22, 28, 33, 39, 45))
_UNKNOWN = 1 << 21


def _numbers_literal(values) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)"


def _filter_words(table: DataFrame) -> str:
    """SQL array of the filter's 64-bit words: a bit per hash of a piece."""
    bits = np.zeros(FILTER_BITS, bool)
    bits[[r[0] for r in table.select(F.pmod(F.xxhash64("piece"), F.lit(FILTER_BITS))).collect()]] = True  # a row per piece
    return _numbers_literal(np.packbits(bits, bitorder="little").view("<i8"))


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(block, at, word, edges, long_edges, body): the lattice of every row of `words` (block, at, word, body; partitioned by block).

    Edges are the substrings of two characters or more that are pieces. Every part has a row besides, with start
    -1 and its word, so that one without edges stays; that of a body has an empty word.
    """
    starts = words.select("*", F.expr("length(word) AS size"), F.expr("explode(sequence(-1, greatest(length(word) - 2, -1))) AS start"))
    subs = starts.select("*", F.expr(f"explode(if(start < 0, array(0), sequence(2, least({longest}, size - start)))) AS length"))
    most = SHORT if longest < 32 else 0
    place = f"if(size <= {most}, start * {_AT + _START}L + length * {_LENGTH}L, start * 256L + length) AS place"
    subs = subs.select("block", "at", "body", "word", "size", "start", F.expr(place), F.expr("if(start < 0, null, substring(word, start + 1, length)) AS text"))
    likely = f"getbit(element_at({_filter_words(table)}, cast(pmod(xxhash64(text), {FILTER_BITS}) div 64 AS int) + 1), cast(pmod(xxhash64(text), 64) AS int)) = 1"
    own = F.expr("if(start < 0, word, null) AS word"), F.expr("if(start < 0, body, null) AS body")
    subs = subs.where(f"start < 0 OR {likely}").select("block", "at", "size", "place", "text", *own)
    base = table.select("piece", F.expr(f"turn * {_TURN}L + shift * {_AT}L + span * {_SPAN}L + id AS base"))
    edges = subs.join(F.broadcast(base), F.col("text") == F.col("piece"), "left").where("base IS NOT NULL OR word IS NOT NULL")
    key = f"((base div {_TURN}) * {1 << 30} + place div 256 + (base div {_AT}) % 64) * {1 << 16} + (base div {_SPAN}) % 64 * 256 + place % 256"
    return edges.groupBy("block", "at").agg(
        F.expr("get(collect_list(word), 0) AS word"),
        F.expr(f"collect_list(if(size <= {most}, place + base, null)) AS edges"),
        F.expr(f"collect_list(if(size > {most} AND base IS NOT NULL, struct({key} AS key, place div 256 * {_ID} + base % {_ID} AS code), null)) AS long_edges"),
        F.expr("get(collect_list(body), 0) AS body"),
    )


def _letters(table: DataFrame) -> str:
    """SQL array of the ids of single characters by their code, 0 where there is none."""
    known = {ord(r.piece): r.id for r in table.where("length(piece) = 1").collect()}  # at most a row per piece
    return _numbers_literal(known.get(i, 0) for i in range(max(known, default=0) + 1))


def _numbers(codes: str) -> str:
    """SQL array of the ids of the array `codes` in its order, those of a character without a piece as its bytes."""
    c = f"cast(c & {_UNKNOWN - 1} AS int)"
    tail = lambda n: f"131 + ({c} div {64 ** n}) % 64"
    utf8 = f"""CASE WHEN {c} < 128 THEN array({c} + 3) WHEN {c} < 2048 THEN array(195 + {c} div 64, {tail(0)})
        WHEN {c} < 65536 THEN array(227 + {c} div 4096, {tail(1)}, {tail(0)}) ELSE array(243 + {c} div 262144, {tail(2)}, {tail(1)}, {tail(0)}) END"""
    plain = f"transform({codes}, c -> cast(c & {_ID - 1} AS int))"
    other = f"flatten(transform({codes}, c -> if(c & {_UNKNOWN} = 0, array(cast(c & {_ID - 1} AS int)), transform({utf8}, x -> cast(x AS int)))))"
    return f"if(exists({codes}, c -> c & {_UNKNOWN} > 0), {other}, {plain})"


def fold(lattices: DataFrame, table: DataFrame) -> DataFrame:
    """(block, at, ids, body): the path of every lattice."""
    # By length and start: the bits of an edge with its ends, and between them.
    spans = [(n, s) for n in range(32) for s in range(64)]
    signed = lambda x: ((x & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)
    place = f"cast(shiftright(e, 22) & {(1 << 11) - 1} AS int)"
    over = f"get({_numbers_literal(signed(((2 << n) - 1) << s) for n, s in spans)}, {place})"
    inner = f"get({_numbers_literal(signed(((1 << n) - 2) << s if n else 0) for n, s in spans)}, {place})"
    # Characters that stay alone; those without a piece keep their code.
    letter = "ascii(substring(word, s + 1, 1))"
    alone = f"s * {_ID}L + if(coalesce(get(letters, {letter}), 0) = 0, {_UNKNOWN} + {letter}, get(letters, {letter}))"
    alone = f"transform(filter(sequence(0, length(word) - 1), s -> %s), s -> {alone})".replace("letters", _letters(table))
    # The bits of m are the places that are no boundary any more. Where one bit differs it is the boundary between two
    # pieces, or an end inside a longer piece; then all bits between are set already.
    short = f"""
        transform(
          array(aggregate(sort_array(edges), 0L, (m, e) -> if(bit_count((m & {over}) ^ {inner}) = 1, m | {inner}, m))),
          m -> sort_array(concat(transform(filter(edges, e -> m & {over} = {inner}), e -> e & {_LENGTH - 1}), {alone % "shiftright(m, s) & 3 = 0"})))[0]"""
    wide_start, wide_length = f"cast(e.code div {_ID} AS int)", "cast(e.key % 256 AS int)"
    own = f"substring(b, {wide_start} + 1, {wide_length} + 1)"
    mark = f"concat('1', repeat('0', {wide_length} - 1), '1')"
    wide = f"""
        transform(
          array(aggregate(array_sort(long_edges), repeat('1', length(word) + 1),
            (b, e) -> if({own} RLIKE '^10*10*1$', overlay(b PLACING {mark} FROM {wide_start} + 1 FOR {wide_length} + 1), b))),
          b -> sort_array(concat(transform(filter(long_edges, e -> {own} = {mark}), e -> e.code), {alone % "substring(b, s + 1, 2) = '11'"})))[0]"""
    ids = _numbers("path")
    path = f"CASE WHEN word = '' THEN cast(array() AS array<bigint>) WHEN size(long_edges) > 0 THEN {wide} ELSE {short} END"
    # A long part without edges is all letters.
    path = f"if(length(word) > {SHORT} AND size(long_edges) = 0, {alone % 'true'}, {path})"
    return lattices.select("block", "at", F.expr(f"transform(array({path}), path -> {ids})[0]").alias("ids"), "body")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            packed = batch.column(0)[i].as_py()
            body = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
            n = int(np.frombuffer(body, np.int64, 1)[0])
            ids = np.frombuffer(body, np.int64, 2 * n, 8).reshape(-1, 2)
            sizes = np.frombuffer(body, np.int64, n, 8 + 16 * n)
            order = np.ascontiguousarray(np.frombuffer(body, np.uint8, -1, 8 + 24 * n).reshape(4, -1).T).view(np.uint32).ravel()
            known = batch.column(1)[i].values
            at, codes = known.field(0).to_numpy() - 1, known.field(1)
            lengths, values = np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy()
            first = np.empty(len(at), np.int64)
            size = np.empty(len(at), np.int64)
            first[at], size[at] = np.cumsum(lengths) - lengths, lengths  # the body's row, at place -1, has none
            borders = np.concatenate(([0], np.cumsum(sizes)))
            docs = pa.array(ids[:, 0], mask=ids[:, 1] == 1)
            # In slices, as each id takes several numbers on its way.
            low = 0
            while low < n:
                high = max(int(np.searchsorted(borders, borders[low] + (1 << 18), "right")) - 1, low + 1)
                own = order[borders[low]:borders[high]]
                each = size[own]
                ends = np.concatenate(([0], np.cumsum(each)))
                flat = values[np.repeat(first[own] - ends[:-1], each) + np.arange(ends[-1])]
                offsets = ends[borders[low:high + 1] - borders[low]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs[low:high], lists], ["doc_id", "ids"])
                low = high


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) per row of `docs`, the ids of the SentencePiece model for the whole text.

    Null and empty texts have no ids. Repeated rows and null doc_ids have a row each. Other columns are ignored.
    An empty table gives no rows.
    """
    spark, path = docs.sparkSession, model or default_model()
    longest = max(len(p) for p, *_ in pieces(path))
    docs = plain_documents(docs)
    # Few bytes here are many edges, so the number of partitions is that of the blocks and not what the bytes suggest.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions")) + total // BLOCK
    blocks = docs.mapInArrow(_block_scan(path), "block long, words array<string>, body binary").repartition(partitions, "block")
    words = blocks.select("block", "body", F.posexplode("words").alias("at", "word"))
    words = words.select("block", "at", "word", F.expr("if(at = 0, body, null)").alias("body"))
    table = piece_table(spark, path)
    coded = fold(lattice(words, table, longest), table)
    known = coded.groupBy("block").agg(F.expr("get(collect_list(body), 0)").alias("body"), F.collect_list(F.struct("at", "ids")).alias("known"))
    return known.select("body", "known").mapInArrow(_assemble, "doc_id long, ids array<int>")


@functools.lru_cache(1)
def id_bytes(path: str) -> list[bytes]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).encode()
        for i in range(model.get_piece_size())
    ]


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """`encoded` with a column `decoded`: the text of `ids`; null ids give null."""
    names = pa.array(id_bytes(model or default_model()), pa.binary())

    def texts(ids: pa.ListArray) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        found = names.take(ids.flatten())
        ends = np.frombuffer(found.buffers()[1], np.int32)[np.concatenate(([0], np.cumsum(sizes)))] if len(found) else np.zeros(len(ids) + 1, np.int32)
        joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), found.buffers()[2] or pa.py_buffer(b"")])
        try:
            plain = pc.replace_substring(joined.cast(pa.string()), SPACE, " ")
        except pa.ArrowInvalid:  # ids that do not make up whole characters
            plain = pa.array([x.decode("utf-8", "replace").replace(SPACE, " ") for x in joined.to_pylist()], pa.string())
        plain = pc.replace_substring_regex(plain, "^ ", "", max_replacements=1)
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for low in range(0, batch.num_rows, 256):  # few rows at once, as texts take more than their ids
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, texts(part.column(at))], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", StringType()))
