"""Best-fit packing of tokenised documents into sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import materialize, plain_documents, text_rows

CAPACITY = 1024
END_ID = 2
#: Pieces packed together by one task. Every group leaves about one underfull bin.
GROUP = 8192
#: Searches (each one vector operation over the underfull bins) spent on a group.
SEARCHES = 4000

_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_CACHED = 600_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Words of characters that every Unicode version classes alike; the two libraries split them alike.
_SIMPLE = re.compile("[!-~\u00a1-\u024f]+")
# Fixed value: how byte-level vocabularies of this kind split a text.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _same_merges(tokenizer):
    """The byte-level vocabulary of `tokenizer` in the library that merges words faster.

    Ids are merge ranks in such a vocabulary; its characters stand for bytes, printable ones for themselves and
    the rest, in order, for those from 256 on.
    """
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte[c] for c in name): i for name, i in tokenizer.get_vocab().items() if name not in special}
    return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Coder:
    """Token ids of whole texts, with the ids of recent words kept.

    Words of simple characters go through the same vocabulary in a faster library; the ids are the same.

    The vocabulary's own splitting never joins what stands on both sides of a single space between two
    other characters, so the words between such spaces are encoded apart and give the ids of the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.quick = _same_merges(self.tokenizer)
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.words: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, each after a space. Simple words are encoded as one text and told apart by the tokens
        that begin with a space: every word has one at its head and none inside."""
        simple = list(filter(_SIMPLE.fullmatch, words))
        if len(simple) < len(words):
            other = list(set(words).difference(simple))
            self.words.update(zip(other, self._ids([" " + w for w in other])))
        for at in range(0, len(simple), 1024):
            some = simple[at:at + 1024]
            ids = np.array(self.quick.encode_ordinary(" " + " ".join(some)), "<u4")
            cuts = (4 * np.append(np.flatnonzero(self.opens[ids]), len(ids))).tolist()
            code = ids.tobytes()
            self.words.update(zip(some, [code[i:j] for i, j in zip(cuts, cuts[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [_SAFE_CUT.split(t) if _TWO_SPACES.search(t) else t.split(" ") for t in texts]
        heads = self._ids([p[0] for p in parts])
        if len(self.words) > _CACHED:
            self.words.clear()
        known = self.words
        self._learn([w for w in set().union(*(p[1:] for p in parts)) if w not in known])
        return [h + b"".join([known[w] for w in p[1:]]) for h, p in zip(heads, parts)]


@functools.lru_cache(1)
def _coder(path: str) -> Coder:
    return Coder(path)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids; only the first may be shorter than the rest."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then the end id, cut at `capacity`."""
    path, end = vocabulary or default_vocabulary(), np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for _, ids, texts in text_rows(batches):
            for at in range(0, len(ids), 128):
                out = []
                for doc, code in zip(ids[at:at + 128], coder.encode(texts[at:at + 128])):
                    code += end
                    for number, (start, length) in enumerate(cut(len(code) // 4, capacity)):
                        own = code[4 * start:4 * (start + length)]
                        row = (doc, number, start, length, zlib.crc32(own))
                        out.append((*row, np.frombuffer(own, "<i4")) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return plain_documents(docs).mapInArrow(scan, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit, longest first: bins as lists of positions in `lengths`. Open bins are found by a bit set of free space."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f: a bin with f free is open
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = some >> lengths[i]
        if fits:
            room = lengths[i] + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        left = room - lengths[i]
        free[left].append(at)
        some |= 1 << left
    return bins


def swap_search(lengths: list[int], bins: list[list[int]], capacity: int, searches: int = SEARCHES) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    Takes the emptiest bin, gives its documents (or what is longer than what it gets back) to bins that are
    at least as full, and goes on while a step helps, searches are left and fewer bins are possible at all.
    """
    size = np.array(lengths, np.int64)
    fill = np.array([size[b].sum() if b else 0 for b in bins], np.int64)
    fewest = -(-int(size.sum()) // capacity)
    home = np.empty(len(size), np.int64)
    for at, b in enumerate(bins):
        home[b] = at
    members = [set(b) for b in bins]
    used = sum(1 for b in bins if b)

    def put(doc: int, to: int) -> None:
        members[home[doc]].discard(doc)
        fill[home[doc]] -= size[doc]
        members[to].add(doc)
        fill[to] += size[doc]
        home[doc] = to

    stuck: set[int] = set()
    while searches > 0 and used > fewest:
        open_bins = [int(b) for b in np.flatnonzero((fill > 0) & (fill < capacity)) if int(b) not in stuck]
        if len(open_bins) < 2:
            break
        target = min(open_bins, key=lambda b: fill[b])
        moved = False
        docs = np.flatnonzero((fill[home] < capacity) & (home != target))  # in underfull bins
        rows = sorted(members[target], key=lambda d: -size[d])
        offers = [(d,) for d in rows] + [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:]][:64]
        for offer in offers:
            given = int(size[list(offer)].sum())
            searches -= 1
            if len(offer) == 1:
                room = np.where((fill > 0) & (np.arange(len(fill)) != target) & (fill >= fill[target]) & (fill + given <= capacity), fill, -1)
                if room.max() >= 0:
                    put(offer[0], int(room.argmax()))
                    moved = True
                    break
            gain = given - size[docs]
            good = (gain > 0) & (fill[home[docs]] + gain <= capacity) & (fill[home[docs]] >= fill[target])
            if good.any():
                back = int(docs[np.where(good, gain, -1).argmax()])
                to = int(home[back])
                put(back, target)
                for d in offer:
                    put(d, to)
                moved = True
                break
        used -= not members[target]
        if moved:
            stuck.clear()  # every step raises the sum of squares, so this ends
        else:
            stuck.add(target)
    return [sorted(m) for m in members if m]


def _pack_group(capacity: int, searches: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, ignore_index=True)
        lengths = group["length"].tolist()
        bins = swap_search(lengths, best_fit(lengths, capacity), capacity, searches)
        sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        for number, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        return group.assign(sequence_id=group["part"] * (1 << 32) + sequence, offset=offset).drop(columns="part")

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP, searches: int = SEARCHES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every document.

    Pieces as long as a sequence are one already and are not moved. The others are dealt by their place in
    the written table into groups of about `group` rows, so no key can fill one; each group is packed by a
    task of its own. Null text is empty, and an empty document is the one end id. Repeated rows and null
    doc_ids are packed like all others. Other columns are ignored. An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity), "packing-pieces")
    whole, part = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group))
    dealt = part.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("part").applyInPandas(_pack_group(capacity, searches), schema)
    full = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
