"""Periodic runs of words: stretches that repeat a short sequence at least three times.

A run of period q and length L has L >= max(24, 3q). At the scale of block length B (a power of two, 8 at
least) periods q in [B, 2B) are searched (below 16 at the first scale). Such a run holds a whole aligned block
of B words and, q words later, that block again. So each aligned block is laid over the window that follows it:
the sum of squared differences of word numbers at every distance comes from one convolution, taken as an exact
number-theoretic transform modulo two primes, and a sum of zero is an occurrence. The distances found seed
extensions, which compare words and give the maximal stretch with that period.

Two exact tests keep most blocks out of the transforms. A word of the block must come again within 2B words.
And a block whose whole reach lies in a run found at a smaller scale adds nothing: two runs that share that
many words have a common root, so they are the same run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkveil.llm.common import plain_documents, text_rows

LEAST_LENGTH = 24
LEAST_POWER = 3
FIRST_BLOCK = 8
#: Fixed values: (prime, a primitive root), each prime - 1 divisible by 2^23 and below 2^31.
PRIMES = ((998244353, 3), (2013265921, 31))
_CELLS = 1 << 18  # cells of the matrix that is transformed at once

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)

Run = tuple[int, int, int]  # start, length, period


@cache
def _roots(size: int, prime: int, root: int, inverse: bool) -> list[np.ndarray]:
    """Per butterfly stage of half-width 1, 2, 4 .. size/2: the powers of the stage's root of unity."""
    base = pow(root, (prime - 1) // size, prime)
    if inverse:
        base = pow(base, prime - 2, prime)
    full = np.ones(size // 2, np.int64)
    for i in range(1, size // 2):
        full[i] = full[i - 1] * base % prime
    return [full[:: size // (2 * half)] for half in (1 << s for s in range(size.bit_length() - 1))]


def _forward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transform of each row, in bit-reversed order."""
    count, size = rows.shape
    for powers in reversed(_roots(size, prime, root, False)):
        half = len(powers)
        parts = rows.reshape(count, size // (2 * half), 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1]
        rows = np.stack(((low + high) % prime, (low - high) % prime * powers % prime), axis=2).reshape(count, size)
    return rows


def _backward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Inverse of `_forward`."""
    count, size = rows.shape
    for powers in _roots(size, prime, root, True):
        half = len(powers)
        parts = rows.reshape(count, size // (2 * half), 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * powers % prime
        rows = np.stack(((low + high) % prime, (low - high) % prime), axis=2).reshape(count, size)
    return rows * pow(size, prime - 2, prime) % prime


def _matches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """True at (row, t) where the row's block equals its window from t on: the sum of squared differences is zero.

    The sums are taken modulo both primes, so zero is exact up to 2^60; extensions compare the words themselves.
    """
    width, reach = blocks.shape[1], windows.shape[1]
    size = 1 << (reach - 1).bit_length()
    found = None
    for prime, root in PRIMES:
        own, other = np.zeros((2, len(blocks), size), np.int64)
        own[:, :width], other[:, :reach] = blocks[:, ::-1] % prime, windows % prime
        cross = _backward(_forward(own, prime, root) * _forward(other, prime, root) % prime, prime, root)[:, width - 1:reach]
        sums = np.zeros((len(blocks), reach + 1), np.int64)
        np.cumsum(other[:, :reach] ** 2 % prime, axis=1, out=sums[:, 1:])
        squares = sums[:, width:] - sums[:, :-width] + (own ** 2 % prime).sum(axis=1)[:, None]
        zero = (squares - 2 * cross) % prime == 0
        found = zero if found is None else found & zero
    return found


def _next_distance(ids: np.ndarray) -> np.ndarray:
    """How far ahead each word stands again; beyond the end where it does not."""
    order = np.argsort(ids, kind="stable")
    away = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    away[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return away


def _agree(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """Words from `at` on, in direction `step`, that equal the word `period` later."""
    total, size, last = 0, 16, len(ids) - period
    while True:
        if step > 0:
            lo, hi = at + total, min(at + total + size, last)
        else:
            lo, hi = max(at - total - size + 1, 0), at - total + 1
        if hi <= lo:
            return total
        differ = ids[lo:hi] != ids[lo + period:hi + period]
        if differ.any():
            return total + int(differ.argmax() if step > 0 else differ[::-1].argmax())
        total, size = total + hi - lo, size * 4


def _open_blocks(away: np.ndarray, block: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Starts of the aligned blocks that can take part in a run not found yet."""
    total = len(away)
    starts = np.arange(0, total - block, block)
    starts = starts[away[: len(starts) * block].reshape(-1, block).max(axis=1) < 2 * block]
    if runs and len(starts):
        known = np.array(sorted(runs))
        reach = np.maximum.accumulate(known[:, 1])
        before = np.searchsorted(known[:, 0], starts, side="right") - 1
        inside = np.where(before >= 0, reach[before], 0) >= np.minimum(starts + 3 * block - 1, total)
        starts = starts[~inside]
    return starts


def _seeds(ids: np.ndarray, starts: np.ndarray, block: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, start) of every block's occurrence at a distance from `nearest` to 2 * block - 1, one for each chain of blocks."""
    total, reach = len(ids), 3 * block - 1 - nearest
    padded = np.concatenate((ids, np.full(3 * block, ids.max() + 1)))  # a word no block holds
    found = [np.empty((0, 2), np.int64)]
    for part in np.array_split(starts, -(-len(starts) * 2 * reach // _CELLS)):
        hits = _matches(padded[part[:, None] + np.arange(block)], padded[part[:, None] + nearest + np.arange(reach)])
        row, shift = np.nonzero(hits)
        found.append(np.stack((shift + nearest, part[row]), axis=1))
    seeds = np.concatenate(found)
    seeds = seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]
    first = np.ones(len(seeds), bool)  # the next block at the same distance lies in the same stretch
    first[1:] = (seeds[1:, 0] != seeds[:-1, 0]) | (seeds[1:, 1] != seeds[:-1, 1] + block)
    return seeds[first, 0], seeds[first, 1]


def find_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of small whole numbers, by start, then period."""
    total, runs, block, nearest = len(ids), {}, FIRST_BLOCK, 1
    if total < LEAST_LENGTH:
        return []
    away = _next_distance(ids)
    while LEAST_POWER * nearest <= total:
        starts = _open_blocks(away, block, runs)
        if len(starts):
            for period, at in zip(*map(np.ndarray.tolist, _seeds(ids, starts, block, nearest))):
                start = at - _agree(ids, at - 1, period, -1)
                end = at + _agree(ids, at, period, 1) + period
                if end - start >= max(LEAST_LENGTH, LEAST_POWER * period):
                    runs.setdefault((start, end), period)  # smaller periods come first
        block, nearest = 2 * block, 2 * block
    return sorted((start, end - start, period) for (start, end), period in runs.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the document's id asks for; without an id they stay as they are."""
    drawn = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if drawn % 10 or not words:
        return words
    much, count = drawn // 10, len(words)
    start = much % count
    period = 1 + (count - start) // (3 + much % 8)
    root, left = words[start:start + period], count - start
    return words[:start] + (root * (-(-left // period)))[:left]


def describe(words: list[bytes]) -> tuple[list[Run], list[bytes]]:
    """The runs of a sequence of words, and the words that stay when each run keeps its first period only."""
    numbers = dict(zip(dict.fromkeys(words), range(len(words))))
    runs = find_runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    if not runs:
        return runs, words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period:start + length] = False
    return runs, [words[i] for i in np.flatnonzero(stays)]


def _row(doc_id: int | None, text: str) -> tuple:
    runs, kept = describe(planted(text.encode("utf-8", "replace").split(), doc_id))
    listed = hashlib.sha256(b"".join(b"%d,%d,%d\n" % run for run in runs)).hexdigest()
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    if not runs:
        return doc_id, 0, None, None, None, None, listed, collapsed
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return doc_id, len(runs), start, length, period, 1000 * length // period, listed, collapsed


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch, ids, texts in text_rows(batches):
        rows = list(zip(*map(_row, ids, texts))) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: its runs counted, the strongest one, and digests of all runs and of the collapsed text.

    A map of the scan without a shuffle: a document is read by one task, in time n log^2 n of its n words at
    most, and memory in proportion to n. Words are parted by ASCII white space; ids name the planted
    repetitions. Null and empty texts have no words and no run. Of equally strong runs the first is named, then
    that of the smallest period. Rows that repeat a doc_id give a row each, and a null doc_id plants nothing.
    Other columns are ignored. An empty table gives no rows.
    """
    return plain_documents(docs).mapInArrow(_scan, SCHEMA)
