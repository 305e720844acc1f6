"""Exact top-k search by distributed histogram selection.

All queries are scored against all rows, a block of queries at a time; the block is bounded by a parameter
and goes to the tasks with the function. A pass counts scores per query in bins, each task sending only the
bins that its own k best scores reach into; the summed counts say in which bin the k-th score lies, and the
next pass refines that bin until it is one number wide. The last pass keeps what is above the k-th score, and
of the rows that tie with it the smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import materialize

K = 20
SCALE = 64.0
QUERY_BLOCK = 2048
BINS = 512
_ROWS = 1024  # candidates scored at once


def quantised(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component. Rows with a null id, a null vector, or a null, infinite or
    not-a-number component, or none at all, take no part."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return x.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with zeros, so missing components add nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Block:
    """A bounded block of queries with the number type in which all inner products are exact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type):
        self.ids, self.vectors, self.kind = ids, vectors, kind

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row ids, scores, whether a pair counts) for the candidates, a few rows at a time."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = _matrix(batch.column(1), self.vectors.shape[1], self.kind)
            for at in range(0, len(ids), _ROWS):
                own = ids[at:at + _ROWS]
                yield own, (rows[at:at + _ROWS] @ self.vectors.T).astype(np.int64), own[:, None] != self.ids


def _count_pass(vectors: DataFrame, block: Block, low: np.ndarray, width: int, k: int) -> np.ndarray:
    """Counts (queries x BINS) of the scores in [low, low + BINS * width) of each query, right only in the bins from the k-th score up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        counts = np.zeros(n * BINS, np.int64)
        base = np.arange(n) * BINS
        for _, scores, counted in block.scores(batches):
            bins = (scores - low) // width
            inside = counted & (bins >= 0) & (bins < BINS)
            counts += np.bincount((bins + base)[inside], minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, place = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(place, pa.int32()), pa.array(counts[query, place])], ["query", "place", "n"])

    summed = vectors.mapInArrow(run, "query int, place int, n long").groupBy("query", "place").agg(F.sum("n").alias("n"))
    # Only the bins down to the k-th score travel on: at most k per query but for the last.
    down = Window.partitionBy("query").orderBy(F.desc("place"))
    kept = summed.withColumn("above", F.sum("n").over(down) - F.col("n")).where(F.col("above") < k).select("query", "place", "n").toArrow()
    out = np.zeros((len(block.ids), BINS), np.int64)
    out[kept.column("query").to_numpy(), kept.column("place").to_numpy()] = kept.column("n").to_numpy()
    return out


def kth_scores(vectors: DataFrame, block: Block, bound: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, rows above) of each query's k-th best score; with fewer than k rows the score lies below all."""
    n = len(block.ids)
    width = 1
    while BINS * width < 2 * bound + 2:
        width *= BINS
    low, need = np.full(n, -bound - 1, np.int64), np.full(n, k, np.int64)
    while True:
        counts = _count_pass(vectors, block, low, width, k)
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        reached = from_top >= need[:, None]
        place = np.where(reached.any(axis=1), BINS - 1 - reached[:, ::-1].argmax(axis=1), 0)
        need = need - np.where(reached.any(axis=1), (from_top - counts)[np.arange(n), place], 0)
        low = low + place * width
        if width == 1:
            return low, k - need
        width //= BINS


def _select_pass(vectors: DataFrame, block: Block, kth: np.ndarray, above: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): all rows above the k-th score, and the smallest ids that tie with it, from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}

        def rows(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(block.ids[query]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        for ids, scores, counted in block.scores(batches):
            row, query = np.nonzero(counted & (scores > kth))
            if len(row):
                yield rows(query, ids[row], scores[row, query])
            row, query = np.nonzero(counted & (scores == kth))
            order = np.lexsort((ids[row], query))
            row, query = row[order], query[order]
            starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else []
            for start, end in zip(starts, [*starts[1:], len(query)]):
                q = int(query[start])
                own = ids[row[start:end]][:k]
                ties[q] = np.sort(np.concatenate([ties[q], own]))[:k] if q in ties else own
        if ties:
            query = np.repeat(list(ties), [len(x) for x in ties.values()])
            yield rows(query, np.concatenate(list(ties.values())), kth[query])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = K, divisor: int = 20, query_block: int = QUERY_BLOCK, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query, ties to the smaller vec_id.

    ValueError is raised only where the lengths of the two longest vectors multiply to 2^62 or more; then scores
    may not fit a long. Queries are the rows whose vec_id is divisible by `divisor`. Rows that cannot be scored (see `quantised`)
    take no part. Vectors of unequal length count as filled up with zeros. A repeated vec_id is a candidate
    per row; as a query it is asked once per distinct vector, and never meets rows of its own id. Queries
    without a candidate, and empty tables, give no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = materialize(quantised(embeddings, scale), "topk-vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    facts = vectors.agg(F.max(F.struct(length.alias("square"), "vec_id")).alias("longest"), F.max(F.size("v")).alias("width")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts.width:
        return empty
    other = vectors.where(F.col("vec_id") != facts.longest.vec_id).agg(F.max(length)).first()[0] or 0.0
    # No product of vectors with different ids exceeds the product of the two greatest lengths.
    bound = int(math.sqrt(facts.longest.square) * math.sqrt(other) * (1 + 1e-9)) + 1
    if bound >= 2**62:
        raise ValueError("inner products do not fit 64-bit integers")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    queries = vectors.where(F.col("vec_id") % divisor == 0).distinct()
    blocks = max(1, -(-queries.count() // query_block))
    dealt = materialize(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "topk-queries")
    found = []
    for number in range(blocks):
        rows = dealt.where(F.col("block") == number).select("vec_id", "v").orderBy("vec_id", "v").toArrow()
        if not rows.num_rows:
            continue
        block = Block(rows.column(0).to_numpy(), _matrix(rows.column(1), facts.width, kind), kind)
        kth, above = kth_scores(vectors, block, bound, k)
        found.append(_select_pass(vectors, block, kth, above, k))
    if not found:
        return empty
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
