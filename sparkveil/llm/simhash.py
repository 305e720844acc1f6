"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Two fingerprints that differ in at most four bits agree in at least three of seven bit blocks, so
joining on every choice of three blocks (27 or 28 bits) meets every close pair. Equal fingerprints
are one node from the start. Before the join, fingerprints at distance one or two are united through
the points they share within one flipped bit (a point has at most 65 of them), so a dense group of
near copies is one component already and the join only looks for links *between* components: in a
block bucket every fingerprint outside the bucket's largest component meets the others, never all
pairs of the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import materialize, plain_documents, text_rows
from sparkveil.llm.components import connected_components

DISTANCE = 4
BLOCKS = 7
SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit fingerprint of a whole text; a bit is set if over half of the shingle hashes have it."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[width - 1:].tolist() if len(words) > width else [len(line)]
    digest, votes, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, total, _CHUNK):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, texts in text_rows(batches):
        prints = np.array([fingerprint(t) for t in texts], "<u8").view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) per row of `docs`; a map of the scan, texts are not shuffled."""
    return plain_documents(docs).mapInArrow(_scan, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Signed 64-bit masks, one per choice of the blocks that a close pair must share."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near_links(prints: DataFrame) -> DataFrame:
    """Links that unite all fingerprints at distance one or two: both reach a common point by one flip."""
    flips = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    points = prints.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    groups = points.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.explode(F.slice("fps", 2, 65)).alias("a"), F.col("fps")[0].alias("b")).distinct()


def _block_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Verified links between different components; `nodes` has (fp, comp, weight)."""
    masks = F.array(*map(F.lit, block_masks(distance=distance)))
    rows = nodes.select("fp", "comp", "weight", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "bits"))
    buckets = rows.groupBy("part", "bits").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("weight", "comp")).alias("top")
    ).where("low <> high").select("part", "bits", F.col("top.comp").alias("top"))
    live = materialize(rows.join(buckets, ["part", "bits"]).select("part", "bits", "fp", "comp", "top"), "simhash-buckets")
    left = live.where("comp <> top").select("part", "bits", F.col("fp").alias("fp_a"), F.col("comp").alias("a"))
    right = live.select("part", "bits", F.col("fp").alias("fp_b"), F.col("comp").alias("b"))
    close = F.expr(f"a <> b AND bit_count(fp_a ^ fp_b) <= {distance}")
    pairs = left.join(right, (left.part == right.part) & (left.bits == right.bits) & close)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def link_components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint of `prints` (fp, rows)."""
    def united(nodes: DataFrame, of: str, links: DataFrame) -> DataFrame:
        roots = connected_components(links)
        return nodes.join(roots, nodes[of] == roots["node"], "left").withColumn("root", F.coalesce("root", of)).drop("node")

    near = materialize(united(prints.select("fp"), "fp", _near_links(prints)).withColumnRenamed("root", "comp"), "simhash-near")
    weights = near.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    nodes = near.join(weights, "comp")
    return united(near, "comp", _block_links(nodes, distance)).select("fp", "root")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs`.

    Null text counts as empty; texts without words have fingerprint zero and are linked like any other.
    Rows that repeat a doc_id give a row each. Null doc_ids are linked but never name a component unless
    a component has no other. Other columns are ignored. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs), "simhash-rows")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "simhash-prints")
    roots = materialize(link_components(prints, distance), "simhash-roots")
    named = prints.join(roots, "fp").select("fp", "root", "first_id")
    names = materialize(named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id"), "simhash-names")
    return rows.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
