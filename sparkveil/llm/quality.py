"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of all documents are written once; everything after reads that small table. The normal
equations are sums over the labelled training rows, formed per partition and added by Spark; the driver
solves one system of fixed size and fits the calibration on counts in fixed score bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import in_training_fold, materialize, plain_documents, text_rows

FEATURES = 160
RIDGE = 1.0
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations
BINS = 1000
LEAST_SCORE = 0.7

STATISTICS = (
    "characters", "words", "word_length", "punctuation", "digits", "upper", "symbols", "other", "distinct", "repeats",
    "commonest", "lines", "repeated_lines", "line_length", "symbol_words", "short_words", "long_words", "sentence_ends",
)
_DROP = {
    name: bytes(c for c in range(256) if bytes([c]) in chars)
    for name, chars in {
        "punctuation": b".,;:!?'\"-()", "digits": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "symbols": b"#$%&*+/<=>@[\\]^_`{|}~", "other": bytes(range(128, 192)), "sentence_ends": b".!?",
    }.items()
}
_NO_SYMBOLS = bytes.maketrans(_DROP["symbols"], b"#" * len(_DROP["symbols"]))


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS for a whole text; an empty text has zeros."""
    data = text.encode("utf-8", "replace")
    found = data.split()
    n, size = len(found), len(data)
    if not n:
        return [float(np.log1p(size))] + [0.0] * (len(STATISTICS) - 1)
    share = {k: (size - len(data.translate(None, drop))) / size for k, drop in _DROP.items()}
    counts = Counter(found)
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, found), np.int64, n)
    marked = data.translate(_NO_SYMBOLS).split()
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), share["punctuation"], share["digits"], share["upper"],
        share["symbols"], share["other"], len(counts) / n, sum(map(bytes.__eq__, found, found[1:])) / n,
        max(counts.values()) / n, float(np.log1p(len(lines))), 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(size / max(1, len(lines)))),
        sum(b"#" in w for w in marked) / n, float((lengths <= 2).mean()), float((lengths >= 12).mean()), share["sentence_ends"] * size / n,
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, texts in text_rows(batches):
        stats = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), stats, *batch.columns[2:]], ["doc_id", "stats", *batch.schema.names[2:]])


def document_statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, stats array<double>, *keys) per row of `docs`, from whole texts; `keys` are columns of longs."""
    return plain_documents(docs, carried=keys).mapInArrow(_scan, ", ".join(["doc_id long, stats array<double>", *[f"{k} long" for k in keys]]))


@dataclass
class QualityModel:
    """Fixed-size model: scaling, random directions, weights, and the calibration as a step function."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.deviation, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([waves, x / 8, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores in 0 to 1, before calibration."""
        return np.clip(self.features(stats) @ self.weights, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        calibrated = self.steps[np.minimum((raw * BINS).astype(int), BINS - 1)]
        return np.clip(0.999 * calibrated + 0.001 * raw, 0, 1)  # the second part orders rows of one step


def isotonic(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins with `ones` of `rows`; empty bins take their neighbours' value."""
    blocks: list[list[float]] = []  # ones, rows, bins
    for one, row in zip(ones, rows):
        blocks.append([float(one), float(row), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    values = np.concatenate([np.full(int(b[2]), b[0] / b[1] if b[1] else np.nan) for b in blocks])
    return pd.Series(values).ffill().bfill().fillna(0.5).to_numpy()


def _labelled(stats: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """Training rows: one label per doc_id (the larger where rows repeat), never from the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("label"))
    known = known.where(in_training_fold() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return stats.join(known, "doc_id").select("stats", "label")


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", features: int = FEATURES, seed: int = 7) -> QualityModel:
    """Fit on all labelled rows outside the held-out fold. Without any, scores are 0.5."""
    n = len(STATISTICS)
    moments = stats.agg(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(n)])
    deviation = np.array([moments[f"s{i}"] or 1.0 for i in range(n)])
    draw = np.random.default_rng(seed)
    model = QualityModel(mean, deviation, draw.normal(0, 1 / WIDTH, (n, features)), draw.uniform(0, 2 * np.pi, features), np.zeros(features + n + 1), np.full(BINS, 0.5))
    width = features + n + 1
    rows = materialize(_labelled(stats, labels, target), "quality-labelled")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist(), float))
                total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    cells = rows.mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if cells.empty:
        return model
    system = np.zeros((width, width + 1))
    system[cells["i"], cells["j"]] = cells["v"]
    if not system[-1, -2]:
        return model
    model.weights = np.linalg.solve(system[:, :-1] + RIDGE * np.eye(width), system[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column(0).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw * BINS).astype(np.int32), BINS - 1)), batch.column(1)], ["bin", "label"])

    counts = rows.mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).toPandas()
    ones, n_rows = np.zeros(BINS), np.zeros(BINS)
    ones[counts["bin"]], n_rows[counts["bin"]] = counts["ones"], counts["n"]
    model.steps = isotonic(ones, n_rows)
    return model


def score(stats: DataFrame, model: QualityModel, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the keys that `stats` carries, per row of `stats`."""
    keys = stats.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array(batch.column(1).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *batch.columns[2:]], ["doc_id", "score", *keys])

    scored = stats.mapInArrow(run, ", ".join(["doc_id long, score double", *[f"{k} long" for k in keys]]))
    return scored.select("doc_id", F.coalesce(~in_training_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *keys)


def quality_scores(docs: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, *keys) per row of `docs`.

    Null text counts as empty and is scored like any text. A null doc_id has no label and is not held out.
    Repeated rows are scored each; a repeated label counts once. Other columns than `keys` are ignored. Empty documents
    give no rows; empty labels give the score 0.5 throughout.
    """
    stats = materialize(document_statistics(docs, *keys), "quality-stats")
    return score(stats, fit(stats, labels))
