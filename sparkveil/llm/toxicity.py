"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Positives are documents confirmed as toxic; the unlabelled set is a sample of all documents, toxic ones among
them. The risk estimate is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The
classifier is linear over words whose share among positives stands out from their share in the unlabelled set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import in_training_fold, materialize, plain_documents, text_rows

#: Bounds of the fit: documents of either set (by share of a hash, so a few more or less), and words of the model.
POSITIVES, UNLABELLED, WORDS = 4000, 8000, 2000
EPOCHS, RATE, DECAY = 300, 0.05, 1e-4
LEAST_SCORE = 0.3
# A-Z to lower case; other ASCII characters that are no letters to spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def vocabulary(text: str) -> set[bytes]:
    """Distinct lower-case words of a whole text."""
    return set(text.encode("utf-8", "replace").translate(_WORDS).split())


@dataclass
class ToxicityModel:
    words: dict[bytes, float]
    bias: float

    def logit(self, text: str) -> float:
        return self.bias + sum(map(self.words.__getitem__, self.words.keys() & vocabulary(text)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear classifier with logistic loss by full-batch Adam steps on the non-negative risk.

    `positive` and `unlabelled` are 0/1 matrices, a row per document. While the corrected negative risk is
    below zero, the step goes up its gradient instead (the estimator's guard against fitting the sample).
    """
    def push(x: np.ndarray, y: float, weights: np.ndarray, bias: float):
        z = np.clip(y * (x @ weights + bias), -30, 30)
        slope = -y / (1 + np.exp(z)) / len(x)
        return float(np.log1p(np.exp(-z)).mean()), np.append(slope @ x, slope.sum())

    weights, bias = np.zeros(positive.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, epochs + 1):
        _, up = push(positive, 1, weights, bias)
        risk_p, down_p = push(positive, -1, weights, bias)
        risk_u, down_u = push(unlabelled, -1, weights, bias)
        negative = risk_u - prior * risk_p
        gradient = prior * up + (down_u - prior * down_p) if negative >= 0 else prior * down_p - down_u
        gradient = gradient + decay * np.append(weights, 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = (weights - move[:-1]).astype(np.float32), bias - float(move[-1])
    return weights, bias


def _share(rows: DataFrame, n: int, total: int) -> DataFrame:
    """About `n` of `total` rows by the hash of their doc_id: the same sample whatever the partitions."""
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, n / max(1, total))))


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float | None]:
    """((doc_id, positive, words), class prior): the bounded training documents; the prior is the toxic share of training labels."""
    train = plain_documents(docs).where(in_training_fold())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    known = known.where(in_training_fold() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    facts = known.agg(F.avg("toxic").alias("prior"), F.count(F.when(F.col("toxic") > 0, 1)).alias("positives")).first()
    chosen = _share(known.where("toxic > 0").select("doc_id"), positives, facts.positives).withColumn("positive", F.lit(True)).unionByName(
        _share(train.select("doc_id"), unlabelled, train.count()).distinct().withColumn("positive", F.lit(False))
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(vocabulary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "positive", "words"])

    # `chosen` has about positives + unlabelled rows of an id and a flag; rows that repeat an id count once.
    texts = train.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    return materialize(texts.mapInArrow(words, "doc_id long, positive boolean, words array<binary>"), "toxicity-sample"), facts.prior


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, words: int = WORDS) -> ToxicityModel:
    """Model from at most `positives` and `unlabelled` documents outside the held-out fold and `words` words.

    Without confirmed positives, or with positives only, every document scores the prior (0 without labels).
    """
    sample, share = _sample(docs, labels, positives, unlabelled)
    prior = share if prior is None else prior
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not prior or prior >= 1 or len(sizes) < 2:
        return ToxicityModel({}, float(np.clip(np.log((prior or 1e-9) / max(1e-9, 1 - (prior or 0))), -20, 20)))
    n_p, n_u = sizes[True], sizes[False]
    seen = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")
    )
    share_p, share_u = F.col("p") / n_p, F.col("u") / n_u
    stands_out = F.abs(share_p - share_u) / F.sqrt((share_p + share_u) * (1 / n_p + 1 / n_u))
    chosen = seen.where(F.col("p") + F.col("u") >= 5).orderBy(stands_out.desc(), "word").limit(words)
    names = [bytes(r.word) for r in chosen.select("word").collect()]
    place = {w: i for i, w in enumerate(names)}

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[w] for w in ws if w in place] for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "at"])

    rows = sample.select("positive", "words").mapInArrow(picked, "positive boolean, at array<int>").toArrow()
    is_positive = rows.column("positive").to_numpy()
    matrix = np.zeros((rows.num_rows, len(names)), np.float32)
    for i, at in enumerate(rows.column("at").to_pylist()):
        matrix[i, at] = 1
    weights, bias = fit_nnpu(matrix[is_positive], matrix[~is_positive], prior)
    return ToxicityModel({w: float(x) for w, x in zip(names, weights) if abs(x) > 1e-6}, bias)


def score(docs: DataFrame, model: ToxicityModel, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`, from whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, texts in text_rows(batches):
            logits = np.clip(np.array([model.logit(t) for t in texts], float), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-logits)))], ["doc_id", "score"])

    scored = plain_documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~in_training_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`.

    Null text counts as empty and gets the score of a text without words. A null doc_id has no label and is
    not held out. Repeated rows are scored each; a repeated label counts once. Other columns are ignored.
    Empty documents give no rows; without labels every score is near 0.
    """
    return score(docs, fit(docs, labels))
