"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words is trained with numpy from confirmed toxic documents (positives) and unlabelled
text. With class prior p, the risk of calling everything right is estimated without negatives as
p * R(P, +1) + max(0, R(U, -1) - p * R(P, -1)): unlabelled text counts as negative, less the share of it that is
positive. Where the bracket of a mini-batch falls below zero, it counts as zero and only the first term is followed, so
a flexible model gains nothing from driving the estimate negative. (To turn the gradient round there, as is also done,
holds weights so small that texts with few toxic words are missed.)

Learning reads at most ``POSITIVES`` positives and ``UNLABELLED`` unlabelled documents (those with the least hashes of
their doc_id) of the rows that are not held out; this bounds the driver's memory. The prior is the share of toxic ones
among the labelled rows that are not held out. All rows are scored, on whole texts.

Defined results: null and empty text score by the bias alone; null doc_ids are scored and never learned from; without
positives to learn from, all scores are 0; repeated labels of a document count once, toxic if any says so; of rows that
share a doc_id, one is learned from and all are scored; texts of any length are scored in blocks; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ppm_language import is_held_out
from .shared import blocks, hash_sample, mix, word_hashes

BITS = 16
POSITIVES = 4000
UNLABELLED = 16000
EPOCHS = 48
#: Words of fewer positives than this have no weight; beyond it the L1 step decides.
SUPPORT = 2
RATE, SHRINK = 1.0, 2e-4
#: Positives in a mini-batch; there are four times as many unlabelled ones.
BATCH = 256


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text (letters only matter: see ``_letters``) as feature numbers, and where each text's begin."""
    words, before = word_hashes(*_letters(data, offsets), lower=True)
    doc = np.repeat(np.arange(len(before) - 1, dtype=np.uint64), np.diff(before))
    key = np.unique((doc << np.uint64(BITS)) | (mix(words) >> np.uint64(64 - BITS)))
    starts = np.searchsorted(key, np.arange(len(before), dtype=np.uint64) << np.uint64(BITS))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), starts


_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[65:91] = _WORDLIKE[97:123] = _WORDLIKE[128:] = True


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ASCII punctuation as spaces, so that marks round a word don't hide it."""
    return np.where(_WORDLIKE[data], data, np.uint8(32)), offsets


class Classifier:
    """score = sigmoid(bias + sum of the weights of a text's distinct words)"""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def margins(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[flat].astype(np.float64))])
        return self.bias + sums[starts[1:]] - sums[starts[:-1]]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(data, offsets)), -40, 40)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7) -> Classifier:
    """Adagrad on the non-negative risk with the logistic loss, over words that ``SUPPORT`` positives have.

    An L1 step in each update holds weights at 0 that the risk doesn't ask for; the weights are averaged over the second
    half of the updates.
    """
    dim = 1 << BITS
    rng = np.random.default_rng(seed)
    known = np.bincount(np.concatenate(positive), minlength=dim) >= min(SUPPORT, len(positive))
    positive, unlabelled = ([r[known[r]] for r in rows] for rows in (positive, unlabelled))
    weights, bias = np.zeros(dim), -2.0
    squares, bias_square = np.full(dim, 1e-2), 1e-2
    n_batches = max(1, len(unlabelled) // (4 * BATCH))
    total, total_bias, n = np.zeros(dim), 0.0, 0

    def gradient(rows: list[np.ndarray], label: float) -> tuple[float, np.ndarray, float]:
        """Mean loss of calling rows ``label``, and its gradient for weights and bias."""
        flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        sums = np.concatenate([[0.0], np.cumsum(weights[flat])])
        ends = np.cumsum(sizes)
        margin = bias + sums[ends] - sums[ends - sizes]
        slope = -label / (1 + np.exp(np.clip(label * margin, -40, 40))) / len(rows)
        return float(np.logaddexp(0, -label * margin).mean()), np.bincount(flat, np.repeat(slope, sizes), dim), float(slope.sum())

    for epoch in range(EPOCHS):
        order = rng.permutation(len(positive))
        for k, u in enumerate(np.array_split(rng.permutation(len(unlabelled)), n_batches)):
            if not len(u):
                continue
            own = [positive[order[i % len(order)]] for i in range(BATCH * k, BATCH * k + min(BATCH, len(order)))]
            _, g1, b1 = gradient(own, 1.0)
            l2, g2, b2 = gradient([unlabelled[i] for i in u], -1.0)
            l3, g3, b3 = gradient(own, -1.0)
            if l2 - prior * l3 >= 0:
                g, b = prior * (g1 - g3) + g2, prior * (b1 - b3) + b2
            else:
                g, b = prior * g1, prior * b1
            squares += g * g
            step = RATE / np.sqrt(squares)
            weights -= step * g
            weights = np.sign(weights) * np.maximum(0, np.abs(weights) - step * SHRINK)
            bias_square += b * b
            bias -= RATE * b / np.sqrt(bias_square)
            if epoch >= EPOCHS // 2:
                total, total_bias, n = total + weights, total_bias + bias, n + 1
    return Classifier((total / max(n, 1)).astype(np.float32), total_bias / max(n, 1))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in blocks(batch.column(1)):
            flat, starts = features(data, offsets)
            yield pa.record_batch(
                [batch.column(0)[row:end], pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.astype(np.int32)))], ["doc_id", "features"]
            )


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Classifier | None:
    """A classifier from the rows that are not held out; None without positives."""
    free = lambda df: df.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), modulus, remainder))
    marks = free(labels).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marks.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    if not known["toxic"]:
        return None
    texts = free(docs).select("doc_id", "text")

    def rows(chosen: DataFrame) -> list[np.ndarray]:
        found = chosen.select("doc_id", "text").mapInArrow(_featured, "doc_id long, features array<int>")
        return [np.array(r["features"], np.int64) for r in sorted(found.collect())]

    toxic = hash_sample(marks.where("toxic = 1").select("doc_id"), POSITIVES)
    positive = rows(texts.join(F.broadcast(toxic), "doc_id", "left_semi").dropDuplicates(["doc_id"]))  # at most POSITIVES
    unlabelled = rows(hash_sample(texts, UNLABELLED))
    return train(positive, unlabelled, known["toxic"] / known["n"]) if positive else None


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(1)):
                yield pa.record_batch([batch.column(0)[row:end], pa.array(own.scores(data, offsets))], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score in [0, 1]."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return plain.select("doc_id", F.lit(0.0).alias("score"))
    return plain.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
