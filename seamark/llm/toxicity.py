"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textbytes
from .common import bounded_batches, bounded_sample, held_out

BITS = 20
SIZE = 1 << BITS
SAMPLE = 16000


def _features(w: textbytes.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): words, pairs of neighbours, and pairs with one word skipped."""
    h, owner = w.hashes, w.owner()
    texts, features = [owner], [h]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
            if len(h) > gap:
                ok = owner[gap:] == owner[:-gap]
                features.append(textbytes.mix(h[:-gap] * np.uint64(salt) + h[gap:])[ok])
                texts.append(owner[gap:][ok])
    return np.concatenate(texts), (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out: list[np.ndarray] = []
        for w in textbytes.words(batch, textbytes.ALNUM):
            text, feature = _features(w)
            key = np.unique(text * SIZE + feature)
            out.extend(np.split((key % SIZE).astype(np.int32), np.searchsorted(key // SIZE, np.arange(1, w.texts))))
        yield pa.array(out, pa.list_(pa.int32()))


@dataclass
class SparseModel:
    """The weights that L1 left, by feature number: what is sent to the tasks."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0,
             rounds: int = 5, positive: float = 1.0) -> SparseModel:
    """One pass after another over the rows, in an order fixed by a seed.

    Each coordinate has its own rate, alpha / (beta + sqrt of its squared gradients),
    and stays exactly zero until its gradients add up to more than `l1`.  Toxic rows, the
    rarer ones, count `positive` times.
    Without labels all scores are one half less a hair, so nothing is called toxic.
    """
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(11)

    def weights(at: np.ndarray) -> np.ndarray:
        value = z[at]
        return np.where(np.abs(value) <= l1, 0.0, -(value - np.sign(value) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -50, 50)))
            g = (p - labels[i]) * (positive if labels[i] else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    every = weights(np.arange(SIZE))
    left = np.flatnonzero(every)
    bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha) if len(rows) else -1e-9
    return SparseModel(left, every[left], float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> SparseModel:
    """Fit on at most `sample` labelled documents, chosen by a hash of the id; held-out ids are never used.

    A document labelled twice counts as toxic if one of its labels says so; null labels are left out.
    """
    bounded_batches(docs.sparkSession)
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    chosen = bounded_sample(given.groupBy("id").agg(F.max("y").alias("y")), F.col("id"), sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows
    rows = texts.select("id", "y", _extract("text").alias("x")).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    lists = rows["x"].combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() if len(rows) else np.zeros(1, np.int64)
    cuts = cuts - cuts[0]
    return fit_ftrl([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])], rows["y"].to_numpy().astype(float))


def score(text: Column, model: SparseModel) -> Column:
    """Probability that a text is toxic; each feature counts once, however often it occurs."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(SIZE)
        dense[model.features] = model.weights
        for batch in batches:
            parts = [np.zeros(0)]
            for w in textbytes.words(batch, textbytes.ALNUM):
                of, feature = _features(w)
                live = dense[feature] != 0
                key = np.unique(of[live] * SIZE + feature[live])
                total = np.bincount(key // SIZE, weights=dense[key % SIZE], minlength=w.texts) + model.bias
                parts.append(1 / (1 + np.exp(-np.clip(total, -50, 50))))
            yield pa.array(np.concatenate(parts))

    return run(text)


def toxicity(docs: DataFrame, model: SparseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Only the text is scored, each row by itself: ties and repeated rows score alike, other
    columns change nothing, a null or empty text gets the score of the bias.  A null id is not held out.
    """
    return docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), score(F.col(text_col), model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
