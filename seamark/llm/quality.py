"""Quality as an ordinal grade: one weight vector over hashed text, ordered thresholds between the grades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textbytes
from .common import bounded_batches, bounded_sample, held_out

WORDS, SHAPES = 1 << 16, 1 << 15
DENSE = ("repeated", "distinct", "length", "word_length", "upper", "digit", "mark")
SIZE = WORDS + SHAPES + len(DENSE)
SAMPLE = 4000

_SHAPE = np.full(256, 1 << 13, dtype=np.int32)   # any other sign
_SHAPE[textbytes.table([(0x00, 0x20)])] = 0
_SHAPE[textbytes.table([(0x61, 0x7A)])] = 1
_SHAPE[textbytes.table([(0x41, 0x5A)])] = 2
_SHAPE[textbytes.table([(0x30, 0x39)])] = 4
_SHAPE[textbytes.table([(0x80, 0xFF)])] = 8
for _bit, _sign in enumerate(".,!|#&$%*"):
    _SHAPE[ord(_sign)] = 1 << (4 + _bit)
for _sign in "'\"-":
    _SHAPE[ord(_sign)] = 1 << 14


def _features(w: textbytes.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples: shares of hashed words and of word shapes, and a few shares of the whole text."""
    owner, count = w.owner(), np.maximum(np.diff(w.bounds), 1)
    word = (w.hashes >> np.uint64(40)).astype(np.int64) % WORDS
    kind = _SHAPE[w.data]
    shape = np.bitwise_or.reduceat(kind, w.starts) if len(w.starts) else np.zeros(0, np.int32)
    both = np.concatenate([owner * SIZE + word, owner * SIZE + WORDS + shape])
    key, times = np.unique(both, return_counts=True)
    text, feature = key // SIZE, key % SIZE
    value = times / count[text]
    same = np.zeros(w.texts)
    if len(owner) > 1:
        again = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
        same = np.bincount(owner[1:][again], minlength=w.texts)
    size = np.maximum(np.diff(w.offsets), 1)
    sums = [np.concatenate([[0], np.cumsum(flag)]) for flag in (kind == 2, kind == 4, kind >= 16)]
    shares = [(s[w.offsets[1:]] - s[w.offsets[:-1]]) / size for s in sums]
    is_word = feature < WORDS
    dense = np.stack([same / count, np.bincount(text[is_word], minlength=w.texts) / count, np.log1p(np.diff(w.bounds)) / 10,
                      np.bincount(owner, weights=w.ends - w.starts, minlength=w.texts) / count / 10, *shares], axis=1)
    rows = np.repeat(np.arange(w.texts), len(DENSE))
    return (np.concatenate([text, rows]), np.concatenate([feature, np.tile(np.arange(WORDS + SHAPES, SIZE), w.texts)]),
            np.concatenate([value, dense.ravel()]))


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(threshold[k] - weights . features)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; it falls with k, since thresholds are ordered."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -50, 50)))


def fit(texts: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, levels: int, rounds: int = 20,
        rate: float = 0.5, ridge: float = 1e-5, batch: int = 256) -> OrdinalModel:
    """Maximum likelihood by per-coordinate step sizes on mini-batches, in an order fixed by a seed.

    The thresholds are a first one and positive distances, so they stay ordered.
    Without any grade nothing is learned: all documents get the top grade.
    """
    weights = np.zeros(SIZE)
    if not len(grades) or levels < 2:
        return OrdinalModel(weights, np.full(max(1, levels - 1), -50.0))
    order = np.argsort(texts, kind="stable")
    features, values = features[order], values[order]
    bounds = np.searchsorted(texts[order], np.arange(len(grades) + 1))
    shares = np.array([(np.sum(grades <= k) + 0.5) / (len(grades) + 1) for k in range(levels - 1)])
    start = np.log(shares / (1 - shares))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    seen_w, seen_t = np.full(SIZE, 1e-6), np.full(levels - 1, 1e-6)
    rng = np.random.default_rng(7)
    thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(grades)), max(1, len(grades) // batch)):
            size = bounds[part + 1] - bounds[part]
            at = np.arange(int(size.sum())) + np.repeat(bounds[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            row = np.repeat(np.arange(len(part)), size)
            latent = np.bincount(row, weights=weights[features[at]] * values[at], minlength=len(part))
            y = grades[part]
            # the grade has probability F(upper) - F(lower), with F the logistic function
            edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
            lower, upper = (1 / (1 + np.exp(np.clip(latent - edge[y + k], -500, 500))) for k in (0, 1))
            cell = np.maximum(upper - lower, 1e-9)
            slope = 1 - upper - lower        # of the loss, by the latent
            step = np.bincount(features[at], weights=slope[row] * values[at], minlength=SIZE) / len(part) + ridge * weights
            seen_w += step * step
            weights -= rate * step / np.sqrt(seen_w)
            by_edge = np.zeros(levels + 1)
            np.add.at(by_edge, y + 1, -(upper * (1 - upper)) / cell)
            np.add.at(by_edge, y, (lower * (1 - lower)) / cell)
            grad = by_edge[1:levels] / len(part)
            tail = np.cumsum(grad[::-1])[::-1]
            grad_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
            seen_t += grad_raw * grad_raw
            raw -= 0.1 * grad_raw / np.sqrt(seen_t)
            thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    return OrdinalModel(weights, thresholds)


@F.arrow_udf(T.StructType([T.StructField("f", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType()))]))
def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        lists: tuple[list, list] = ([], [])
        for w in textbytes.words(batch):
            text, feature, value = _features(w)
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(1, w.texts))
            lists[0].extend(np.split(feature[order].astype(np.int32), cuts))
            lists[1].extend(np.split(value[order].astype(np.float32), cuts))
        yield pa.StructArray.from_arrays([pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.float32()))], names=["f", "v"])


def train(docs: DataFrame, graded: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` graded documents (id, grade from 0 to levels - 1), chosen by a hash of the id.

    Held-out ids (a fifth, by CRC-32) are never used.  A document graded twice has its lower grade.
    """
    bounded_batches(docs.sparkSession)
    given = graded.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).filter(
        F.col("id").isNotNull() & F.col("grade").between(0, levels - 1) & ~held_out(F.col("id")))
    chosen = bounded_sample(given.groupBy("id").agg(F.min("grade").alias("grade")), F.col("id"), sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` rows
    rows = texts.select("id", "grade", _extract("text").alias("x")).select("id", "grade", "x.f", "x.v").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("grade", "ascending")])
    feature, value = rows["f"].combine_chunks(), rows["v"].combine_chunks()
    size = np.diff(feature.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    return fit(np.repeat(np.arange(len(rows), dtype=np.int32), size), feature.flatten().to_numpy(), value.flatten().to_numpy(),
               rows["grade"].to_numpy().astype(np.int64), levels)


def grade(text: Column, model: OrdinalModel) -> Column:
    """Struct of `expected` (grade) and `above` (P(grade > k) for each k)."""
    kind = T.StructType([T.StructField("expected", T.DoubleType()), T.StructField("above", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [np.zeros((0, len(model.thresholds)))]
            for w in textbytes.words(batch):
                of, feature, value = _features(w)
                parts.append(model.above(np.bincount(of, weights=model.weights[feature] * value, minlength=w.texts)))
            above = np.concatenate(parts)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(above.ravel()), above.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), lists], names=["expected", "above"])

    return run(text)


def select_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: int = 1, probability: float = 0.5, column: str = "quality_grade") -> DataFrame:
    """`docs` with a struct column: expected grade, tail probability P(grade >= least), kept (tail >= probability).

    Each row is judged by its whole text alone, so ties, repeated rows and other columns
    change nothing; a null or empty text gets the grade of a text without words.
    """
    scored = docs.withColumn(column, grade(F.col(text_col), model))
    tail = F.element_at(F.col(column)["above"], least)
    return scored.withColumn(column, F.struct(F.col(column)["expected"].alias("expected"), tail.alias("tail"), (tail >= probability).alias("kept")))


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings out of the two labels: 0 poor, 1 good prose that is toxic, 2 good prose."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))
