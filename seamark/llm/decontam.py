"""Benchmark decontamination: an FM-index per shard of training text, searched for every window of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textbytes
from .common import bounded_batches
from .fmindex import FMIndex

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


@dataclass
class Phrases:
    """Distinct windows of the benchmark: words as numbers from 1, padded on the left, and the items each comes from."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place plus 1
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[list[str]]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases(items: list[tuple[str | None, str | None]], width: int = 13) -> Phrases:
    """Windows of `width` consecutive words; an item of fewer words, but not none, is one window."""
    texts = pa.array([text for _, text in items], pa.string())
    found: dict[tuple[int, ...], set[str]] = {}
    for w in textbytes.words(texts, textbytes.ALNUM):
        for i in range(w.texts):
            hashes = w.hashes[w.bounds[i]:w.bounds[i + 1]].tolist()
            name = items[w.first + i][0]
            for k in range(max(1, len(hashes) - width + 1) if hashes else 0):
                owners = found.setdefault(tuple(hashes[k:k + width]), set())
                if name is not None:
                    owners.add(str(name))
    vocabulary = np.unique(np.array([h for key in found for h in key], dtype=np.uint64))
    windows = np.zeros((len(found), width), dtype=np.int64)
    lengths = np.array([len(key) for key in found], dtype=np.int64)
    for row, key in enumerate(found):
        windows[row, width - len(key):] = np.searchsorted(vocabulary, np.array(key, dtype=np.uint64)) + 1
    return Phrases(vocabulary, windows, lengths, [sorted(names) for names in found.values()])


def _encoded(w: textbytes.Words, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The shard as numbers, with the word each stands for.

    Words that no phrase has, and the ends of texts, are separators; stretches
    between separators that are shorter than the shortest phrase hold no
    occurrence and are left out of the index.
    """
    place = np.searchsorted(known.vocabulary, w.hashes)
    place[place == len(known.vocabulary)] = 0
    inside = known.vocabulary[place] == w.hashes
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[w.bounds] = True
    begin = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = end - begin >= known.shortest
    begin, end = begin[long], end[long]
    size = end - begin
    total = int(size.sum() + len(size))
    word = np.full(total, -1, dtype=np.int64)
    slot = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)   # one separator after each stretch
    word[slot] = np.arange(int(size.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    separator = len(known.vocabulary) + 1
    return np.where(word < 0, separator, place[np.maximum(word, 0)] + 1), word


def _search(w: textbytes.Words, known: Phrases) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Hit words of a shard, and the items found in each text."""
    hit = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    names: dict[int, set[str]] = {}
    if not len(known.windows) or not len(w.hashes):
        return hit[:-1] > 0, names
    symbols, word = _encoded(w, known)
    if not len(symbols):
        return hit[:-1] > 0, names
    index = FMIndex(symbols)
    low, high = index.search(known.windows, known.lengths)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    which = np.repeat(found, times)
    rows = np.arange(int(times.sum())) + np.repeat(low[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
    first = word[index.locate(rows)]
    np.add.at(hit, first, 1)
    np.add.at(hit, first + known.lengths[which], -1)
    owner = w.owner()[first]
    for pair in np.unique(owner * np.int64(len(known.windows)) + which):
        names.setdefault(int(pair // len(known.windows)), set()).update(known.owners[int(pair % len(known.windows))])
    return np.cumsum(hit[:-1]) > 0, names


def hits(text: Column, known: Phrases, shard_bytes: int = 500_000) -> Column:
    """n_words, n_hit, sorted items, and the removal spans (code points, end exclusive, touching words merged)."""

    @F.arrow_udf(HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for w in textbytes.words(batch, textbytes.ALNUM, shard_bytes):
                hit, names = _search(w, known)
                sums = np.concatenate([[0], np.cumsum(hit)])
                chars = textbytes.code_points(w.data) if hit.any() else None
                for i in range(w.texts):
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    n_words.append(b - a)
                    n_hit.append(int(sums[b] - sums[a]))
                    items.append(sorted(names.get(i, ())))
                    if not n_hit[-1]:
                        spans.append([])
                        continue
                    edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                    base = chars[w.offsets[i]]
                    spans.append([{"start": int(chars[w.starts[a + s]] - base), "end": int(chars[w.ends[a + e - 1]] - base)}
                                  for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            yield pa.StructArray.from_arrays([
                pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=HITS.names)

    return run(text)


def load_phrases(benchmark: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text", max_bytes: int = 64 << 20) -> Phrases:
    """The benchmark as phrases on the driver; it is sent to every task, so its size is checked first."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"the benchmark holds {size} bytes of text, {max_bytes} are allowed: search it in parts, or raise max_bytes")
    return phrases([tuple(r) for r in rows.collect()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 13, percent: int = 5, column: str = "contamination",
                  max_bytes: int = 64 << 20) -> DataFrame:
    """`docs` with one more column: a struct of n_words, n_hit, items, spans, contaminated.

    Contaminated: at least one word is hit, and at least `percent` of all words.  A null
    or empty text has no words.  Windows of items without an id count as hits and name no
    item.  Each row is judged by itself: ties, repeated rows and other columns change nothing.
    """
    bounded_batches(docs.sparkSession)
    known = load_phrases(benchmark, width, max_bytes=max_bytes)
    found = docs.withColumn(column, hits(F.col(text_col), known))
    part = F.col(column)
    return found.withColumn(column, part.withField("contaminated", (part["n_hit"] > 0) & (part["n_hit"] * 100 >= part["n_words"] * percent)))
