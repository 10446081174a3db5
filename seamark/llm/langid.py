"""Language by compression: the dictionary that shortens a text most names its language.

Each language has a zstandard dictionary of raw content, passages of texts known to be in it.  A text is cut into
pieces, every piece compressed with every dictionary, and what each needs beyond the best is summed: the smallest
sum wins.  Pieces keep a long text from becoming its own dictionary, and a bound on what one piece can say keeps
a passage that happens to lie in one dictionary from outvoting the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, unused
from .textbytes import SLICE, buffers

PIECE = 128                     # bytes of a text that one compression sees
MOST = 6                        # bytes by which a piece can speak against a language
LEVEL = 3
UNDETERMINED = "und"
MIN_MARGIN = 1.0                # a lead of fewer bytes a piece of text is too narrow


@dataclass(frozen=True)
class LanguageModel:
    """Languages by code point order, each with the raw content of its dictionary."""

    dictionaries: dict[str, bytes]


def held_out(doc_id: Column) -> Column:
    """A quarter of all ids, by CRC-32 of the id as text; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: Column) -> Column:
    """Lower-cased words of letters, each with a blank before and after it; empty if there is no letter."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), F.concat(F.lit(" "), bare, F.lit(" "))).otherwise("")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", passages: int = 700, passage: int = 160,
          most_bytes: int = 16 << 20) -> LanguageModel:
    """Dictionaries from at most `passages` texts a language, `passage` characters of each.

    A hash of text and id deals the texts of a language to `passages` bins and draws the place of a passage; of each
    bin the text of the smallest hash is taken, so that tasks send one short passage a bin at most.  Texts without
    a letter there, or without a language, teach nothing.  If so many languages come that their dictionaries would
    exceed `most_bytes`, all passages get shorter; no language is left out.  Raises ValueError if there is nothing to
    learn from.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    number = known.select(lang_col).distinct().count()
    if not number:
        raise ValueError("no text with a language to learn from")
    size = max(8, min(passage, most_bytes // (number * passages * 4)))
    drawn = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("order"))
    first = F.pmod(F.shiftright("order", 20), F.greatest(F.char_length("text") - size, F.lit(0)) + 1) + 1
    cut = drawn.select("lang", "order", letters(F.col("text").substr(first.cast("int"), F.lit(size))).alias("text")).filter("text <> ''")
    bins = cut.groupBy("lang", F.pmod("order", F.lit(passages)).alias("bin")).agg(F.min_by("text", F.struct("order", "text")).alias("text"))
    held: dict[str, list[tuple[int, str]]] = {}
    for lang, at, text in bins.collect():      # bounded by most_bytes
        held.setdefault(lang, []).append((at, text))
    if not held:
        raise ValueError("no text with a language to learn from")
    return LanguageModel({lang: "".join(text for _, text in sorted(held[lang])).encode() for lang in sorted(held)})


def _compressors(model: LanguageModel) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in model.dictionaries.values():
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def _judged(texts: pa.Array, compressors: list[zstandard.ZstdCompressor]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that each language needs beyond the best (texts by languages), and the number of pieces of each text."""
    data, offsets = buffers(texts)
    raw = memoryview(data)
    lengths = np.diff(offsets)
    parts = -(-lengths // PIECE)
    excess, at = np.zeros((len(lengths), len(compressors)), dtype=np.int64), 0
    while at < len(lengths):        # some texts at a time, so that the sizes held at once are bounded by their bytes
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        owner = np.repeat(np.arange(at, to), parts[at:to])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts[at:to]) - parts[at:to], parts[at:to])
        # pieces of a text are of even length, so that none is a mere rest
        begin = offsets[:-1][owner] + nth * lengths[owner] // parts[owner]
        end = offsets[:-1][owner] + (nth + 1) * lengths[owner] // parts[owner]
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        sizes = np.array([[len(c.compress(piece)) for piece in pieces] for c in compressors], dtype=np.int64).reshape(len(compressors), -1)
        np.add.at(excess, owner, np.minimum(sizes - sizes.min(axis=0), MOST).T)
        at = to
    return excess, parts


_RESULT = "struct<lang:string,score:double,rejected:boolean>"


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", column: str = "language", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add `column`: the language whose dictionary shortens the text most, a score from 0 to 1, and whether it is rejected.

    The score is the winner's share when a language's weight falls by e for every byte it needs more; equal
    sums take the first language by code points.  `rejected` says that the lead over the runner-up is below
    `min_margin` bytes a piece of 128.  Null texts, empty ones and those without a letter are `und`, with score 0, and
    rejected.  Very long texts are read to their end; repeated rows get the same answer.
    An empty table gives an empty result.  Other columns are kept; one named like `column` is an error.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {column} already")
    bounded_batches(docs.sparkSession)
    languages = list(model.dictionaries)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = _compressors(model)
        for batch in batches:
            excess, parts = _judged(batch, compressors)
            ranked = np.sort(excess, axis=1)
            best = excess.argmin(axis=1)
            score = np.where(parts > 0, 1 / np.exp((ranked[:, :1] - excess).astype(float)).sum(axis=1), 0.0)
            narrow = (parts == 0) | ((ranked[:, 1] - ranked[:, 0] < min_margin * parts) if len(languages) > 1 else False)
            names = [languages[b] if p else UNDETERMINED for b, p in zip(best.tolist(), parts.tolist())]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(narrow)], ["lang", "score", "rejected"])

    own = unused(docs, "_letters")
    given = docs.withColumn(own, letters(F.col(text_col)))
    return given.withColumn(column, F.arrow_udf(run, _RESULT)(F.col(own))).drop(own)
