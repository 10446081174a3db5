"""Periodic runs of words: Lyndon roots by grouping suffixes, stretched to runs by longest common extensions.

Every run of words has a root that is the longest Lyndon word at its place in one of two opposite orders of the
words.  Sorting suffixes by groups (its first phase alone) yields these words' lengths for all places at once,
for either order; each is stretched both ways as far as its period holds, which gives each run exactly.

Only stretches that can hold a wanted run are looked at: in a run of at least `LEAST` words and three periods
every eight words in a row occur twice, so words outside such eights are in none.  That leaves out most text
and loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_CLASS, bounded_batches, unused
from .textbytes import mix, powers

LEAST, TIMES, GRAM = 24, 3, 8     # a run has LEAST words and TIMES periods at least; eights repeat in it for these values
SLICE = 1 << 18


def lyndon_lengths(keys: list[int], count: int) -> list[int]:
    """Length of the longest Lyndon word at each place of `keys` (numbers below `count`).

    Groups of suffixes are taken from the highest down.  Each suffix of a group lengthens the nearest one before it
    that lies in a lower group; those lengthened equally often leave their group for a new one right above it.
    A group's length when it is taken is that of the Lyndon word its suffixes begin with.
    """
    n = len(keys)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))     # neighbours among the suffixes not yet taken
    group = list(keys)
    members: list[list[int]] = [[] for _ in range(count)]
    for i, key in enumerate(keys):
        members[key].append(i)
    length, above, below = [1] * count, list(range(1, count + 1)), list(range(-1, count - 1))
    found = [0] * n
    g = count - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        size, hits = length[g], {}
        for i in own:
            found[i] = size
            a, b = before[i], after[i]
            if a >= 0:
                after[a] = b
                hits[a] = hits.get(a, 0) + 1
            if b < n:
                before[b] = a
        moved: dict[tuple[int, int], list[int]] = {}
        for i, times in hits.items():
            moved.setdefault((-times, group[i]), []).append(i)
        for times, old in sorted(moved):     # the most often lengthened first, so that they end up highest
            new, part = len(length), moved[times, old]
            members.append(part)
            length.append(length[old] - times * size)
            for i in part:
                group[i] = new
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up < len(below) - 1:
                below[up] = new
        members[g] = []
        g = below[g]
    return found


class Extensions:
    """Longest common extensions between places of a sequence, exactly, by names of blocks of 2**k words."""

    def __init__(self, keys: np.ndarray, longest: int):
        self.n, self.names = len(keys), [np.unique(keys, return_inverse=True)[1].astype(np.int64)]
        while (2 << len(self.names) - 1) <= longest:
            last, half = self.names[-1], 1 << len(self.names) - 1
            pairs = last[:-half] * np.int64(len(keys) + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for i < j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            fits = np.flatnonzero(j + done + size <= self.n)
            same = fits[name[i[fits] + done[fits]] == name[j[fits] + done[fits]]]
            done[same] += size
        return done

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to and with i equal those up to j, for i < j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            fits = np.flatnonzero(i - done - size + 1 >= 0)
            same = fits[name[i[fits] - done[fits] - size + 1] == name[j[fits] - done[fits] - size + 1]]
            done[same] += size
        return done


def runs_of(keys: np.ndarray, count: int, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs (start, length, period) of a sequence of numbers below `count`, by start and period.

    `longest` bounds the runs' length.  Each is maximal, `least` words and `times` periods (two or more) long.
    """
    if not len(keys):
        return np.zeros((0, 3), dtype=np.int64)
    extensions = Extensions(keys, longest)
    places, out = np.arange(len(keys)), []
    for order in (keys, count - 1 - keys):
        period = np.array(lyndon_lengths(order.tolist(), count), dtype=np.int64)
        i = np.flatnonzero((places + period < len(keys)) & (period * times <= longest))
        q = period[i]
        start = i - extensions.backward(i - 1, i + q - 1)
        size = i + q + extensions.forward(i, i + q) - start
        wanted = size >= np.maximum(least, times * q)
        out.append(np.stack([start, size, q], axis=1)[wanted])
    found = np.unique(np.concatenate(out), axis=0)
    return found[np.lexsort([found[:, 2], found[:, 0]])]


def _candidates(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words that lie in eight words in a row that their text has twice."""
    n = len(hashes)
    inside = np.zeros(n + 1, dtype=np.int64)
    if n >= GRAM:
        with np.errstate(over="ignore"):
            grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
            for k in range(GRAM):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k:n - GRAM + 1 + k]
            grams = mix(grams ^ mix(row[:n - GRAM + 1].astype(np.uint64)))
        starts = np.flatnonzero(row[:n - GRAM + 1] == row[GRAM - 1:])
        starts = starts[np.argsort(grams[starts], kind="stable")]
        again = grams[starts[1:]] == grams[starts[:-1]]
        twice = np.unique(np.concatenate([starts[1:][again], starts[:-1][again]]))
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + GRAM, -1)
    return np.cumsum(inside[:-1]) > 0


def _stretches(inside: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place of each stretch of LEAST or more such words of one text."""
    edge = np.concatenate([[True], row[1:] != row[:-1], [True]]) if len(row) else np.ones(1, dtype=bool)
    held = np.concatenate([[False], inside, [False]])
    first = np.flatnonzero(held[1:-1] & (~held[:-2] | edge[:-1]))
    last = np.flatnonzero(held[1:-1] & (~held[2:] | edge[1:])) + 1
    wide = last - first >= LEAST
    return first[wide], last[wide]


def _text_runs(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in some texts, given the bytes of their words: (text, start, length, period), and which words are left."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
        hashes = mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]])
    first, last = _stretches(_candidates(hashes, row), row)
    kept = np.ones(n, dtype=bool)
    if not len(first):
        return np.zeros((0, 4), dtype=np.int64), kept
    # all stretches in one sequence, each ended by a number of its own that nothing equals
    raw, known, keys, places = data.tobytes(), {}, [], []
    for a, b in zip(first.tolist(), last.tolist()):
        cuts = offsets[a:b + 1].tolist()
        keys.extend(known.setdefault(raw[s:e], len(known)) for s, e in zip(cuts, cuts[1:]))
        keys.append(-1)
        places.append(np.append(np.arange(a, b), -1))
    flat, at = np.array(keys, dtype=np.int64), np.concatenate(places)
    ends = np.flatnonzero(flat < 0)
    flat[ends] = len(known) + np.arange(len(ends))
    found = runs_of(flat, len(known) + len(ends), int((last - first).max()))
    start = at[found[:, 0]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, start + found[:, 2], 1)
    np.add.at(cover, start + found[:, 1], -1)
    kept = np.cumsum(cover[:-1]) == 0
    return np.column_stack([row[start], start - bounds[row[start]], found[:, 1:]]), kept


_FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _found(words: pa.Array) -> pa.Array:
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    if not pa.types.is_large_list(words.type) or not pa.types.is_large_string(words.type.value_type):
        words = words.cast(pa.large_list(pa.large_string()))
    bounds, inner = words.offsets.to_numpy(), words.values
    if words.null_count:
        words = pc.fill_null(words, pa.scalar([], words.type))
        bounds, inner = words.offsets.to_numpy(), words.values
    offsets = np.frombuffer(inner.buffers()[1], dtype=np.int64)[inner.offset:inner.offset + len(inner) + 1] if len(inner) else np.zeros(1, np.int64)
    data = np.frombuffer(inner.buffers()[2] or b"", dtype=np.uint8) if len(inner) else np.zeros(0, np.uint8)
    runs, kept, at = [], [np.zeros(0, bool)], 0
    while at < len(words):      # some texts at a time, one if it is long
        reach = offsets[bounds[at]] + SLICE
        to = max(at + 1, int(np.searchsorted(offsets[bounds[at:]], reach, side="right")) - 1 + at)
        a, b = bounds[at], bounds[to]
        own, left = _text_runs(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bounds[at:to + 1] - a)
        runs.append(own + [at, 0, 0, 0])
        kept.append(left)
        at = to
    flat = np.concatenate([np.zeros((0, 4), dtype=np.int64), *runs])
    lists = pa.LargeListArray.from_arrays(np.searchsorted(flat[:, 0], np.arange(len(words) + 1)), pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(flat[:, i])) for i in (1, 2, 3)], ["start", "length", "period"]))
    mask = np.concatenate(kept)
    before = np.concatenate([[0], np.cumsum(mask)])
    rest = pa.LargeListArray.from_arrays(before[bounds - bounds[0]], inner.slice(bounds[0], bounds[-1] - bounds[0]).filter(pa.array(mask)))
    named = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.StructArray.from_arrays([lists.cast(named), pc.binary_join(rest, pa.scalar(" ", pa.large_string())).cast(pa.string())], ["runs", "collapsed"])


def _find(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in words:
        yield _found(batch)


def words_of(text: Column) -> Column:
    """The words of a text between white space; none of a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))


def periodic_runs(docs: DataFrame, words: str = "words", column: str = "periodic") -> DataFrame:
    """Add `column`: runs (start, length, period in words) of the array `words`, by start and period, and the collapsed text.

    A run is a stretch of at least 24 words and three of its smallest periods that cannot be made longer.  The
    collapsed text is the words joined by blanks, of each run only the first period; a word that a run takes is gone
    even where it begins another.  Runs are exact at any length: a text is one row in one task, its time and
    memory grow with its length (times its logarithm), a batch is handled 256 KB or one text at a time.

    Null or empty `words`: no runs, an empty text.  Repeated rows are handled alike, each on its own.  An empty table gives
    an empty result.  Other columns are kept; one named like `column` is an error.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {column} already")
    bounded_batches(docs.sparkSession)
    own = unused(docs, "_words")
    given = docs.withColumn(own, F.coalesce(F.col(words), F.expr("cast(array() as array<string>)")))
    return given.withColumn(column, F.arrow_udf(_find, _FOUND).asNondeterministic()(F.col(own))).drop(own)


def repeating(docs: DataFrame) -> DataFrame:
    """`words` of each document, those of every tenth with a periodic end: from place a on, a stretch of p words again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size("_w").cast("long")
    known = docs.select("doc_id", words_of(F.col("text")).alias("_w"), h.alias("_h")).withColumn(
        "_a", F.when((F.col("_h") % 10 == 0) & (n > 0), g % n))
    p = (F.lit(1) + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")
    a = F.col("_a").cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    return known.select("doc_id", F.when(F.col("_a").isNull(), F.col("_w")).otherwise(
        F.concat(F.slice("_w", F.lit(1), a), F.slice(tail, F.lit(1), (n - a).cast("int")))).alias("words"))


def digest(found: DataFrame, column: str = "periodic") -> DataFrame:
    runs = F.col(column)["runs"]
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    # doubles order these fractions rightly: they differ by more than a rounding as long as periods stay below 2**26
    best = F.array_max(F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    told = found.withColumn("_best", best)
    b = F.col("_best")
    return told.select("doc_id", F.size(runs).cast("long").alias("n_runs"), (-b["s"]).alias("start"), b["n"].alias("length"), (-b["p"]).alias("period"),
                       F.expr("(1000 * _best.n) div (-_best.p)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2(F.col(column)["collapsed"], 256).alias("collapsed_sha256"))
