"""Where to cut: decisions inside one row that depend on what was cut before.

Spark prepares numbers per line or span; a batch of rows crosses at once as flat
arrays, and only numbers come back (index ranges).  Text is cut by Spark.  Each
decision is a search in running sums, so the loops below are over cuts, not over lines.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import bounded_batches
from .tokens import DEFAULT_CHARS_PER_TOKEN, OTHER_WEIGHT, PUNCTUATION_WEIGHT, WHITESPACE_WEIGHT


class Nested:
    """Lists within one row: their numbers in one array, and where each begins."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i]:self.offsets[i + 1]]


def _plain(values: pa.Array) -> np.ndarray:
    if values.null_count:
        values = values.fill_null(False if pa.types.is_boolean(values.type) else 0)
    return values.to_numpy(zero_copy_only=False)


def _by_row(column: pa.Array) -> Callable[[int], object]:
    """Access to one row's value without making Python objects of its elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_list(column.type):
        plain = _plain(column)
        return lambda i: plain[i]
    outer, inner = column.offsets.to_numpy(), column.values
    if not len(inner) and not pa.types.is_primitive(inner.type):      # nothing in any row: there may be no buffers at all
        nothing = Nested(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        return lambda i: nothing
    if pa.types.is_list(inner.type):
        starts, flat = inner.offsets.to_numpy(), _plain(inner.values)
        return lambda i: Nested(flat, starts[outer[i]:outer[i + 1] + 1])
    if pa.types.is_string(inner.type):
        starts = np.frombuffer(inner.buffers()[1], dtype=np.int32)[inner.offset:inner.offset + len(inner) + 1]
        flat = np.frombuffer(inner.buffers()[2] or b"", dtype=np.uint8)
        return lambda i: Nested(flat, starts[outer[i]:outer[i + 1] + 1])
    flat = _plain(inner)
    return lambda i: flat[outer[i]:outer[i + 1]]


def with_walk(df: DataFrame, into: str, decide: Callable[..., list[tuple]], fields: list[str], **inputs: Column) -> DataFrame:
    """Add an array of bigint structs (`fields`), what `decide` returns for each row's `inputs`.

    The inputs must be computed in a projection of their own, as Spark cannot
    take out a Python function whose arguments hold nested lambdas.  Two
    references to them keep the projections apart; the column is sent once.
    """
    bounded_batches(df.sparkSession)
    names = list(inputs)

    @F.arrow_udf("array<struct<" + ",".join(f"{f}:bigint" for f in fields) + ">>")
    def run(batch: pa.Array, _same: pa.Array) -> pa.Array:
        if isinstance(batch, pa.ChunkedArray):
            batch = batch.combine_chunks()
        columns = [batch.field(name) for name in names]
        sound = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
        readers = [_by_row(c) for c in columns]
        rows = [decide(*[read(i) for read in readers]) if ok else [] for i, ok in enumerate(sound)]
        offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.array([entry for row in rows for entry in row], dtype=np.int64).reshape(-1, len(fields))
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(fields))], fields)
        return pa.ListArray.from_arrays(pa.array(offsets), struct)

    given = df.withColumn("_inputs", F.struct(*[value.alias(name) for name, value in inputs.items()]))
    return given.withColumn(into, run.asNondeterministic()(F.col("_inputs"), F.col("_inputs"))).drop("_inputs")


def tokens_of(word: int, space: int, punct: int, other: int, ratio: float = DEFAULT_CHARS_PER_TOKEN) -> int:
    return ceil(word / ratio + punct * PUNCTUATION_WEIGHT + other * OTHER_WEIGHT + space * WHITESPACE_WEIGHT)


def sums_before(values) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


class TokenSums:
    """Token counts of runs of lines joined by line feeds, out of running sums."""

    def __init__(self, words, spaces, puncts, others):
        self.sums = [sums_before(x) for x in (words, spaces, puncts, others)]
        w, s, p, o = self.sums
        self.rough = w / DEFAULT_CHARS_PER_TOKEN + (s + np.arange(len(s))) * WHITESPACE_WEIGHT + p * PUNCTUATION_WEIGHT + o * OTHER_WEIGHT

    def count(self, first: int, last: int, head=(0, 0, 0, 0), feeds: int = 0) -> int:
        w, s, p, o = (int(x[last + 1] - x[first]) + h for x, h in zip(self.sums, head))
        return tokens_of(w, s + last - first + feeds, p, o)

    def reach(self, first: int, start: int, stop: int, least: int, head=(0, 0, 0, 0), feeds: int = 0) -> int:
        """The first line k in [start, stop) for which lines first..k count `least` tokens or more; stop if there is none."""
        extra = head[0] / DEFAULT_CHARS_PER_TOKEN + (head[1] + feeds - 1) * WHITESPACE_WEIGHT + head[2] * PUNCTUATION_WEIGHT + head[3] * OTHER_WEIGHT
        k = int(np.searchsorted(self.rough, self.rough[first] + least - 1 - extra, side="right")) - 1
        k = min(max(k, start), stop)
        while k > start and self.count(first, k - 1, head, feeds) >= least:     # running sums of fractions may be off by a hair
            k -= 1
        while k < stop and self.count(first, k, head, feeds) < least:
            k += 1
        return k


# Bits of a line's flags.
FUNCTION, CLASS = 1, 2
# Block styles as numbers.
STYLES = {"none": 0, "braces": 1, "indent": 2}

SPAN_FIELDS = ["first", "n", "start_line", "end_line", "byte_start", "kind", "name_line"]

_STEP = np.zeros(256, dtype=np.int64)
_STEP[[ord(c) for c in "([{"]] = 1
_STEP[[ord(c) for c in ")]}"]] = -1


def heuristic_walk(max_tokens: int) -> Callable[..., list[tuple]]:
    """Cuts at definition lines, at the ends of their blocks, and where text outside them fills the budget.

    A block ends with the bracket that brings the depth, counted from the definition's line, back to
    zero; by indentation, in front of the line that is not deeper.  Text outside blocks that is below
    the budget goes in front of the next definition.
    """

    def decide(style, flags, sizes, marks, words, spaces, puncts, others):
        total = len(flags)
        starts = np.flatnonzero(flags & (FUNCTION | CLASS))
        at_byte = sums_before(sizes + 1)
        tokens = TokenSums(words, spaces, puncts, others)
        steps = _STEP[marks.values[marks.offsets[0]:marks.offsets[-1]]] if total else np.zeros(0, np.int64)
        mark_of = marks.offsets - marks.offsets[0]
        depth = np.cumsum(steps)
        line_of_mark = np.repeat(np.arange(total), np.diff(mark_of))
        out: list[tuple] = []

        def put(first, last, start, kind, named):
            out.append((first + 1, last - first + 1, start + 1, last + 1, int(at_byte[first]), kind, named))

        def loose(first, start, begin, stop):
            """Text outside blocks: full runs in [begin, stop) are cut off; what is left is (first, start)."""
            while first < stop:
                k = tokens.reach(first, max(begin, first), stop, max_tokens)
                if k >= stop:
                    break
                put(first, k, start, 0, 0)
                first = start = k + 1
            return first, start

        held, start = loose(0, 0, 0, int(starts[0]) if len(starts) else total)
        last_kind = last_named = 0
        for d, stop in zip(starts.tolist(), [*starts[1:].tolist(), total]):
            both = int(flags[d]) & (FUNCTION | CLASS)
            kind = CLASS if both & CLASS else FUNCTION
            if style == STYLES["indent"]:      # the line itself is not deeper than itself
                put(held, d - 1, d, kind, d + 1)
                held, start = loose(d, d, d, stop)
                last_kind = last_named = 0
                continue
            end = stop
            if style == STYLES["braces"]:
                a, b = mark_of[d], mark_of[stop]
                base = depth[a - 1] if a else 0
                closed = np.flatnonzero((depth[a:b] == base) & (steps[a:b] < 0))
                if len(closed):
                    end = int(line_of_mark[a + closed[0]])
            if end < stop:
                put(held, end, d, kind, d + 1)
                held, start = loose(end + 1, end + 1, end + 1, stop)
                last_kind = last_named = 0
            elif stop < total:
                put(held, stop - 1, d, kind, d + 1)
                held, start = stop, stop
            else:
                start, last_kind, last_named = d, FUNCTION if both & FUNCTION else CLASS, d + 1
        if held < total:
            put(held, total - 1, start, last_kind, last_named)
        return out

    return decide


PACK_FIELDS = ["first", "last", "tokens", "kind_of", "name_of", "line", "n_lines", "start_line", "byte_start", "byte_len"]


def pack_walk(hard: int, soft: int, overlap: int) -> Callable[..., list[tuple]]:
    """Spans that share a chunk, by index; an oversized span by runs of its lines (`line`, `n_lines`).

    `kind_of` and `name_of` are the spans a chunk takes its kind and name from: its last
    definition, or else its first span.
    """

    def by_lines(i, counts, sizes, out):
        """Runs of lines up to the soft limit, each beginning with the last lines of the one before."""
        tokens, length, n = sums_before(counts), sums_before(sizes), len(counts)
        first = begin = byte = line = 0
        while n:
            k = max(int(np.searchsorted(tokens, tokens[first] + soft, side="right")) - 1, first + 1, begin)
            if k >= n:
                out.append((i, i, int(tokens[n] - tokens[first]), i, i, first + 1, n - first, line, byte, -1))
                break
            size = int(length[k] - length[first]) + k - first - 1
            out.append((i, i, int(tokens[k] - tokens[first]), i, i, first + 1, k - first, line, byte, size))
            again = max(int(np.searchsorted(tokens, tokens[k] - overlap, side="left")), first)
            repeated = int(length[k] - length[again]) + k - again - 1 if again < k else 0
            line, byte = line + again - first, byte + size - repeated
            first, begin = again, k + 1

    def decide(tokens, boundary, names, filled, line_tokens, line_sizes):
        n, sums, out = len(tokens), sums_before(tokens), []
        huge = np.flatnonzero(tokens > hard)
        bounds = np.flatnonzero(boundary)
        # a definition parts from the one before it if both are named, and differently
        apart = bounds[1:][(names[bounds[1:]] != 0) & (names[bounds[:-1]] != 0) & (names[bounds[1:]] != names[bounds[:-1]])]
        full = np.flatnonzero(filled)
        at = 0
        for stop in [*huge.tolist(), n]:
            while at < stop:
                at = int(full[np.searchsorted(full, at)]) if len(full) and full[-1] >= at else stop     # no chunk begins with an empty span
                if at >= stop:
                    break
                by_size = int(np.searchsorted(sums, sums[at] + soft, side="right")) - 1
                own = np.searchsorted(bounds, at)
                quarter = int(np.searchsorted(sums * 4, sums[at] * 4 + soft, side="left"))
                after = max(int(bounds[own]) + 1 if own < len(bounds) else n, quarter)
                new = np.searchsorted(apart, after)
                end = min(max(by_size, at + 1), int(apart[new]) if new < len(apart) else n, stop)
                lead = np.searchsorted(bounds, end) - 1
                of = int(bounds[lead]) if lead >= 0 and bounds[lead] >= at else at
                out.append((at + 1, end, int(sums[end] - sums[at]), of + 1, of + 1, 0, 0, 0, 0, 0))
                at = end
            if stop < n:
                by_lines(stop + 1, line_tokens[stop], line_sizes[stop], out)
            at = stop + 1
        return out

    return decide


SPLIT_FIELDS = ["unit", "mode", "first", "n", "part", "start", "end", "byte_start", "byte_len"]
WHOLE, WINDOW, PART, HALF = 0, 1, 2, 3


def split_walk(max_tokens: int) -> Callable[..., list[tuple]]:
    """Parts of oversized units: windows of pieces, or runs of body lines behind a header.

    `start` and `end` are line offsets in the unit.
    """

    def windows(u, sizes, n_lines):
        firsts = np.arange(0, len(sizes), max_tokens)
        bytes_before = sums_before(sizes)
        ends = np.minimum(firsts + max_tokens, len(sizes))
        return [(u, WINDOW, f + 1, e - f, i + 1, f * n_lines // len(sizes), 0, bytes_before[f], bytes_before[e] - bytes_before[f])
                for i, (f, e) in enumerate(zip(firsts.tolist(), ends.tolist()))]

    def parts(u, header, sizes, counts, head):
        n, length = len(sizes), sums_before(sizes + 1)
        tokens, out, begin = TokenSums(*counts.reshape(-1, 4).T), [], header
        while begin < n:
            k = min(tokens.reach(begin, begin, n, max_tokens, tuple(int(h) for h in head), 1), n - 1)
            out.append((u, PART, begin + 1, k + 1 - begin, 0, begin, k, int(length[begin]), int(length[k + 1] - length[begin]) - 1))
            begin = k + 1
        return out

    def halves(u, sizes):
        n, middle, length = len(sizes), len(sizes) // 2, sums_before(sizes)
        upto = middle + min(10, n // 10)
        joined = lambda a, b: int(length[b] - length[a]) + max(b - a - 1, 0)
        return [(u, HALF, 1, upto, 1, 0, upto, 0, joined(0, upto)), (u, HALF, middle + 1, n - middle, 2, middle, n - 1, int(length[middle]) + middle, joined(middle, n))]

    def decide(large, container, piece_sizes, n_lines, headers, line_sizes, line_counts, head_counts):
        out = []
        for u in range(len(large)):
            cut = []
            if large[u] and container[u]:
                cut = parts(u + 1, int(headers[u]), line_sizes[u], line_counts[u], head_counts[u])
            elif large[u] and len(piece_sizes[u]) <= max_tokens:
                cut = halves(u + 1, line_sizes[u])
            elif large[u]:
                cut = windows(u + 1, piece_sizes[u], int(n_lines[u]))
            out.extend(cut or [(u + 1, WHOLE, 0, 0, 0, 0, 0, 0, 0)])
        return out

    return decide
