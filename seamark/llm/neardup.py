"""Near duplicates by banded minwise values: rows that agree on a whole band meet, and full sets decide.

Each of `trees` bands joins `BAND` minwise coordinates; documents that agree on all of
them share a node.  Within a node signatures tell which pairs may be linked, and a forest
of the most alike of these pairs hangs together all rows that have one.  Then the full sets
of just these rows travel to the node, where all pairs are compared, and again a forest of
the links is what leaves it.  A pair is lost only if no band holds it or its signatures mislead.

What keeps the work linear:

* Documents with equal shingle sets are one class from the start; the rest works on classes.
* Bands part unlike documents before anything is compared, so nodes hold copies and little else.
* No table holds a row for a pair: a node of n rows makes n - 1 rows at most, of candidates as of links.
* A pair counts only in the first band that both rows share, so later bands carry only what earlier ones parted.
* Hot nodes never meet in a task.  Nodes are counted with map-side sums, rows join these
  counts (adaptive execution splits the hot side), and of a node above `small` rows, or as
  many words as `small` rows of `ROW` words have, every two blocks meet in a node of their own.

A class is named by a 64-bit hash of its set; among n classes two share a name with a chance of n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import textbytes
from .common import Scratch, connected_components

COORDINATES = 128
BAND = 3        # minwise coordinates a node's rows agree on; a pair at the threshold of 0.8 shares one of 16 bands but for 1 in 90,000
ROW = 256       # words that count as a row when a node is cut into blocks
_SALTS = [np.uint64(s) for s in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F,
                                 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("b1", T.LongType()),
                       T.StructField("b2", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType())),
                       T.StructField("roots", T.ArrayType(T.IntegerType()))])
PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _shingles(w: textbytes.Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    h, owner = w.hashes, w.owner()
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
        for k in range(size):
            total = textbytes.mix(total + h[k:k + len(total)] * _SALTS[k % len(_SALTS)])
        del owner
        for i in range(w.texts):
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            if b - a >= size:
                yield np.unique(total[a:b - size + 1])
            elif b > a:
                value = np.zeros(1, dtype=np.uint64)
                for k in range(a, b):
                    value = textbytes.mix(value + h[k:k + 1] * _SALTS[(k - a) % len(_SALTS)] + np.uint64(b - a))
                yield value
            else:
                yield h[:0]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd[:, None], rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]


def _minwise(values: np.ndarray, factor: np.ndarray, shift: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each coordinate the identity (low 32 bits) of the shingle that comes first in its order."""
    rows = np.arange(COORDINATES)
    best = winner = None
    for at in range(0, len(values), block):
        part = values[at:at + block]
        order = (part >> np.uint64(32)).astype(np.uint32)[None, :] * factor + shift
        first = order.argmin(axis=1)
        lowest, ids = order[rows, first], part[first].astype(np.uint32)
        if best is None:
            best, winner = lowest, ids
        else:
            better = lowest < best
            best, winner = np.where(better, lowest, best), np.where(better, ids, winner)
    return winner


def _band_hashes(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros(len(values), dtype=np.uint64)
        for k in range(values.shape[1]):
            total = textbytes.mix(total + (values[:, k].astype(np.uint64) + np.uint64(1)) * _SALTS[k % len(_SALTS)])
    return total.astype(np.uint32).view(np.int32)


def sketch(text: Column, size: int, trees: int = 16) -> Column:
    """Of each text: set size, class (null without words), 128 minwise values of one bit, of eight bits, a hash of each of `trees` bands."""
    bands = np.arange(trees * BAND) % COORDINATES

    def lists(rows: list[np.ndarray], kind: type) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, kind)))

    @F.arrow_udf(SKETCH)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        factor, shift = _coefficients()
        for batch in batches:
            n, cid, bits, sig, roots, empty = [], [], [], [], [], []
            for w in textbytes.words(batch):
                for values in _shingles(w, size):
                    n.append(len(values))
                    empty.append(not len(values))
                    if len(values):
                        cid.append(int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True))
                        ids = _minwise(values, factor, shift)
                        sig.append((ids & 255).astype(np.uint8).view(np.int64))
                        roots.append(_band_hashes(ids[bands].reshape(trees, BAND)))
                        bits.append(np.packbits(ids & 1).view(np.int64))
                    else:
                        cid.append(0)
                        sig.append(np.zeros(0, np.int64))
                        roots.append(np.zeros(0, np.int32))
                        bits.append(np.zeros(2, np.int64))
            mask = np.array(empty, dtype=bool)
            bits = np.array(bits, dtype=np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(np.array(cid, dtype=np.int64), mask=mask), pa.array(bits[:, 0], mask=mask),
                 pa.array(bits[:, 1], mask=mask), lists(sig, np.int64), lists(roots, np.int32)], names=SKETCH.names)

    return run(text)


def shingle_set(text: Column, size: int) -> Column:
    """(class, full sorted set of 64-bit shingles as bytes)."""
    kind = T.StructType([T.StructField("cid", T.LongType()), T.StructField("shingles", T.BinaryType())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cid, sets = [], []
            for w in textbytes.words(batch):
                for values in _shingles(w, size):
                    raw = values.tobytes()
                    sets.append(raw)
                    cid.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) if raw else None)
            yield pa.StructArray.from_arrays([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], names=kind.names)

    return run(text)


def _node(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _least_equal(percent: int, deviations: float = 3.3) -> int:
    """Coordinates on which a linked pair agrees at least, but for one in 2,000 of those right at the threshold."""
    mean = COORDINATES * percent / 100
    return int(mean - deviations * (mean * (1 - percent / 100)) ** 0.5)


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _per_node(of_node: Callable[..., list[tuple[int, int]]], *names: str):
    """Column of the pairs that `of_node` makes of a node's members, given their fields `names`."""

    @F.arrow_udf(PAIRS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for nodes in batches:
            members, ends = nodes.flatten(), np.concatenate([[0], np.cumsum(nodes.value_lengths().to_numpy(zero_copy_only=False))])
            fields = [members.field(name) for name in names]
            yield pa.array([[{"a": a, "b": b} for a, b in of_node(*[f.slice(i, j - i) for f in fields])] for i, j in zip(ends[:-1], ends[1:])],
                           pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return run


def _forest(percent: int) -> Callable[..., list[tuple[int, int]]]:
    """The most alike pairs that hang together all that signatures and sizes say may hang together."""
    least = _least_equal(percent)

    def run(cid: pa.Array, n: pa.Array, sig: pa.Array, roots: pa.Array, tree: pa.Array, block: pa.Array, alone: pa.Array) -> list[tuple[int, int]]:
        cid, n, block = (c.to_numpy(zero_copy_only=False) for c in (cid, n, block))
        own, sig, earlier = alone.to_numpy(zero_copy_only=False).all(), np.ascontiguousarray(_lists(sig)).view(np.uint8), _lists(roots)[:, :tree[0].as_py()]
        left, best, to, found = np.ones(len(cid), dtype=bool), np.zeros(len(cid), dtype=np.int64), np.zeros(len(cid), dtype=np.int64), []
        at = 0
        for _ in range(len(cid) - 1):
            left[at] = False
            equal = (sig == sig[at]).sum(axis=1)
            better = left & (equal >= least) & (equal > best) & (np.minimum(n, n[at]) * 100 >= np.maximum(n, n[at]) * percent)
            if not own:
                better &= block != block[at]
            rows = np.flatnonzero(better)
            if len(rows):
                rows = rows[~(earlier[rows] == earlier[at]).any(axis=1)]    # others met in an earlier band
                best[rows], to[rows] = equal[rows], at
            at = int(np.where(left, best, -1).argmax())
            if best[at]:
                found.append((int(min(cid[at], cid[to[at]])), int(max(cid[at], cid[to[at]]))))
        return found

    return run


def _linked(percent: int) -> Callable[..., list[tuple[int, int]]]:
    """Links that lead to all that links between the full sets of a node lead to."""

    def run(cid: pa.Array, shingles: pa.Array) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles]
        cid, n = cid.to_numpy(zero_copy_only=False), np.array([len(x) for x in sets])
        parent, found = list(range(len(sets))), []
        for i, row in enumerate(_common(sets)):
            for j in np.flatnonzero(row * 100 >= (n[i] + n - row) * percent):
                x, y = _root(parent, i), _root(parent, int(j))
                if x != y:
                    parent[x] = y
                    found.append((int(min(cid[i], cid[j])), int(max(cid[i], cid[j]))))
        return found

    return run


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _common(sets: list[np.ndarray], columns: int = 512, rows: int = 256) -> Iterator[np.ndarray]:
    """For each set the sizes of its intersections with all."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = values.argsort(kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    alone = first & np.concatenate([first[1:], [True]])     # a shingle of one set is in no intersection but that with itself
    own = np.bincount(owner[alone], minlength=len(sets))
    column, owner = np.cumsum(first[~alone]) - 1, owner[~alone]
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + columns, columns))
    for start in range(0, len(sets), rows):
        size = np.zeros((min(rows, len(sets) - start), len(sets)), dtype=np.float32)    # whole numbers below 2**24 are exact
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            holds = np.zeros((len(sets), columns), dtype=np.float32)
            holds[owner[a:b], column[a:b] - k * columns] = 1
            size += holds[start:start + rows] @ holds.T
        size = size.astype(np.int64)
        size[np.arange(len(size)), np.arange(start, start + len(size))] += own[start:start + rows]
        yield from size


def _pairs_in_blocks(rows: DataFrame, percent: int, small: int) -> DataFrame:
    """(node, a, b): in every two blocks of a node the pairs of a forest of all that may be linked; nodes of up to `small` are one block."""
    count = F.when(F.col("size") <= small, F.lit(1)).otherwise(F.ceil(F.col("size") * 2 / small)).cast("long")
    given = rows if "roots" in rows.columns else rows.withColumn("roots", F.array().cast("array<int>")).withColumn("tree", F.lit(0))
    spread = given.withColumn("block", F.pmod(_node(F.lit("block"), F.col("cid")), count)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).withColumn("alone", F.col("block") == F.col("other"))
    names = ("cid", "n", "sig", "roots", "tree", "block", "alone")
    nodes = spread.groupBy(_node(F.col("node"), F.least("block", "other"), F.greatest("block", "other")).alias("node")).agg(
        F.collect_list(F.struct(*names)).alias("m"))
    found = _per_node(_forest(percent), *names)
    return nodes.select("node", F.explode(found("m")).alias("p")).select("node", "p.a", "p.b")


def near_duplicate_links(classes: DataFrame, scratch: Scratch, percent: int, sets_of: Callable[[DataFrame], DataFrame], small: int = 4096) -> DataFrame:
    """Pairs (a, b) of classes that lead to all that links lead to; links are confirmed on the full sets.

    `classes` has cid, n, sig, roots; `sets_of` gives (cid, shingles) of the classes in a table with cid.
    """
    rows = classes.select("cid", "n", F.posexplode("roots").alias("tree", "value")).select(
        "cid", "n", "tree", _node(F.col("tree"), F.col("value")).alias("node"))
    counts = rows.groupBy("node").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).filter("rows > 1").select(
        "node", F.greatest("rows", F.ceil(F.col("words") / ROW)).alias("size"))
    shared = scratch.keep(rows.drop("n").join(counts, "node"), "nodes")
    pairs = scratch.keep(_pairs_in_blocks(shared.join(classes.select("cid", "n", "sig", "roots"), "cid"), percent, small), "pairs")
    scratch.drop(shared)
    met = scratch.keep(pairs.select("node", F.explode(F.array("a", "b")).alias("cid")).distinct(), "met")
    scratch.drop(pairs)
    nodes = met.join(sets_of(met.select("cid").distinct()), "cid").groupBy("node").agg(F.collect_list(F.struct("cid", "shingles")).alias("m"))
    found = _per_node(_linked(percent), "cid", "shingles")
    return nodes.select(F.explode(found("m")).alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, trees: int = 16) -> DataFrame:
    """One row per row of `docs`: its id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their sets of
    `shingle`-word shingles (A-Z folded).  component_id is the smallest id that links lead to.
    Rows without words are linked with nothing and stay.  Rows with a null id keep their own null
    component unless they hang together with a row that has one.  Rows that repeat an id are judged each by its own text.
    An empty table gives an empty result; other columns of `docs` are not read.
    """
    scratch = Scratch(spark, "neardup")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = scratch.keep(given.select("id", sketch(F.col("text"), shingle, trees).alias("s")).select("id", "s.*"), "sketches")
    classes = scratch.keep(sketches.filter("cid is not null").groupBy("cid").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "sig", "roots")]), "classes")
    sets = scratch.keep(sketches.select("id", "n", "cid"), "sizes")
    scratch.drop(sketches)

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = scratch.keep(wanted.join(classes.select("cid", "rep"), "cid"), "wanted")
        texts = given.join(wanted.select(F.col("rep").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi").select(
            shingle_set(F.col("text"), shingle).alias("s")).select("s.*")
        return texts.dropDuplicates(["cid"])

    links = scratch.keep(near_duplicate_links(classes, scratch, percent, sets_of), "links")
    parts = connected_components(links, scratch)
    named = parts.join(classes.select(F.col("cid").alias("vertex"), "rep"), "vertex")
    lowest = named.groupBy("component").agg(F.min("rep").alias("lowest"))
    renamed = named.join(lowest, "component").select(F.col("vertex").alias("cid"), "lowest")
    whole = scratch.keep(classes.select("cid", "rep").join(renamed, "cid", "left").select("cid", F.coalesce("lowest", "rep").alias("lowest")), "named")
    out = sets.select("id", "n", "cid").join(whole, "cid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("lowest", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
