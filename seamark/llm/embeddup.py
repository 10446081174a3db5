"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered by their signs along random directions, read as one number, and each is
compared with the neighbours in a bounded window.  A pair parts in a pass if its codes differ early;
the passes are as many as the target recall needs at this number of vectors.  That holds where no more than a
window of rows share the leading signs.  Rows of longer runs are dense: signs through the origin do not part them.
They are projected again, within coarse cells and as seen from the cell's centre, in wider windows, and such
rounds of passes are added until a whole one joins no two components.  What a window links becomes
edges of components (one edge per row and window, not all pairs).  Links are then counted exactly inside
components, since linked vectors are always in the same one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import Scratch, connected_components

BITS = 63
SMALL = 256     # vectors of a component that one task compares exhaustively
BINS = 4096
WIDE = 1024     # window of a pass over dense rows
ROUND = 8       # passes over dense rows between two looks at what they joined


def leading_bits(n: int, window: int) -> int:
    """So many signs that far fewer than a window of evenly spread rows share them."""
    return min(BITS, max(1, math.ceil(math.log2(max(2, n / window)))) + 2)


def passes_needed(n: int, window: int, least: float, recall: float) -> int:
    """So many passes that a pair at the threshold shares the leading signs of one with probability `recall`, however vectors lie."""
    agree = 1 - math.acos(least) / math.pi
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree ** leading_bits(n, window))))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _codes(vector, passes: int, bits: int = BITS, seed: int = 0):
    """In each pass the signs along `bits` random directions, as one number."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        directions: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            out: list = [None] * len(batch)
            sizes = np.diff(batch.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size not in directions:
                    directions[size] = np.random.default_rng([seed, size]).normal(size=(size, passes * bits))
                signs = _matrix(batch.take(pa.array(rows)), size) @ directions[size] > 0
                for row, code in zip(rows, signs.reshape(len(rows), passes, bits) @ powers):
                    out[row] = code
            yield pa.array(out, pa.list_(pa.int64()))

    return run(vector)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)     # no overflow or loss in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _windows(least: float, window: int):
    """Over rows sorted by (size, pass, code): edges to the smallest row each is linked with inside its window."""

    def flush(ids: np.ndarray, units: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(ids), window):
            part, own = units[at:at + 2 * window], ids[at:at + 2 * window]
            if len(own) < 2:
                return
            linked = part @ part.T >= least
            some = np.flatnonzero(linked.sum(axis=1) > 1)      # the others are linked with themselves only
            if not len(some):
                continue
            linked, own = linked[np.ix_(some, some)], own[some]
            label = np.arange(len(own))
            while True:
                lower = np.where(linked, label[None, :], len(own)).min(axis=1)
                lower = np.minimum(lower, lower[lower])
                if (lower == label).all():
                    break
                label = lower
            moved = np.flatnonzero(label != np.arange(len(own)))
            yield own[moved], own[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, units = None, np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            sizes, numbers = batch["size"].to_numpy(), batch["pass"].to_numpy()
            cuts = np.flatnonzero((sizes[1:] != sizes[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sizes)]])):
                if a == b:
                    continue
                here = (sizes[a], numbers[a])
                fresh = _unit(_matrix(batch["vector"].slice(a, b - a), int(sizes[a])))
                if here == key:   # the last window of what came before is compared again with what follows
                    ids, units = np.concatenate([ids[-window:], batch["cid"].to_numpy()[a:b]]), np.concatenate([units[-window:], fresh])
                else:
                    key, ids, units = here, batch["cid"].to_numpy()[a:b], fresh
                for left, right in flush(ids, units):
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return run


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch and cell, the sum of unit vectors: what tasks send towards the centres."""
    names = ["size", "pass", "cell", "sums"]
    for batch in batches:
        sizes, cells = batch["size"].to_numpy(), np.array(batch["cells"].to_pylist(), dtype=np.int64)
        out: list[tuple] = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            units = _unit(_matrix(batch["vector"].take(pa.array(rows)), int(size)))
            for number in range(cells.shape[1]):
                found, place = np.unique(cells[rows, number], return_inverse=True)
                order = np.argsort(place, kind="stable")
                sums = np.add.reduceat(units[order], np.searchsorted(place[order], np.arange(len(found))))
                out.extend((int(size), number, int(cell), total) for cell, total in zip(found, sums))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out) if out else [[]] * 4, types)], names=names)


def _seen_from(vector, centre, number, seed: int):
    """Signs of a unit vector along random directions of its pass, as seen from the centre of its cell."""
    @F.arrow_udf("long")
    def run(vectors: pa.Array, centres: pa.Array, numbers: pa.Array) -> pa.Array:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        sizes, passes = np.diff(vectors.offsets.to_numpy()), numbers.to_numpy()
        out = np.zeros(len(vectors), np.int64)
        for size, number in {*zip(sizes.tolist(), passes.tolist())}:
            rows = np.flatnonzero((sizes == size) & (passes == number))
            at = pa.array(rows)
            offset = _unit(_matrix(vectors.take(at), size))
            middle = _matrix(centres.take(at), size)
            # the part along the centre says how far a vector lies from it, not where; only the rest is split evenly
            offset -= middle * (np.einsum("ij,ij->i", offset, middle) / np.maximum(np.einsum("ij,ij->i", middle, middle), 1e-300))[:, None]
            out[rows] = (offset @ np.random.default_rng([seed, size, number]).normal(size=(size, BITS)) > 0) @ powers
        return pa.array(out)

    return run(vector, centre, number)


def _dense_rounds(dense: DataFrame, edges: DataFrame, scratch: Scratch, least: float, cell_bits: int) -> DataFrame:
    """Components of `edges` and of what passes over the dense rows add; rounds end when one joins nothing.

    A pass gives each row a cell (its signs along `cell_bits` directions), takes the cell's centre from sums made on
    the map side, and sorts by cell and by the signs seen from there.  A cell may hold any share of the rows: it is
    sorted over as many tasks as it needs, and adaptive execution splits its join with the centres.
    """
    parts = connected_components(edges, scratch)
    if dense.isEmpty():
        return parts
    for seed in count(1):
        cells = dense.withColumn("cells", _codes(F.col("vector"), ROUND, cell_bits, seed))
        sums = cells.select("vector", "size", "cells").mapInArrow(_cell_sums, "size int, pass int, cell long, sums array<double>")
        key = ["size", "pass", "cell"]
        added = sums.select(*key, F.posexplode("sums")).groupBy(*key, "pos").agg(F.sum("col").alias("x"))
        centres = scratch.keep(added.groupBy(*key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre")), "centres")   # as long as a vector
        placed = cells.select("cid", "vector", "size", F.posexplode("cells").alias("pass", "cell")).join(centres, key)
        coded = placed.withColumn("code", _seen_from(F.col("vector"), F.col("centre"), F.col("pass"), seed)).drop("centre")
        ordered = coded.repartitionByRange(*key, "code").sortWithinPartitions(*key, "code", "cid").select("cid", "vector", "size", "pass")
        met = ordered.mapInArrow(_windows(least, WIDE), "a long, b long").distinct()
        label = parts.select(F.col("vertex"), "component")
        named = met.join(label.select(F.col("vertex").alias("a"), F.col("component").alias("ca")), "a", "left").join(
            label.select(F.col("vertex").alias("b"), F.col("component").alias("cb")), "b", "left")
        fresh = scratch.keep(named.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "fresh")
        if fresh.isEmpty():
            return parts
        edges = scratch.keep(edges.unionByName(fresh), "edges")
        parts = connected_components(edges, scratch)


def _count_small(least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        units = _unit(np.stack(group["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"cid": group["cid"], "n_links": (units @ units.T >= least) @ group["copies"].to_numpy() - 1})
    return run


def _count_large(rows: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """Links inside large components, most of them without comparing: by the angles to the component's centre.

    Two vectors whose angles to the centre add up to less than the threshold's are linked; those are
    counted from a histogram of the angles.  Only pairs of outer vectors, whose angles add up to more,
    are compared, block by block; such blocks are spread over the cluster.
    """
    limit = math.acos(least)

    @F.arrow_udf("array<double>")
    def unit(batch: pa.Array) -> pa.Array:
        return pa.array([_unit(np.array([v], dtype=np.float64))[0] for v in batch.to_pylist()], pa.list_(pa.float64()))

    @F.arrow_udf("int")
    def angle(vectors: pa.Array, centres: pa.Array) -> pa.Array:
        out = [int(math.acos(max(-1.0, min(1.0, float(np.dot(v, _unit(np.array([c]))[0]))))) / limit * BINS)
               for v, c in zip(map(np.asarray, vectors.to_pylist()), centres.to_pylist())]
        return pa.array(out, pa.int32())

    units = scratch.keep(rows.withColumn("unit", unit("vector")).drop("vector"), "units")
    centre = units.select("component", F.posexplode("unit")).groupBy("component", "pos").agg(F.avg("col").alias("x")).groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))   # as long as a vector
    binned = scratch.keep(units.join(centre, "component").withColumn("bin", angle("unit", "centre")).drop("centre"), "binned")
    running = Window.partitionBy("component").orderBy("bin")        # a row per bin that holds a vector, at most BINS * pi / limit
    counts = binned.groupBy("component", "bin").agg(F.sum("copies").alias("n")).withColumn("upto", F.sum("n").over(running)).withColumn(
        "next", F.coalesce(F.lead("bin").over(running), F.lit(1 << 30)))
    outermost = counts.groupBy("component").agg(F.max("bin").alias("most"))
    levels = binned.select("component", "bin").distinct().withColumn("reach", F.lit(BINS - 2) - F.col("bin"))
    sure = levels.join(counts.select("component", F.col("bin").alias("from"), "next", "upto"), "component").filter(
        "reach >= `from` and reach < next").select("component", "bin", "upto")
    marked = binned.join(sure, ["component", "bin"], "left").join(outermost, "component").withColumn("sure", F.coalesce("upto", F.lit(0))).withColumn(
        "self", F.when(F.col("bin") * 2 <= BINS - 2, F.col("copies")).otherwise(0))     # whether a vector counted itself and its copies
    outer = scratch.keep(marked.filter(F.col("bin") + F.col("most") > BINS - 2), "outer")
    block = F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(F.col("size") / SMALL), F.lit(1)))
    sized = outer.join(outer.groupBy("component").agg(F.count("*").alias("size")), "component").withColumn("block", block)
    other = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / SMALL), F.lit(1)) - 1)
    spread = sized.withColumn("other", F.explode(other)).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        m, bins, copies = np.stack(group["unit"].to_numpy()), group["bin"].to_numpy(), group["copies"].to_numpy()
        own = group["block"].to_numpy()
        cross = own[:, None] != own[None, :] if group["low"].iloc[0] != group["high"].iloc[0] else np.ones((len(m), len(m)), bool)
        open_ = (bins[:, None] + bins[None, :] > BINS - 2) & cross
        np.fill_diagonal(open_, False)
        return pd.DataFrame({"cid": group["cid"], "more": ((m @ m.T >= least) & open_) @ copies})

    more = spread.groupBy("component", "low", "high").applyInPandas(compare, "cid long, more long").groupBy("cid").agg(F.sum("more").alias("more"))
    return marked.join(more, "cid", "left").select(
        "cid", (F.col("sure") - F.col("self") + F.col("copies") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"))


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
                           window: int = 64, recall: float = 0.999) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    Linked: cosine in double precision of at least `least`, between vectors of one length.  Vectors that are null,
    empty, zero, or hold a null or non-finite component link with nothing.  Equal vectors are one class
    until the end and link with each other.  Rows with a null id take part; the smallest id that is not
    null names a component.  Repeated rows are copies.  An empty table gives an empty result.

    `recall` is the chance of each pair at the threshold to be found where vectors are spread; in dense groups
    passes are added until none joins anything.
    """
    scratch = Scratch(spark, "embeddup")
    value = F.col(vector_col)
    sound = F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    given = vectors.select(F.col(id_col).alias("id"), F.when(sound, value).alias("vector"))
    sound_rows = given.filter("vector is not null")
    n = sound_rows.count()
    bits, passes = leading_bits(n, window), passes_needed(n, window, least, recall)
    unlike = sound_rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    coded = scratch.keep(unlike.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("vector")).withColumn(
        "codes", _codes(F.col("vector"), passes)), "classes")
    classes = coded.select("vector", "rep", "copies", "cid")
    rows = coded.select("cid", "vector", "size", F.posexplode("codes").alias("pass", "code"))
    ordered = rows.repartitionByRange("size", "pass", "code").sortWithinPartitions("size", "pass", "code", "cid").select("cid", "vector", "size", "pass")
    edges = scratch.keep(ordered.mapInArrow(_windows(least, window), "a long, b long").distinct(), "edges")
    leading = coded.select("cid", "size", F.posexplode("codes").alias("pass", "code")).withColumn("lead", F.shiftright("code", BITS - bits))
    run = ["size", "pass", "lead"]
    long_runs = leading.groupBy(*run).agg(F.count("*").alias("rows")).filter(F.col("rows") > window)
    crowded = leading.join(long_runs, run, "left_semi").select("cid").distinct()
    dense = scratch.keep(coded.select("cid", "vector", "size").join(crowded, "cid", "left_semi"), "dense")
    parts = _dense_rounds(dense, edges, scratch, least, max(1, bits // 2))
    full = scratch.keep(parts.withColumnRenamed("vertex", "cid").join(classes, "cid"), "members")
    sizes = full.groupBy("component").agg(F.count("*").alias("members"), F.min("rep").alias("lowest"))
    sized = scratch.keep(full.join(sizes, "component"), "sized")
    small = sized.filter(F.col("members") <= SMALL).select("component", "cid", "vector", "copies").groupBy("component").applyInPandas(_count_small(least), "cid long, n_links long")
    large = sized.filter(F.col("members") > SMALL).select("component", "cid", "vector", "copies")
    counted = small if large.isEmpty() else small.unionByName(_count_large(large, scratch, least))
    named = classes.join(counted, "cid", "left").join(sized.select("cid", "lowest"), "cid", "left").select(
        F.col("vector").alias("_v"), F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "rep").alias("component_id"))
    out = given.join(named, F.col("vector") == F.col("_v"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
