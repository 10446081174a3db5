"""Vector arithmetic: JVM expressions, and the Arrow scorer used on whole tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .columns import let

_ZERO = 0.0


def dot_expr(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(_ZERO), lambda acc, x: acc + x)


def norm_expr(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(_ZERO), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_expr(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, built-ins only; 0 for a zero vector."""
    scale = norm_expr(a) * norm_expr(b)
    return F.when(scale > 0, dot_expr(a, b) / scale).otherwise(_ZERO)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    return let(norm_expr(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n)
                                                   .otherwise(x.cast("double"))))


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean over the masked-in rows of an array of vectors (token states to one text vector)."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("h"), mask.alias("m")), lambda x: x["m"] > 0),
                       lambda x: x["h"])
    count = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    width = F.size(F.try_element_at(states, F.lit(1)))
    zero = F.array_repeat(F.lit(_ZERO), width)
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / count)


def matrix(batch: pa.Array) -> np.ndarray:
    """An Arrow list array of equally long vectors as one float64 matrix."""
    if isinstance(batch, pa.ChunkedArray):
        batch = batch.combine_chunks()
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    if len(batch) == 0:
        return np.empty((0, 0))
    if batch.null_count or len(flat) % len(batch) or np.any(np.diff(batch.offsets) != len(flat) // len(batch)):
        raise ValueError("vectors must be non-null and of one dimension")
    return flat.reshape(len(batch), -1).astype(np.float64)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column to one query vector.

    One matrix-vector product per Arrow batch.  Measured on 1M x 64: about half
    the time of the interpreted `zip_with`/`aggregate` expression, a quarter of
    the unrolled one; the gap widens with the dimension.
    """
    wanted = np.asarray(query, dtype=np.float64)
    norm = float(np.linalg.norm(wanted))

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        points = matrix(batch)
        if len(points) == 0:
            return pa.array([], pa.float64())
        if points.shape[1] != len(wanted):
            raise ValueError(f"query has dimension {len(wanted)}, vectors have {points.shape[1]}")
        scale = np.sqrt(np.einsum("ij,ij->i", points, points)) * norm
        return pa.array(np.divide(points @ wanted, scale, out=np.zeros(len(points)), where=scale > 0))

    return score(vector)
