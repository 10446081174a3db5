"""Small helpers for composing higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    Inside a lambda Catalyst does not share common sub-expressions, so a value
    that is read repeatedly is bound to a lambda variable first.
    """
    return F.transform(F.array(value), body)[0]


def struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def running_starts(sizes: Column, block: int = 256) -> Column:
    """For an array of lengths the start of each element, the first at 0.

    Summed in blocks, since a growing array is copied at every step of a fold.
    """

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.expr("array(cast(0 as bigint))"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def over(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / block).cast("int")),
                             lambda b: F.slice(values, b * block + 1, F.lit(block)))
        return let(F.transform(blocks, sums), lambda within: let(
            sums(F.transform(within, lambda s: F.element_at(s, -1))),
            lambda base: F.flatten(F.transform(within, lambda s, b: F.transform(
                F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + base[b])))))

    return let(F.transform(sizes, lambda n: n.cast("long")), over)
