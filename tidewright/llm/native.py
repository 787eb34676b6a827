"""Column helpers for the operators that use DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: no space and none of the other ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, block: int = 256) -> Column:
    """The sum of all earlier elements, for each element of an array of longs; by blocks, not quadratic."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_block(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))), lambda b: total(F.slice(v, b * block + 1, F.lit(block))))
        return let(
            let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))),
            lambda base: F.transform(v, lambda _, i: F.get(base, F.floor(i / block).cast("int")) + total(F.slice(v, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int")))),
        )

    return let(values, by_block)
