"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed together.
CHUNK = 500


def running(sizes: Column) -> Column:
    """array<long>: for each element the sum of those before it.

    Sums run within chunks and over chunks, so long arrays take no quadratic copying; ``sizes`` may be any expression, as it is
    evaluated once and not again for each chunk.
    """
    none = F.array().cast("array<long>")

    def sums(start: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.cast("long").alias("sum"), none.alias("before")),
            lambda acc, size: F.struct((acc["sum"] + size).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")),
        )["before"]

    def over(sizes: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)))
        totals = lambda chunks: F.transform(chunks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b))
        found = let(cut, lambda chunks: F.flatten(F.zip_with(chunks, sums(F.lit(0), totals(chunks)), lambda part, start: sums(start, part))))
        return F.when(F.size(sizes) > 0, found).otherwise(none)

    return let(sizes, over)


def let(value: Column, body) -> Column:
    """``body(value)``, with the value evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
