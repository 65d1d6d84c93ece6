"""Column functions over ordered arrays, each of work in proportion to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def places(items: Column | str, test: Callable[[Column, Column], Column]) -> Column:
    """The places, from 1, of the items for which ``test(item, place from 0)`` is true."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(test(x, i), i + 1)))


def runs(items: Column | str, starts: Column | str) -> Column:
    """The array cut into runs that begin at ``starts``, places from 1 in order; what stands before the first is left out.

    So the number of a run is a running count of whatever the starts mark.
    """
    items, starts = as_column(items), as_column(starts)
    end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(items) + 1)
    return F.transform(starts, lambda p, j: F.slice(items, p, end(j) - p))


def sums_before(numbers: Column | str) -> Column:
    """For each block of ``BLOCK`` numbers the sum of all numbers before it: with ``sum_before``, a running sum without a fold that copies."""
    numbers = as_column(numbers)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / BLOCK).cast("int")), lambda b: total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
    many = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<long>)").alias("out")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])
    return F.when(F.size(numbers) < BLOCK, F.array(F.lit(0).cast("long"))).otherwise(many)


def total(numbers: Column | str) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def sum_before(numbers: Column | str, sums: Column | str, place: Column) -> Column:
    """The sum of the numbers before a place (from 0), given ``sums_before``."""
    block = F.floor(place / BLOCK).cast("int")
    inside = place - block * BLOCK
    rest = F.when(inside > 0, total(F.slice(as_column(numbers), block * BLOCK + 1, inside))).otherwise(F.lit(0).cast("long"))
    return F.get(as_column(sums), block) + rest
