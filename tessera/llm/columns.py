"""Column helpers for work on long arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values folded in one block.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nothing(kind: str) -> Column:
    """An empty array of this type."""
    return F.array().cast(kind)


def before(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each integer what ``join`` makes of all before it (``zero`` for the first).

    A fold copies what it carries at every step, so blocks are folded alone, then
    their totals, and both are joined.
    """

    def fold(numbers: Column) -> Column:
        """Struct (at, out): the total, and the value before each number."""

        def step(acc: Column, x: Column) -> Column:
            return F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        return F.aggregate(numbers, F.struct(F.lit(zero).alias("at"), nothing("array<int>").alias("out")), step)

    def split(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))))

    def lifted(blocks: Column) -> Column:
        offsets = fold(F.transform(blocks, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(blocks, offsets, lambda x, o: F.transform(x["out"], lambda v: join(o, v))))

    return F.when(F.size(values) > 0, let(let(values, split), lifted)).otherwise(nothing("array<int>"))
