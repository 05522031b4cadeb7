"""Values carried along sorted positions, so that no chromosome is sorted or scanned in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a stretch, which one task sorts.
STRETCH = 1 << 16
NAME = "__stretch"
#: Stretches of a block, whose rows one task sorts.
BLOCK = 1 << 12


def stretch_of(position: str | Column, size: int = STRETCH) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / size)


def inside(*order, group: Sequence[str] = ("chr",), first: int = Window.unboundedPreceding, last: int = Window.currentRow) -> Window:
    """Rows of the same stretch, from its beginning to the current row."""
    return Window.partitionBy(*group, NAME).orderBy(*order).rowsBetween(first, last)


def totals(rows: DataFrame, group: Sequence[str] = ("chr",), **what: tuple[Column, Callable[[Column], Column], int]) -> DataFrame:
    """For each stretch that has rows, what the stretches before it (or after it) amount to; null if there are none.

    ``what`` names an aggregate of a stretch, how aggregates of stretches combine (an aggregate over
    a window), and 1 for the stretches before or -1 for those after. Rows of stretches meet in blocks, and
    one row for each block in the task of its chromosome.
    """
    own = rows.groupBy(*group, NAME).agg(*(a.alias(f"__{n}") for n, (a, _, _) in what.items()))
    own = own.withColumn("__block", F.floor(F.col(NAME) / BLOCK))
    before = lambda order, *part: {d: Window.partitionBy(*part).orderBy(F.col(order) * d).rowsBetween(Window.unboundedPreceding, -1) for d in (1, -1)}
    whole = own.groupBy(*group, "__block").agg(*(combine(F.col(f"__{n}")).alias(f"__{n}") for n, (_, combine, _) in what.items()))
    beyond = before("__block", *group)
    whole = whole.select(*group, "__block", *(combine(F.col(f"__{n}")).over(beyond[d]).alias(f"__{n}") for n, (_, combine, d) in what.items()))
    # what other blocks amount to stands in a row before the block's first stretch and in one behind its last
    ends = [whole.select(*group, F.lit(side).alias("__side"), F.lit(None).cast("long").alias(NAME), "__block", *((F.col(f"__{n}") if d == -side else F.lit(None).cast(whole.schema[f"__{n}"].dataType)).alias(f"__{n}") for n, (_, _, d) in what.items())) for side in (-1, 1) if any(d == -side for _, _, d in what.values())]
    rows = reduce(DataFrame.unionByName, ends, own.withColumn("__side", F.lit(0)))
    over = {d: Window.partitionBy(*group, "__block").orderBy(F.col("__side") * d, F.col(NAME) * d).rowsBetween(Window.unboundedPreceding, -1) for d in (1, -1)}
    return rows.select(*group, NAME, "__side", *(combine(F.col(f"__{n}")).over(over[d]).alias(n) for n, (_, combine, d) in what.items())).where("__side = 0").drop("__side")


def carry(rows: DataFrame, group: Sequence[str] = ("chr",), **what: tuple[Column, Callable[[Column], Column], int]) -> DataFrame:
    """Adds to each row what ``totals`` tells of its stretch."""
    return rows.join(totals(rows, group, **what), [*group, NAME])
