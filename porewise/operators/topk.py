"""The first rows of each group, and seeded weighted samples of each group, without ordering whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, order: Sequence[Column], group: Sequence[str], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with their rank from 1.

    Each task keeps its own first ``k`` rows of a group before anything is shuffled (the limit on a row
    number does that), so a group's task sees ``k`` rows of each task, however large the group is. Rows that are
    equal in ``order`` are taken in any order; end it with a key to make ties definite. A null group is a group.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def chance(seed: int, *key: str) -> Column:
    """A number above 0 and up to 1 that the seed and the key decide, from 52 bits of a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def sample_k(rows: DataFrame, k: int, key: Sequence[str], group: Sequence[str], weight: str | Column | None = None, seed: int = 7) -> DataFrame:
    """``k`` rows of each group without replacement, chosen with chances in proportion to ``weight`` as they are drawn one by one.

    A row's place is -ln(u) / weight with u of the seed and the key; the ``k`` smallest are taken (``place`` is
    kept), of equal ones the smaller key. Rows with a weight that is null or not above 0 are never taken.
    """
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    placed = rows.withColumn("place", -F.log(chance(seed, *key)) / F.when(w > 0, w)).where("place is not null")
    return top_k(placed, k, [F.col("place"), *map(F.col, key)], group)
