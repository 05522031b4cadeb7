"""Equal-count bins of ordered rows, without sorting any group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import quantiles


#: Rows without chr or site are in no order, so in no bin.
PLACED = "chr is not null and site is not null"
#: Positions of a stretch, whose rows are numbered in one task.
STRETCH = 4096


def placed(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds ``stretch`` and brings its rows together; it is null for a row without a place. Rows that have it lie so already."""
    return rows if "stretch" in rows.columns else rows.withColumn("stretch", F.floor(F.col("site") / stretch)).repartition("chr", "stretch")


def amounts(values: Sequence[str]) -> list[Column]:
    """How many rows, and what their values add up to."""
    return [F.count("*").alias("n"), *(a for v in values for a in (F.sum(F.col(v).cast("double")).alias(f"sum_{v}"), F.count(v).alias(f"count_{v}")))]


def added(values: Sequence[str]) -> list[Column]:
    """The same from ``amounts`` of parts."""
    return [F.sum(c).alias(c) for c in ("n", *(f"{of}_{v}" for v in values for of in ("sum", "count")))]


def _bin(idx: Column, total: Column, bins: int) -> Column:
    size, longer = F.floor(total / bins), total % bins
    long_part = longer * (size + 1)
    later = longer + F.floor(F.try_divide(idx - long_part, size))
    return F.when(total <= bins, idx).when(idx < long_part, F.floor(idx / (size + 1))).otherwise(later)


def in_bins(stretches: DataFrame, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Adds to the ``amounts`` of (group, chr, stretch) the numbers of rows ``begin`` before it and in ``total``, its first ``bin`` and its ``last``.

    Only counts of stretches meet in one task, in the order of chr and stretch within the group.
    """
    before = Window.partitionBy(*group).orderBy("chr", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    found = stretches.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    return found.withColumn("bin", _bin(F.col("begin"), F.col("total"), bins)).withColumn("last", _bin(F.col("begin") + F.col("n") - 1, F.col("total"), bins))


def means(stretches: DataFrame, border: DataFrame, rows: DataFrame, values: Sequence[str], bins: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, bin, mean of each value) from stretches ``in_bins``, those of them in which a bin ends (``border``), and the rows.

    A stretch within one bin counts as it is. Only rows of the others are numbered, by site; there is one
    such stretch at most for each end of a bin, however many rows there are.
    """
    keys = list(dict.fromkeys([*group, "chr", "stretch"]))
    cut = rows.select(*keys, "site", *values).join(border.select(*keys, "begin", "total"), keys)
    idx = F.col("begin") + F.row_number().over(Window.partitionBy(*keys).orderBy("site")) - 1
    numbered = cut.withColumn("bin", _bin(idx, F.col("total"), bins)).groupBy(*group, "bin").agg(*amounts(values))
    whole = stretches.where("bin = last").groupBy(*group, "bin").agg(*added(values))
    both = whole.unionByName(numbered).groupBy(*group, "bin").agg(*added(values))
    return both.select(*group, "bin", *(F.try_divide(F.col(f"sum_{v}"), F.col(f"count_{v}")).alias(v) for v in values))


def bin_means(rows: DataFrame, values: Sequence[str], bins: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, bin, mean of each value): ``bins`` segments in the order of chr and site, the first ones longer by one; fewer rows stay as they are."""
    rows = placed(rows.select("chr", "site", *(c for c in (*group, *values) if c not in ("chr", "site"))).where(PLACED))
    keys = dict.fromkeys([*group, "chr", "stretch"])
    stretches = in_bins(rows.groupBy(*keys).agg(*amounts(values)), bins, group)
    return means(stretches, stretches.where("bin < last"), rows, values, bins, group)


def box(rows: DataFrame, values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles and maximum of each value, exact."""
    return quantiles(rows, values, (0.0, 0.25, 0.5, 0.75, 1.0), group).drop("n")
