"""Offsets of nearby positions in error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 14


def with_neighbour_errors(features: DataFrame, k: int = 2, threshold: float = 0.5, stretch: int = STRETCH) -> DataFrame:
    """Adds ``neighbour_error_pos``: signed distances of positions with mismatch_rate >= threshold, in order.

    A range window over each stretch of positions, in one pass over the rows: a row within ``k`` of a
    border is also sent to the next stretch, and counts there only as a neighbour. So a single long
    chromosome spreads over all tasks, and what the rows are computed from is computed once.
    """
    own = F.floor(F.col("site") / stretch)
    reach = F.array_distinct(F.array(own, F.floor((F.col("site") - k) / stretch), F.floor((F.col("site") + k) / stretch)))
    if k >= stretch:
        raise ValueError("a stretch must be longer than the reach")
    sent = features.withColumn("__stretch", F.explode(reach))
    around = Window.partitionBy("chr", "__stretch").orderBy("site").rangeBetween(-k, k)
    error, width = F.col("mismatch_rate") >= threshold, 2 * k + 1
    if width < 64:
        # no two positions within reach have the same remainder by the width, so a bit for each tells them apart
        near = F.bit_or(F.when(error, F.expr(f"shiftleft(1L, cast(pmod(site, {width}) as int))"))).over(around)
        held = lambda d: F.getbit(F.col("__near"), F.pmod(F.col("site") + d, F.lit(width)).cast("int")) == 1
        offsets = F.array_compact(F.array(*(F.when(held(d), F.lit(d)) for d in range(-k, k + 1) if d))) if k else F.array().cast("array<int>")
    else:
        near = F.collect_set(F.when(error, F.col("site"))).over(around)
        offsets = F.sort_array(F.transform(F.filter("__near", lambda s: s != F.col("site")), lambda s: (s - F.col("site")).cast("int")))
    return sent.withColumn("__near", near).withColumn("neighbour_error_pos", offsets).drop("__near").where(F.col("__stretch") == own).drop("__stretch")
