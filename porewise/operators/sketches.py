"""Mergeable sketches of stretches of positions: quantiles and numbers of different values of any region, without its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import NAME, STRETCH, stretch_of

#: Of quantile sketches: values kept for each level, and the share of rows by which a rank may be wrong (99 % of the time).
KEPT, RANK_ERROR = 200, 0.0133
#: Of sketches of different values: registers as a power of two, and three standard errors of the estimate.
REGISTERS, COUNT_ERROR = 12, 3 * 1.04 / 2**6


def sketch(features: DataFrame, values: Sequence[str] = ("mismatch_rate", "q_mean"), distinct: str = "motif", size: int = STRETCH) -> DataFrame:
    """(chr, stretch, size, rows, a quantile sketch for each of ``values``, ``distinct``): to be stored, a few kB for each stretch.

    Partial sketches of a stretch are merged on the way, so a hot stretch costs no more than another. Null
    values are in no sketch; a stretch with nulls only has a null one. Rows without a site are left out.
    """
    rows = features.where("chr is not null and site is not null").withColumn(NAME, stretch_of("site", size))
    found = rows.groupBy("chr", NAME).agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(F.col(v).cast("double"), KEPT).alias(v) for v in values), F.hll_sketch_agg(distinct, REGISTERS).alias(distinct))
    return found.withColumnRenamed(NAME, "stretch").withColumn("size", F.lit(size))


def region_summary(sketches: DataFrame, regions: DataFrame, points: Sequence[float] = (0.25, 0.5, 0.75), values: Sequence[str] = ("mismatch_rate", "q_mean"), distinct: str = "motif") -> DataFrame:
    """(region, rows, quantiles of each of ``values``, number of different values) from stored sketches alone.

    A region (region, chr, start, end), 0-based and half-open, stands for the stretches that it meets as
    wholes. Regions may overlap and have several rows, also of different chromosomes; a stretch counts
    once in each. ``rows`` is exact; of the others the module states the errors. A region without rows is left out.
    """
    at = F.explode(F.sequence(F.floor((F.col("start") + 1) / F.col("size")), F.floor(F.col("end") / F.col("size")))).alias("stretch")
    size = sketches.agg(F.max("size").alias("size"))
    wanted = regions.where("end > start").join(F.broadcast(size)).where("size is not null").select("region", "chr", at).distinct()
    merged = wanted.join(sketches, ["chr", "stretch"]).groupBy("region").agg(F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(v).alias(v) for v in values), F.hll_union_agg(distinct).alias(distinct))
    array = F.array(*(F.lit(float(p)) for p in points))
    return merged.select("region", "rows", *(F.when(F.kll_sketch_get_n_double(v) > 0, F.kll_sketch_get_quantile_double(v, array)).alias(v) for v in values), F.hll_sketch_estimate(distinct).alias(distinct))
