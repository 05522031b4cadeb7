"""Datasets about labelled positions of interest, optionally against a counterpart base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RATES
from ..sources import text
from ..sources.storage import materialize
from . import bed, stats, summary
from .selection import quantiles

METRICS = ("mismatch_rate", "deletion_rate", "insertion_rate", "refskip_rate", "q_mean")


def categories(annotated: DataFrame, wanted: list[str], counterparts: list[str] | None = None) -> list[tuple[str, str | None]]:
    """The wanted categories with their counterparts; each must occur among the annotated rows."""
    if counterparts is not None and len(counterparts) != len(wanted):
        raise ValueError("as many counterparts as categories are needed")
    there = {r[0] for r in annotated.where(F.col("bed_name").isin(*wanted)).select("bed_name").distinct().collect()}
    if missing := set(wanted) - there:
        raise ValueError(f"no positions of {sorted(missing)}")
    return list(zip(wanted, counterparts or [None] * len(wanted), strict=True))


def groups(annotated: DataFrame, category: str, counterpart: str | None = None) -> DataFrame:
    """Rows of the category and of the counterpart base (the category's own sites included), with ``grp``.

    0 category match, 1 counterpart match, 2 category mismatch, 3 counterpart mismatch; without
    a counterpart 0 and 1 are match and mismatch. A gap is a mismatch.
    """
    match = F.col("ref_base") == F.col("majority_base")
    own = annotated.where(F.col("bed_name") == category).withColumn("grp", F.when(match, 0).otherwise(2 if counterpart else 1))
    if counterpart is None:
        return own
    return own.unionAll(annotated.where(F.col("ref_base") == counterpart).withColumn("grp", F.when(match, 1).otherwise(3)))


def sequence_map(category_rows: DataFrame, reference: DataFrame) -> DataFrame:
    return text.sequence_lengths(reference).join(category_rows.select("chr").distinct(), "chr", "left_semi")


def composition(grouped: DataFrame) -> DataFrame:
    """Exact median rate of each base in each group, and the four scaled to sum up to 1."""
    medians = quantiles(grouped, RATES, (0.5,), ["grp"]).withColumns({r: F.col(r)[0] for r in RATES})
    total = reduce(lambda x, y: x + y, (F.col(r) for r in RATES))
    return medians.withColumns({f"scaled_{r}": F.try_divide(F.col(r), total) for r in RATES})


def _columns_of(alt: bool) -> dict[str, str]:
    return {m: f"{m}_alt" if alt and m == "mismatch_rate" else m for m in METRICS}


def error_rates(grouped: DataFrame, alt: bool = False) -> DataFrame:
    """(grp, metric, value) in long form."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in _columns_of(alt).items()))).alias("p")
    return grouped.select("grp", pairs).select("grp", "p.metric", "p.value")


def neighbour_counts(category_rows: DataFrame) -> DataFrame:
    """(offset, is_poi, n): errors near the category's sites, and whether such a neighbour is itself one of them.

    The row with a null offset counts the sites without errors nearby.
    """
    sites = category_rows.select("chr", "site").distinct()
    near = category_rows.select("chr", "site", F.explode_outer("neighbour_error_pos").alias("offset"))
    other = sites.select("chr", F.col("site").alias("there"), F.lit(True).alias("poi"))
    marked = near.withColumn("there", F.col("site") + F.col("offset")).join(other, ["chr", "there"], "left")
    return marked.groupBy("offset", F.when(F.col("offset").isNotNull(), F.coalesce("poi", F.lit(False))).alias("is_poi")).agg(F.count("*").alias("n"))


def analyse(features: DataFrame, intervals: DataFrame, reference: DataFrame, wanted: list[str], counterparts: list[str] | None = None, alt: bool = False) -> dict[str, dict[str, DataFrame]]:
    """All datasets of each category. What they need of the rows of categories and counterparts is annotated once and kept in a table."""
    needed = dict.fromkeys(["chr", "site", "ref_base", "majority_base", *RATES, *_columns_of(alt).values(), "neighbour_error_pos"])
    used = F.col("bed_name").isin(*wanted) | F.col("ref_base").isin(*(counterparts or []))
    annotated = materialize(bed.annotate(features.select(*needed), intervals).where(used), "poi-annotated")
    out = {}
    for category, counterpart in categories(annotated, wanted, counterparts):
        own = annotated.where(F.col("bed_name") == category)
        grouped = groups(annotated, category, counterpart)
        rates = error_rates(grouped, alt)
        out[category] = {
            "map": sequence_map(own, reference),
            "confusion": summary.confusion(own, rows_of_gaps=True),
            "composition": composition(grouped),
            "error_rates": rates,
            "tests": stats.compare_groups(rates, counterpart is not None),
            "neighbours": neighbour_counts(own),
        }
    return out
