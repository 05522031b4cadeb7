"""Positions that are systematically in error in one or both of two samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import text

ERROR_FEATURES = ("deletion_rate", "insertion_rate", "mismatch_rate", "mismatch_rate_alt")


def positions(a: list[DataFrame], b: list[DataFrame], label_a: str = "sample1", label_b: str = "sample2", error_feature: str = "mismatch_rate_alt", error_threshold: float = 0.5, coverage_threshold: int = 40) -> DataFrame:
    """(chr, site, name): shared positions, and those of one sample that the other covers; one shuffle.

    A position is covered or in error in a sample if it is so in all its replicates.
    """
    if error_feature not in ERROR_FEATURES:
        raise ValueError(f"not one of {ERROR_FEATURES}: {error_feature!r}")
    if max(len(a), len(b)) > 63:
        raise ValueError("more than 63 replicates of one sample")
    tagged = [f.select("chr", "site", (F.col("n_reads") - F.col("n_ref_skip")).alias("depth"), F.col(error_feature).alias("error"), F.lit(s).alias("sample"), F.lit(1 << r).cast("long").alias("rep")) for s, files in enumerate((a, b)) for r, f in enumerate(files)]
    # rep is a bit for each replicate, so that repeated rows of one replicate count once
    covered = reduce(DataFrame.unionAll, tagged).where(F.col("depth") >= coverage_threshold)
    in_error = F.col("error") >= error_threshold
    seen = lambda s, test: F.bit_count(F.coalesce(F.bit_or(F.when((F.col("sample") == s) & test, F.col("rep"))), F.lit(0)))
    state = covered.groupBy("chr", "site").agg((seen(0, F.lit(True)) == len(a)).alias("a_covered"), (seen(0, in_error) == len(a)).alias("a_error"), (seen(1, F.lit(True)) == len(b)).alias("b_covered"), (seen(1, in_error) == len(b)).alias("b_error"))
    name = F.when(F.col("a_error") & F.col("b_error"), f"{label_a}_{label_b}").when(F.col("a_error") & F.col("b_covered"), f"{label_a}_excl").when(F.col("b_error") & F.col("a_covered"), f"{label_b}_excl")
    return state.select("chr", "site", name.alias("name")).where("name is not null")


def as_bed(found: DataFrame) -> DataFrame:
    return found.select("chr", (F.col("site") - 1).alias("start"), F.col("site").alias("end"), "name")


def count_table(found: DataFrame) -> DataFrame:
    """Positions of each chromosome and name, with totals over chromosomes (chr null)."""
    return found.rollup("name", "chr").agg(F.count("*").alias("n")).where("name is not null")


def genome_map(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Lengths of the chromosomes that have positions."""
    return text.sequence_lengths(reference).join(found.select("chr").distinct(), "chr", "left_semi")
