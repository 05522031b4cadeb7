"""Row filters of the feature table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conditions as c
from . import bed


def condition(chrom: str | None = None, site: str | None = None, n_reads: str | None = None, base: str | None = None, mismatched: bool = False, mismatch_types: str | None = None, mismatch_rate: str | None = None, mismatch_rate_alt: str | None = None, deletion_rate: str | None = None, insertion_rate: str | None = None, refskip_rate: str | None = None, motif: str | None = None, q_score: str | None = None, compat: bool = False) -> Column:
    """The conjunction of all conditions that are given."""
    tests: list[Column] = []
    if chrom is not None:
        tests.append(F.col("chr") == chrom)
    if site is not None:
        tests.append(c.sites(site))
    if n_reads is not None:
        tests.append(c.comparison("n_reads", n_reads, whole=True))
    if base is not None:
        tests.append(c.bases(base))
    if mismatched:
        tests.append(F.col("majority_base") != F.col("ref_base"))
    if mismatch_types is not None:
        tests.append(c.mismatch_types(mismatch_types, all_of=compat))
    rates = {"mismatch_rate": mismatch_rate, "mismatch_rate_alt": mismatch_rate_alt, "deletion_rate": deletion_rate, "insertion_rate": insertion_rate, "refskip_rate": refskip_rate, "q_mean": q_score}
    tests += [c.comparison(name, text) for name, text in rates.items() if text is not None]
    if motif is not None:
        tests.append(F.col("motif") == motif.upper())
    return reduce(and_, tests, F.lit(True))


def filter_features(features: DataFrame, filter_bed: DataFrame | None = None, exclude_bed: DataFrame | None = None, compat: bool = False, **conditions) -> DataFrame:
    """Rows that pass; an including interval set wins over an excluding one."""
    rows = features.where(condition(compat=compat, **conditions))
    if filter_bed is not None:
        return bed.include(rows, filter_bed, compat)
    return rows if exclude_bed is None else bed.exclude(rows, exclude_bed, compat)
