"""Datasets that summarise one feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import centre_of_motif, match_class, mismatch_label, percent_of
from ..schema import BASES
from ..sources.storage import materialize
from . import binning
from .binning import bin_means

SYMBOLS = (*BASES, "-")
BINS = 5000


def error_rates(alt: bool = False) -> list[str]:
    return ["mismatch_rate_alt" if alt else "mismatch_rate", "deletion_rate", "insertion_rate", "refskip_rate"]


def totals(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("positions"), F.countDistinct("chr").alias("chromosomes"))


def general(features: DataFrame, bins: int = BINS) -> DataFrame:
    return bin_means(features, ["n_reads", "q_mean"], bins)


def by_chromosome(features: DataFrame, bins: int = BINS) -> DataFrame:
    return bin_means(features, ["n_reads", "q_mean"], bins, ["chr"])


def chromosome_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("chr").agg(F.count("*").alias("positions"))


def class_counts(features: DataFrame) -> DataFrame:
    return features.groupBy(match_class().alias("class")).agg(F.count("*").alias("positions"))


def by_class(features: DataFrame, bins: int = BINS, alt: bool = False) -> DataFrame:
    return bin_means(features.withColumn("class", match_class()), error_rates(alt), bins, ["class"])


def _grid(features: DataFrame, refs: tuple[str, ...]) -> DataFrame:
    one = features.sparkSession.range(1)
    rows = one.select(F.explode(F.array(*map(F.lit, refs))).alias("ref_base"))
    return rows.select("ref_base", F.explode(F.array(*map(F.lit, SYMBOLS))).alias("majority_base"))


def _pairs(features: DataFrame) -> DataFrame:
    return features.groupBy("ref_base", "majority_base").agg(F.count("*").alias("n"))


def confusion(features: DataFrame, rows_of_gaps: bool = False) -> DataFrame:
    """All pairs of reference and majority base, with their share of the pairs that differ.

    Pairs with a gap as reference count only with ``rows_of_gaps``; other symbols are left out.
    """
    return _confusion(_pairs(features), rows_of_gaps)


def _confusion(pairs: DataFrame, rows_of_gaps: bool = False) -> DataFrame:
    known = F.col("ref_base").isin(*(SYMBOLS if rows_of_gaps else BASES)) & F.col("majority_base").isin(*SYMBOLS)
    counts = pairs.where(known)
    full = F.broadcast(_grid(pairs, SYMBOLS)).join(counts, ["ref_base", "majority_base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off = F.col("ref_base") != F.col("majority_base")
    total = F.sum(F.when(off, F.col("n"))).over(Window.partitionBy())  # over the 25 cells
    return full.select("ref_base", "majority_base", "n", F.when((F.col("n") > 0) & off, percent_of(F.col("n"), total)).alias("percent"))


def _differing() -> Column:
    return (F.col("ref_base") != F.col("majority_base")) & F.col("ref_base").isin(*BASES) & F.col("majority_base").isin(*SYMBOLS)


def mismatch_counts(features: DataFrame) -> DataFrame:
    """The 16 kinds of mismatch, those without positions included."""
    return _mismatch_counts(_pairs(features))


def _mismatch_counts(pairs: DataFrame) -> DataFrame:
    counts = pairs.where(_differing())
    kinds = F.broadcast(_grid(pairs, BASES).where("ref_base <> majority_base"))
    full = kinds.join(counts, ["ref_base", "majority_base"], "left")
    return full.select(mismatch_label().alias("mismatch"), F.coalesce("n", F.lit(0)).alias("n"))


def by_mismatch(features: DataFrame, bins: int = BINS, alt: bool = False) -> DataFrame:
    rows = features.where(_differing()).withColumn("mismatch", mismatch_label())
    return bin_means(rows, error_rates(alt), bins, ["mismatch"])


def by_motif(features: DataFrame, bins: int = BINS, alt: bool = False) -> DataFrame:
    """By the three bases in the middle; motifs with N in the centre are left out."""
    rows = features.withColumn("motif3", centre_of_motif(F.col("motif"))).where(F.substring("motif3", 2, 1).isin(*BASES))
    return bin_means(rows, error_rates(alt), bins, ["motif3"]).withColumn("centre", F.substring("motif3", 2, 1))


#: What ``counts`` counts by, and the number that tells a row's grouping: a bit for each column that it does not tell apart.
GROUPINGS = {"all": (), "chr": ("chr",), "class": ("class",), "pair": ("ref_base", "majority_base")}
LEVELS = {"all": 15, "chr": 7, "class": 11, "pair": 12}


def counts(rows: DataFrame) -> DataFrame:
    """(level, chr, class, ref_base, majority_base, n): rows of every grouping that datasets count, in one aggregation."""
    columns = ("chr", "class", "ref_base", "majority_base")
    each = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return each.groupingSets([list(g) for g in GROUPINGS.values()], *columns).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))


def _of_groupings(rows: DataFrame, *columns: str) -> DataFrame:
    """A row (dataset, key, columns) for each binned grouping that a row has a key of."""
    of = lambda name, key: F.struct(F.lit(name).alias("dataset"), key.alias("key"))
    mismatch = F.when(_differing(), mismatch_label())
    groups = F.array(of("general", F.lit("")), of("by_chromosome", F.col("chr")), of("by_class", F.col("class")), of("by_mismatch", mismatch), of("by_motif", F.when(F.substring("motif3", 2, 1).isin(*BASES), F.col("motif3"))))
    return rows.select(*columns, F.explode(groups).alias("g")).select("g.*", *columns).where("key is not null")


def binned(rows: DataFrame, bins: int = BINS, alt: bool = False) -> DataFrame:
    """(dataset, key, bin, means): the bins of every grouping; a row counts in each grouping that it has a key of.

    Rows come as ``placed``, from a written table. They are added up by stretch and all that groupings tell
    apart, and only these sums are sent to every grouping; rows themselves only where a bin of any grouping ends
    in their stretch, so beyond some size no more of them, however many there are.
    """
    rows, values, group = rows.where(binning.PLACED), ["n_reads", "q_mean", *error_rates(alt)], ["dataset", "key"]
    finest = rows.groupBy("chr", "stretch", "class", "ref_base", "majority_base", "motif3").agg(*binning.amounts(values))
    sums = [c for c in finest.columns if c == "n" or c.startswith(("sum_", "count_"))]
    stretches = _of_groupings(finest, "chr", "stretch", *sums).groupBy(*group, "chr", "stretch").agg(*binning.added(values))
    stretches = materialize(binning.in_bins(stretches, bins, group), "summary-stretches")
    border = materialize(stretches.where("bin < last").select(*group, "chr", "stretch", "begin", "total"), "summary-borders")  # its size tells whether all tasks may have it
    near = rows.join(border.select("chr", "stretch"), ["chr", "stretch"], "left_semi")
    return binning.means(stretches, border, _of_groupings(near, "chr", "stretch", "site", *values), values, bins, group)


def summarise(features: DataFrame, bins: int = BINS, alt: bool = False) -> dict[str, DataFrame]:
    """All datasets by name, from one scan of the features.

    What the datasets need of a row is written once, stretch by stretch; from there one aggregation by
    grouping sets makes all that is counted, and sums of stretches nearly all that is binned. Features may
    have the column ``stretch`` of ``binning.placed``; they are not shuffled then.
    """
    rates = error_rates(alt)
    lying = [c for c in features.columns if c == "stretch"]
    rows = features.select("chr", "site", *lying, "n_reads", "q_mean", *rates, "ref_base", "majority_base", match_class().alias("class"), centre_of_motif(F.col("motif")).alias("motif3"))
    rows = materialize(binning.placed(rows), "summary-rows")
    level = lambda name: counted.where(F.col("level") == LEVELS[name])
    counted = materialize(counts(rows), "summary-counts")
    bins_of = materialize(binned(rows, bins, alt), "summary-bins")
    part = lambda name, key, values: bins_of.where(F.col("dataset") == name).select(*([F.col("key").alias(key)] if key else []), "bin", *values)
    totals_ = counted.agg(F.coalesce(F.sum(F.when(F.col("level") == LEVELS["all"], F.col("n"))), F.lit(0)).alias("positions"), F.count(F.when(F.col("level") == LEVELS["chr"], F.col("chr"))).alias("chromosomes"))
    return {
        "totals": totals_,
        "general": part("general", None, ["n_reads", "q_mean"]),
        "chromosome_counts": level("chr").select("chr", F.col("n").alias("positions")),
        "by_chromosome": part("by_chromosome", "chr", ["n_reads", "q_mean"]),
        "class_counts": level("class").select("class", F.col("n").alias("positions")),
        "by_class": part("by_class", "class", rates),
        "confusion": _confusion(level("pair")),
        "mismatch_counts": _mismatch_counts(level("pair")),
        "by_mismatch": part("by_mismatch", "mismatch", rates),
        "by_motif": part("by_motif", "motif3", rates).withColumn("centre", F.substring("motif3", 2, 1)),
    }
