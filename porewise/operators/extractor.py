"""From pileup rows to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pileup
from ..schema import COLUMNS
from ..sources.text import reference_chunks, sequence_lengths
from .neighbours import with_neighbour_errors

#: Bases of a piece of the reference, few since a text is walked from its start to cut a motif out; and what it holds beyond.
CHUNK, HALO = 1 << 9, 2


def decode(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Counts, rates, majority base and quality of pileup rows (chr, site, ref_base, n_reads, bases, qualities).

    The results are attributes of a generator's row, so a later condition on one of them reads it. Over plain
    columns Spark would push the condition down and decode each row again for each use of a count in it.
    """
    rows = rows.withColumn("__x", pileup.without_starts(F.coalesce("bases", F.lit("")))).withColumn("__core", pileup.without_indels(F.col("__x")))
    rows = rows.withColumns(pileup.base_counts(F.col("__x"), F.col("__core"), F.col("ref_base")))
    plain = pileup.kept_scores(F.col("__core"), F.col("qualities"))
    scores = F.when(F.col("ends_with_qualities"), pileup.kept_scores(F.col("__core"), F.col("qualities"), True)).otherwise(plain) if compat else plain
    rows = rows.withColumns(pileup.rate_columns()).withColumn("__scores", scores).withColumns(pileup.mean_and_std(F.col("__scores")))
    rows = rows.drop("__x", "__core", "__scores", "bases", "qualities", "ends_with_qualities")
    return rows.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))


def with_motif(rows: DataFrame, reference: DataFrame, most_broadcast: int = 64 << 20, most_names: int = 100_000) -> DataFrame:
    """Adds the 2k+1 bases around each site; rows of unknown chromosomes go, sites out of range get ''.

    The reference meets the rows in pieces, so a long chromosome is neither sent nor scanned whole.
    """
    pieces, names = reference_chunks(reference, CHUNK, HALO), sequence_lengths(reference)
    size = names.agg(F.count("*").alias("names"), F.sum("length").alias("bases")).first()
    if size["names"] <= most_names:  # one short row for each chromosome
        names = F.broadcast(names)
    if (size["bases"] or 0) <= most_broadcast:
        pieces = F.broadcast(pieces)
    known = rows.join(names, "chr").withColumn("chunk", F.floor((F.col("site") - 1) / CHUNK))
    near = known.join(pieces.drop("length"), ["chr", "chunk"], "left")
    inside = F.col("site").between(1, F.col("length"))
    motif = F.substring("piece", ((F.col("site") - 1) % CHUNK + 1).cast("int"), F.lit(2 * HALO + 1))
    return near.withColumn("motif", F.when(inside, pileup.to_rna(motif)).otherwise("")).drop("chunk", "piece", "length")


def extract(
    rows: DataFrame,
    reference: DataFrame,
    num_reads: int = 1,
    mean_quality: float | None = None,
    perc_deletion: float | None = None,
    mismatch_rate: float | None = None,
    mismatch_rate_alt: float | None = None,
    region: Column | None = None,
    window_size: int = 2,
    neighbour_thresh: float = 0.5,
    compat: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The feature table, with further columns to ``keep``. Cheap conditions come before decoding; the decoded rows are filtered once."""
    early = F.col("n_reads") >= num_reads
    rows = rows.where(early if region is None else early & region)
    decoded = decode(with_motif(rows, reference), compat)
    late = [F.col(c) >= v for c, v in (("q_mean", mean_quality), ("deletion_rate", perc_deletion), ("mismatch_rate", mismatch_rate), ("mismatch_rate_alt", mismatch_rate_alt)) if v is not None]
    for condition in late:
        decoded = decoded.where(condition)
    return with_neighbour_errors(decoded, window_size, neighbour_thresh).select(*COLUMNS, *keep)
