"""Small columns that classify, label and order rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_class() -> Column:
    return F.when(F.col("ref_base") == F.col("majority_base"), "match").when(F.col("majority_base") == "-", "deletion").otherwise("mismatch")


def mismatch_label(ref: str = "ref_base", majority: str = "majority_base") -> Column:
    return F.concat_ws(" - ", F.col(ref), F.col(majority))


def centre_of_motif(motif: Column, width: int = 3) -> Column:
    """The middle ``width`` bases."""
    return F.substring(motif, (F.length(motif) / 2).cast("int") + 1 - width // 2, F.lit(width))


def chromosome_order(chromosome: str = "chr") -> list[Column]:
    """Numeric names first, by number; the others after them, by name."""
    number = F.when(F.col(chromosome).rlike("^[0-9]+$"), F.col(chromosome).cast("decimal(38,0)"))
    return [number.asc_nulls_last(), F.col(chromosome).asc()]


def decode_neighbours(text: Column) -> Column:
    """``"-2,1,"`` as an array of integers; null or empty text gives null, as does a part that is no number."""
    body = F.regexp_replace(text, ",$", "")
    return F.when(F.length(body) > 0, F.split(body, ",").try_cast("array<int>"))


def encode_neighbours(offsets: Column) -> Column:
    """The text form; an empty or null array gives empty text."""
    joined = F.array_join(offsets.cast("array<string>"), ",")
    return F.when(F.size(offsets) > 0, F.concat(joined, F.lit(","))).otherwise("")


def percent_of(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double") * 100, whole), 2)
