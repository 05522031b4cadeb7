"""The feature table: one row for each genomic position."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

BASES = ("A", "C", "G", "U")
COUNTS = ("n_a", "n_c", "n_g", "n_u", "n_del")
RATES = ("a_rate", "c_rate", "g_rate", "u_rate")
#: Names and order of the columns in the text format.
COLUMNS = (
    "chr site n_reads ref_base majority_base n_a n_c n_g n_u n_del n_ins n_ref_skip a_rate c_rate g_rate u_rate "
    "deletion_rate insertion_rate refskip_rate mismatch_rate mismatch_rate_alt motif q_mean q_std neighbour_error_pos"
).split()


def _kind(name: str):
    if name in ("chr", "ref_base", "majority_base", "motif"):
        return StringType()
    if name == "site":
        return LongType()
    if name == "neighbour_error_pos":
        return ArrayType(IntegerType())
    return IntegerType() if name.startswith("n_") else DoubleType()


FEATURES = StructType([StructField(name, _kind(name)) for name in COLUMNS])
