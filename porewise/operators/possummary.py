"""What all replicates of two samples show around given positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pileup import gapless_reads
from ..schema import BASES


def cube(intervals: DataFrame, a: list[DataFrame], b: list[DataFrame], label_a: str = "sample1", label_b: str = "sample2", k: int = 2) -> DataFrame:
    """A row for every position (the interval's last base), sample, replicate and offset; unknown values are null.

    Of repeated rows of one site in one replicate, the one with the most reads counts.
    """
    slots = [(s, r, f) for s, files in ((label_a, a), (label_b, b)) for r, f in enumerate(files)]
    near = intervals.select("chr", F.col("end").alias("position")).distinct().select("chr", "position", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("offset")).withColumn("site", F.col("position") + F.col("offset"))
    values = ["ref_base", "majority_base", "n_reads", "n_a", "n_c", "n_g", "n_u", "n_ins", "mismatch_rate", "deletion_rate", "insertion_rate", "refskip_rate", "a_rate", "c_rate", "g_rate", "u_rate"]
    tagged = [f.select("chr", "site", F.lit(i).alias("slot"), F.struct("n_reads", *(c for c in values if c != "n_reads")).alias("v")) for i, (_, _, f) in enumerate(slots)]
    # a site meets all that is known of it in one row, and is told apart by sample and replicate only then
    rows = reduce(DataFrame.unionAll, tagged).join(near.select("chr", "site").distinct(), ["chr", "site"], "left_semi").groupBy("chr", "site")
    rows = rows.agg(*(F.max(F.when(F.col("slot") == i, F.col("v"))).alias(f"v{i}") for i in range(len(slots))))
    each = F.array(*(F.struct(F.lit(s).alias("sample"), F.lit(r).alias("replicate"), F.col(f"v{i}").alias("v")) for i, (s, r, _) in enumerate(slots)))
    found = near.join(rows, ["chr", "site"], "left").select("chr", "position", "offset", "site", F.inline(each))
    return found.select("chr", "position", "sample", "replicate", "offset", "site", *(F.col(f"v.{c}").alias(c) for c in values))


def composition(rows: DataFrame) -> DataFrame:
    """Percent of each base among the bases read."""
    total = gapless_reads()
    return rows.withColumns({f"{b.lower()}_percent": F.round(F.try_divide(F.col(f"n_{b.lower()}").cast("double") * 100, total), 2) for b in BASES})


def errors(rows: DataFrame) -> DataFrame:
    """Match rate (that of the reference base) beside the error rates."""
    match = F.coalesce(*(F.when(F.col("ref_base") == b, F.col(f"{b.lower()}_rate")) for b in BASES))
    return rows.withColumn("match_rate", match)
