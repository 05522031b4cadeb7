"""Genomic tables made from the driver's sales tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pileup import gapless_reads, rate_columns
from ..schema import BASES

BASE_COUNTS = {
    "n_a": "sum(case when l_returnflag = 'A' then cast(l_quantity as bigint) else 0 end)",
    "n_c": "sum(case when l_returnflag = 'N' then cast(l_quantity as bigint) else 0 end)",
    "n_g": "sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end)",
    "n_u": "sum(case when l_linestatus = 'O' then cast(l_quantity as bigint) else 0 end)",
    "n_del": "sum(cast(round(l_tax * 100) as bigint))",
    "n_ref_skip": "sum(cast(round(l_discount * 100) as bigint))",
    "n_ins": "count(*)",
}
REF_BASE = "substring('ACGU', cast((l_orderkey * 7 + l_linenumber) % 4 as int) + 1, 1)"
MOTIF = "substring('ACGUNACGUUCAGGACU', cast(l_orderkey % 13 as int) + 1, 5)"
BED = "select concat('chr', cast(o_custkey % 7 + 1 as varchar(4))) as chr, o_orderkey - 1 as start, o_orderkey + o_custkey % 3 as \"end\", o_orderpriority as name, o_custkey, o_orderkey from orders"
BASES_TEXT = (
    "concat('^]', repeat('.', cast(l_quantity as int)), repeat('a', cast(round(l_discount * 100) as int)), '+2ag', repeat(',', l_linenumber), '-3ttt', "
    "repeat('*', cast(round(l_tax * 100) as int)), case when l_returnflag = 'R' then '>>' else '' end, '$')"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str, sample: int | None = None, replicate: int | None = None, stretch: int | None = None) -> DataFrame:
    """A feature table with one row for each (chr, site); of one replicate of a sample, if asked for.

    With ``stretch`` its rows come as ``binning.placed`` gives them: lines are brought together by so many sites
    and added up where they lie, in one shuffle.
    """
    lines = table(spark, sf_dir, "lineitem")
    if sample is not None:
        lines = lines.where(F.col("l_suppkey") % 4 == 2 * sample + replicate)
    keys = [F.expr("concat('chr', cast(l_linenumber as string))").alias("chr"), F.col("l_orderkey").alias("site"), F.expr(REF_BASE).alias("ref_base"), F.expr(MOTIF).alias("motif")]
    counts = [F.expr(e).alias(n) for n, e in BASE_COUNTS.items()]
    if stretch is None:
        rows = lines.groupBy(*keys).agg(*counts)
    else:  # the other keys follow from l_orderkey and l_linenumber
        lines = lines.withColumn("stretch", F.floor(F.col("l_orderkey") / stretch)).repartition("l_linenumber", "stretch")
        rows = lines.groupBy("l_linenumber", "stretch", "l_orderkey").agg(*counts).select(*keys, "stretch", *BASE_COUNTS)
    rows = rows.withColumn("n_reads", gapless_reads() + F.col("n_del") + F.col("n_ref_skip"))
    return rows.withColumns(rate_columns()).withColumn("q_mean", (F.col("site") % 40).cast("double"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr("concat('chr', cast(o_custkey % 7 + 1 as string))").alias("chr"), (F.col("o_orderkey") - 1).alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("end"), F.col("o_orderpriority").alias("name"), "o_custkey", F.col("o_orderkey").alias("line"))
    return rows.withColumn("extras", F.array("name", F.col("o_custkey").cast("string"))).withColumn("file", F.lit(0))


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pileup row for each line item (sites repeat)."""
    n = F.expr("cast(l_quantity as int)")
    return table(spark, sf_dir, "lineitem").select(
        F.expr("concat('chr', cast(l_linenumber as string))").alias("chr"),
        F.col("l_orderkey").alias("site"),
        F.expr(REF_BASE).alias("ref_base"),
        (n + F.col("l_linenumber")).alias("n_reads"),
        F.expr(BASES_TEXT).alias("bases"),
        F.concat(F.expr("repeat('I', cast(l_quantity as int))"), F.expr("repeat('5', l_linenumber)")).alias("qualities"),
    )


# ------------------------------------------------------------------ the same as SQL


def features_sql(where: str = "true") -> str:
    """A select that yields the feature table; stands in a ``with`` clause."""
    counts = ", ".join(f"{e} as {n}" for n, e in BASE_COUNTS.items())
    rate = lambda n, total: f"(case when {total} = 0 then 0.0 else {n}::double / {total} end)"
    mismatch = lambda total: "(0.0 + " + " + ".join(f"(case when ref_base = '{b}' then 0.0 else {rate(f'n_{b.lower()}', total)} end)" for b in BASES) + ")"
    gapless = "(n_a + n_c + n_g + n_u)"
    rates = ", ".join(f"{rate(n, 'n_reads')} as {r}" for r, n in [(f"{b.lower()}_rate", f"n_{b.lower()}") for b in BASES] + [("deletion_rate", "n_del"), ("insertion_rate", "n_ins"), ("refskip_rate", "n_ref_skip")])
    return f"""(select *, {rates}, {mismatch("n_reads")} as mismatch_rate, {mismatch(gapless)} as mismatch_rate_alt,
        case when n_a >= n_c and n_a >= n_g and n_a >= n_u and n_a >= n_del then 'A' when n_c >= n_g and n_c >= n_u and n_c >= n_del then 'C'
             when n_g >= n_u and n_g >= n_del then 'G' when n_u >= n_del then 'U' else '-' end as majority_base, (site % 40)::double as q_mean
      from (select *, {gapless} + n_del + n_ref_skip as n_reads from (
        select concat('chr', cast(l_linenumber as varchar(4))) as chr, l_orderkey as site, {REF_BASE} as ref_base, {MOTIF} as motif, {counts}
        from lineitem where {where} group by all)))"""
