"""A corpus pipeline: stages over the documents table, each written and read by the next one.

The first four stages return the columns of documents; each keeps only what it decides to keep. Further
columns pass all stages whatever they are called. Nulls in any column, repeated rows and empty tables
pass too: a null text is an empty one, which is not toxic, has no copies, holds no test item and is never
taken by the mix, since it has no words; a null doc_id is an identifier like any other, the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porewise.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from porewise.llm.common import fold, materialize

N_SHARDS = 40


def _neutral(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with columns c0, c1, ... whatever their names are, and what doc_id and text are called there."""
    name = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*name.values()), name["doc_id"], name["text"]


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores after it until no column of the documents has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the classifier learns as in its own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = fold("doc_id", 5) != 0
    model = toxicity.train(docs.where(learned), labels.where(learned))
    return docs.where(toxicity.toxicity(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows, one with the smallest doc_id (a null is the largest) stays, once; unlinked ones all stay.

    Rows are told apart by a number of their own, since a doc_id may be null or repeated.
    """
    rows, doc_id, text = _neutral(docs)
    keyed = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    found = ngram_join.jaccard_components(keyed, "row", text)
    linked = materialize(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("row"), "component_id"), "pipeline-linked")
    few = linked.count() <= 500_000
    # a component's own number is one of its rows, which is not in ``linked``; it comes along with each other row
    members = linked.select(F.inline(F.array(F.struct("row", "component_id"), F.struct(F.col("component_id").alias("row"), "component_id"))))
    named = keyed.select(F.col(doc_id).alias("id"), "row").join(F.broadcast(members) if few else members, "row")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row"))["row"].alias("stays"))
    gone = members.join(stays, "component_id").where(F.col("row") != F.col("stays")).select("row").distinct()
    gone = materialize(gone, "pipeline-copies")
    gone = F.broadcast(gone) if few else gone
    return keyed.join(gone, "row", "left_anti").select(*rows.columns).toDF(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or one within its budget of edits, go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` and ``slot``; where a document has such a column, the new one has underscores after its name."""
    rows, doc_id, text = _neutral(docs)
    dealt = sharding.shuffle_into_shards(rows, N_SHARDS, doc_id, text)
    found = dealt.select(*rows.columns, sharding.SHARD, sharding.SLOT)
    return found.toDF(*docs.columns, _free("shard", docs), _free("slot", docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained classifier and edit distances can't be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
