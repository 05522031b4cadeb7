"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records by seeded hashes into buckets that fit in memory: a shard is chosen
by the record's key (the shard with the largest hash of key and shard number, so that one more
shard takes records only into itself), a bucket inside the shard by the whole record. Pass two
gathers each bucket and applies a seeded Fisher-Yates shuffle (Spark's ``shuffle``); the
position, counted on over the buckets of a shard, is the record's slot.

A null text counts no bytes. Records with a null key share a shard but spread over its
buckets. Equal rows share a bucket until they fill a quarter of one; beyond that they are
counted before the shuffle and dealt to all buckets of their shard in turn (not where a column
is a map, since rows with maps cannot be compared). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..sources.storage import materialize

SHARD, SLOT, GROWN = "__shard", "__slot", "__grown"


def _weights(key: Column, shards: Column, seed: int) -> Column:
    return F.transform(shards, lambda j: F.struct(F.xxhash64(key, j, F.lit(seed)).alias("w"), j.alias("shard")))


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """Rendezvous hashing: key and shard count decide."""
    return F.array_max(_weights(key, F.sequence(F.lit(0), F.lit(n_shards - 1)), seed))["shard"]


def _sortable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return _sortable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


def shuffle_into_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20, seed: int = 17, most_broadcast: int = 1_000_000, most_partitions: int = 20_000) -> DataFrame:
    """All columns of ``docs`` with ``__shard``, ``__slot`` and ``__grown`` (the shard if there were one more)."""
    key, size = F.col(id_col), F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16
    top = F.array_max(_weights(key, F.sequence(F.lit(0), F.lit(n_shards - 1)), seed))
    newcomer = F.struct(F.xxhash64(key, F.lit(n_shards), F.lit(seed)).alias("w"), F.lit(n_shards).alias("shard"))
    comparable = [F.col(f"`{f.name}`") for f in docs.schema.fields if _sortable(f.dataType)]
    placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), size.alias("bytes"), top.alias("top"), F.greatest(top, newcomer)["shard"].alias(GROWN), F.xxhash64(*comparable, F.lit(seed + 1)).alias("mark"))
    placed = placed.select("record", "bytes", "mark", F.col("top.shard").alias(SHARD), GROWN)
    # pass one: bytes of each shard decide how many buckets it has
    marks = materialize(placed.groupBy(SHARD, "mark").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-marks")
    loads = {r[SHARD]: r["bytes"] for r in marks.groupBy(SHARD).agg(F.sum("bytes").alias("bytes")).collect()}
    buckets = [max(1, -(-loads.get(s, 0) // bucket_bytes)) for s in range(n_shards)]
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col(SHARD) + 1)
    whole = _sortable(docs.schema)
    hot = marks.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 4) & F.lit(whole)).select("mark", "n", SHARD)
    n_hot = hot.count()
    bucket = lambda copy: F.pmod(F.col("mark") + copy, of_shard(buckets)).cast("int").alias("bucket")
    if n_hot:
        known = hot.select("mark").distinct()
        known = F.broadcast(known) if n_hot <= most_broadcast else known
        copies = placed.join(known, "mark", "left_semi").groupBy("record", "mark", SHARD, GROWN).agg(F.count("*").alias("n"))
        dealt = copies.select("record", "mark", SHARD, GROWN, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
        placed = placed.join(known, "mark", "left_anti").select("record", "mark", SHARD, GROWN, bucket(0)).unionByName(dealt.select("record", "mark", SHARD, GROWN, bucket(F.col("copy"))))
        turns = hot.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), of_shard(buckets)) - 1)))
        filled = turns.select(SHARD, bucket(F.col("copy")), (F.floor((F.col("n") - F.col("copy") - 1) / of_shard(buckets)) + 1).alias("n"))
        filled = marks.join(known, "mark", "left_anti").select(SHARD, bucket(0), "n").union(filled)
    else:
        placed, filled = placed.select("record", "mark", SHARD, GROWN, bucket(0)), marks.select(SHARD, bucket(0), "n")
    counts = filled.groupBy(SHARD, "bucket").agg(F.sum("n").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.partitionBy(SHARD).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select(SHARD, "bucket", begin.alias("begin"))
    if sum(buckets) <= most_broadcast:
        begins = F.broadcast(begins)
    # pass two: buckets are gathered, put in a fixed order, shuffled and dealt out; Spark seeds its shuffle by
    # partition, so buckets are numbered on to partitions and sorted there, which makes any rerun agree
    before = [sum(buckets[:s]) for s in range(n_shards)]
    partitions = min(sum(buckets), most_partitions)
    placed = placed.withColumn("part", ((of_shard(before) + F.col("bucket")) % partitions).cast("int")).repartitionById(partitions, "part")
    gathered = F.collect_list(F.struct("mark", "record", GROWN))
    if whole:
        gathered = F.sort_array(gathered)
    else:
        gathered = F.array_sort(gathered, lambda x, y: F.when(x["mark"] < y["mark"], -1).when(x["mark"] > y["mark"], 1).otherwise(0))
    full = placed.groupBy("part", SHARD, "bucket").agg(gathered.alias("rows")).sortWithinPartitions(SHARD, "bucket")
    full = full.select(SHARD, "bucket", F.shuffle("rows", seed).alias("rows")).join(begins, [SHARD, "bucket"])
    dealt = full.select(SHARD, "begin", F.posexplode("rows").alias("place", "row"))
    return dealt.select("row.record.*", SHARD, (F.col("begin") + F.col("place")).alias(SLOT), F.col(f"row.{GROWN}").alias(GROWN))


def write_shards(docs: DataFrame, path: str, n_shards: int, **how) -> None:
    """Write the shuffled records, a folder for each shard, each file holding whole buckets in slot order."""
    shuffle_into_shards(docs, n_shards, **how).drop(GROWN).write.partitionBy(SHARD).parquet(path)
