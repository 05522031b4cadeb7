"""Each operator over its whole table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, kneser_ney, langid, licenses, mixing, nearest, ngram_join, sharding, tiff, toxicity, warc, yinyang
from .common import fold, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 10) == 0
    model = kneser_ney.train(docs.where(~held_out))
    scored = kneser_ney.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    told = docs.select("doc_id", held_out.alias("held_out"), langid.identify(docs, model).alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as TIFF files and read back page by page."""
    unit = 576
    small_batches(spark, 250)
    docs = _table(spark, sf_dir, "documents")

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = b"" if pd.isna(t) else t.encode()
            out.append(tiff.encode(raw + b"\xff" * (-len(raw) % unit if raw else unit)))
        return pd.Series(out)

    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store("text").alias("media"))
    back = stored.select("doc_id", "n_bytes", "media", tiff.decode_payload(F.col("media")).alias("b"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("b.payload").cast("long").alias("payload_bytes"),
        F.sha2("b.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("b.payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("b.feature").alias("feature"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_bundles(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    read = warc.read_bundles(manifest)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "frame", "offset")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dealt = sharding.shuffle_into_shards(docs, 40)
    return dealt.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(sharding.SHARD).alias("shard"),
        F.col(sharding.SLOT).cast("long").alias("slot"),
        F.col(sharding.GROWN).alias("grown_shard"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_tiff_pages, op4_decontamination, op5_toxicity, op6_warc_bundles, op7_source_mixing, op8_license_scan, op9_sharding, op10_ngram_join, op11_hard_negatives, op12_nearest_neighbours, op13_centroid_clustering)}


#: Water-filling and the seeded border by window functions over whole tables.
OP7_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('11:' || coalesce(doc_id::varchar, '')) as h
  from documents),
placed as (
  select source, source_size, 3 * source_size as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as weight
  from (select source, sum(size)::bigint as source_size from sized group by source)),
filled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over w, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as water
  from placed
  window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
levelled as (
  select *, cap <= water * weight as clamped, first(water order by case when cap <= water * weight then 1 else 0 end, cap / weight, source nulls last) over () as unused
  from filled),
level as (select water from levelled where not clamped order by cap / weight, source nulls last limit 1),
targets as (
  select source, source_size, case when clamped then cap::double else (select water from level) * weight end as target from levelled),
goals as (
  select *, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as whole, floor(target + 0.5)::bigint as goal from targets),
ordered as (
  select s.doc_id, s.source, s.size, g.source_size, g.target, g.whole, g.goal - g.whole * g.source_size as rest,
         sum(s.size) over (partition by s.source, s.h) as words,
         sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) as upto
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, source, size, source_size, target,
       (whole * size + case when upto <= rest then size when upto - words < rest and words > 0 then size * (rest - (upto - words)) // words else 0 end)::bigint as taken
from ordered
"""


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

#: Every anchor against every row.
OP11_SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings where label is not null and {_FINITE}),
s as (
  select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i]))::bigint as score
  from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over w as rank, s.vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, s.vec_id) qualify row_number() over w <= 3
"""


def _clusters_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Plain rounds: all distances, then the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select rid, arg_min(c, (d, c)) as c, min(d) as d from (
    select rid, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.e[i] - c{i}.e[i]) * (v.e[i] - c{i}.e[i])))::bigint as d from v, c{i}) group by rid)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
  select c{i}.c, coalesce(m.e, c{i}.e) as e from c{i} left join (
    select c, list(case when t >= 0 then t // n else -((n - 1 - t) // n) end order by i)::bigint[] as e from (
      select c, i, sum(v.e[i]) as t, count(*) as n from a{i} join v using (rid), (select unnest(range(1, {dims + 1})) as i) group by c, i) group by c) m on m.c = c{i}.c)""")
    return f"""
with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e
  from embeddings where len(embedding) = {dims} and {_FINITE}),
c0 as materialized (
  select row_number() over (order by h, e) - 1 as c, e from (select sha256('3:' || coalesce(vec_id::varchar, '')) as h, e from v order by h, e limit {k})),
{", ".join(steps)}
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256
from a{rounds} a join v using (rid) join c{rounds} c on c.c = a.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_centroid_clustering": _clusters_sql()}
