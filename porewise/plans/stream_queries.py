"""Queries of events and streams, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import variants
from ..sources.storage import new_folder
from ..streaming import neighbours, windows
from . import adapters as ad
from .queries import SQL
from .registry import query

_SESSIONS = """x as (select 1), o as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as begins from events where ts is not null),
  s as (select *, sum(begins) over (partition by user_id order by ts rows unbounded preceding) as session from o)
  select user_id, min(ts) as first, max(ts) as last, count(*) as events, round(sum(value), 6) as total from s group by user_id, session"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")


def _shown(found: DataFrame) -> DataFrame:
    times = [f.name for f in found.schema.fields if f.dataType.typeName() == "timestamp"]
    return found.withColumns({"total": F.round("total", 6), **{t: F.col(t).cast("timestamp_ntz") for t in times}})


@query(_SESSIONS)
def event_sessions(spark, sf_dir):
    """Sessions of each user, half an hour apart."""
    return _shown(windows.sessions(_events(spark, sf_dir)))


_WINDOWS = """x as (select 1), w as (select *, unnest([time_bucket(interval 15 minutes, ts) - i * interval 15 minutes for i in range(4)]) as start from events where ts is not null)
  select event_type, start, min(ts) as first, max(ts) as last, count(*) as events, round(sum(value), 6) as total from w group by event_type, start"""


@query(_WINDOWS)
def event_windows(spark, sf_dir):
    """Hours that begin every quarter, for each type of event."""
    return _shown(windows.sliding(_events(spark, sf_dir)))


def _arriving(rows: DataFrame, name: str, by: str, parts: int, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream ``of`` the rows writes that come in parts (``by``, 0 to parts - 1), each as many files as its tasks write.

    The stream runs after each part and goes on from its state at the next, so a part is never one task's.
    """
    spark, schema = rows.sparkSession, rows.drop(by).schema
    path, out = new_folder(spark, f"{name}-in"), new_folder(spark, name)
    for i in range(parts):
        rows.where(F.col(by) == i).drop(by).write.mode("append").parquet(path)
        found, _ = windows.write_to_end(of(spark.readStream.schema(schema).parquet(path)), name, out=out)
    return found


def _closed(events: DataFrame) -> DataFrame:
    """One event of nobody, long after all others, lets the watermark pass every window."""
    return events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))


def _events_arriving(spark: SparkSession, sf_dir: str, name: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events in three parts by time, and the closing one in a fourth."""
    events = _events(spark, sf_dir).where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    third = F.least(F.floor(F.try_divide((F.unix_micros("ts") - F.unix_micros("low")) * 3, F.unix_micros("high") - F.unix_micros("low"))), F.lit(2))
    dealt = events.join(F.broadcast(span)).withColumn("part", F.coalesce(third, F.lit(0))).drop("low", "high")
    return _arriving(dealt.union(_closed(events).withColumn("part", F.lit(3))), name, "part", 4, lambda s: of(windows.with_lateness(s, "10 minutes")))


@query(_SESSIONS)
def event_sessions_stream(spark, sf_dir):
    """The same sessions from a stream that nothing is late for."""
    return _shown(_events_arriving(spark, sf_dir, "sessions", windows.sessions).where("user_id is null or user_id <> -1"))


@query(_WINDOWS)
def event_windows_stream(spark, sf_dir):
    """The same windows from a stream."""
    return _shown(_events_arriving(spark, sf_dir, "windows", windows.sliding).where("event_type <> 'end'"))


@query(SQL["neighbour_errors"].split("from orders) ", 1)[1])
def neighbour_stream(spark, sf_dir):
    """Neighbours in error from a stream of rows in random order, some of them repeated, after all corrections."""
    rows = ad.features(spark, sf_dir).select("chr", "site", "mismatch_rate")
    part = F.pmod(F.xxhash64("chr", "site"), F.lit(3)).cast("int")
    again = rows.where("site % 5 = 0").withColumn("part", F.pmod(part + 1, F.lit(3)))
    dealt = rows.withColumn("part", part).union(again).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("part") * 60 + F.col("site") % 60))
    found = _arriving(dealt, "neighbours", "part", 3, neighbours.neighbour_updates)
    return neighbours.latest(found).select("chr", "site", F.array_join(F.col("neighbour_error_pos").cast("array<string>"), ",").alias("neighbour_error_pos"))


#: Properties as events might bring them: as they are, other types, nested ones, cut text, none.
_PROPS = """case event_id % 6 when 0 then props when 1 then concat('{"k": "', event_type, '"}') when 2 then substr(props, 1, 4)
  when 3 then concat('{"k": ', cast(user_id as varchar(20)), ', "more": {"a": [1, null]}, "on": true}') when 4 then concat('[', cast(user_id as varchar(20)), ']') end"""


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.stored(ad.table(spark, sf_dir, "events").select("event_type", F.expr(_PROPS).alias("text")), "text")


_KIND = "case json_type({x}) when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'null' end"


@query(
    f"""x as (select 1), t as (select {_PROPS} as text from events), g as (select text::json as j from t where json_valid(text)),
      k as (select '$.' || key as path, json_extract(j, '$.' || key) as v from (select j, unnest(json_keys(j)) as key from g where json_type(j) = 'OBJECT'))
      select '$' as path, {_KIND.format(x='j')} as kind, count(*) as n from g group by all union all select path, {_KIND.format(x='v')}, count(*) from k group by all"""
)
def event_paths(spark, sf_dir):
    """Paths and types in the properties of events."""
    return variants.path_kinds(_props(spark, sf_dir))


@query(
    f"""x as (select 1), t as (select event_type, {_PROPS} as text from events), g as (select *, json_valid(text) as ok, case when json_valid(text) then json_extract(text, '$.k') end as k from t)
      select event_type, count(*) filter (text is not null and not ok) as malformed, count(*) filter (json_type(k) = 'UBIGINT') as numbers, coalesce(sum(case when json_type(k) = 'UBIGINT' then k::bigint end), 0)::bigint as total, count(*) filter (json_type(k) = 'VARCHAR') as words from g group by event_type"""
)
def event_properties(spark, sf_dir):
    """Typed values of one path by type of event; malformed text is counted."""
    number, is_text = variants.typed("$.k", "bigint"), variants.kind_of(F.try_variant_get("v", "$.k", "variant")) == "text"
    rows = _props(spark, sf_dir).groupBy("event_type")
    return rows.agg(F.count(F.when(F.col("malformed"), 1)).alias("malformed"), F.count(number).alias("numbers"), F.coalesce(F.sum(number), F.lit(0)).alias("total"), F.count(F.when(is_text, 1)).alias("words"))
