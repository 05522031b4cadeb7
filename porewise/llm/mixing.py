"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, but at most ``max_epochs`` times what it
has; what a clamped source cannot take is shared again by weight until no source is above its
limit. With sources in the order of limit over weight this is one pass: a source is clamped
while its limit is below its share of what the clamped ones before it left.

A target of e epochs takes every document floor(e) times and then documents in a seeded order
until the words of the fractional epoch are reached; the one document on that border gives
only the words that are left. The border is found by summing ever finer ranges of the seeded
hash, so no source is ever sorted or gathered in one task.

A null text has no words; a null source is a source of its own, last in order; sources without
words have target 0. Rows with equal identifiers and source share the border's words in
proportion. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that one more pass resolves.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Adds ``target``: words that each source (``key``, ``source``, ``source_size``) gives."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = sources.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("limit", F.lit(max_epochs) * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.floor(F.lit(float(share)) * F.sum("source_size").over(everything)) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.greatest(left, F.lit(0)) / weight_left)
    # clamped sources come first; the first that isn't sets the level of all after it
    rows = rows.withColumn("clamped", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("clamped"), F.struct(-F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    return rows.withColumn("target", F.when(F.col("clamped"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))).select("key", "source_size", "target")


def _border(rows: DataFrame, cut: DataFrame, digits: int | None, hint) -> DataFrame:
    """The range of hashes in which each source's fractional epoch ends, and the words before that range."""
    part = F.substring("h", 1, digits) if digits else F.col("h")
    at_border = rows.join(hint(cut), "key").where(F.col("h").startswith(F.col("border")))
    sums = at_border.groupBy("key", part.alias("part"), "rest", "before").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).select("key", "rest", (F.col("upto") - F.col("words")).alias("before"), F.col("part").alias("border"), "words")


def _plan(docs: DataFrame, id_col: str, text: str, source: str, weights: tuple[float, ...], share: float, max_epochs: int, seed: int, most_broadcast: int) -> tuple[DataFrame, DataFrame, dict[str, Column], Column]:
    """Each source's target and border (a table by ``key``), and how rows that are joined with it are taken.

    The second value has a row (id, key, source, size, h) for each document, the third these columns
    but the first for rows of ``docs``; the fourth is the words taken, after the join.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    own = {"key": key, "source": F.col(source).cast("string"), "size": word_count(F.col(text)), "h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))}
    rows = materialize(docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in own.items())), "mix-sizes")
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    plan = materialize(water_fill(sources, weights, share, max_epochs), "mix-targets")
    small = plan.count() <= most_broadcast
    hint = lambda df: F.broadcast(df) if small else df
    goal = F.floor(F.col("target") + 0.5)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)).withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    cut = plan.where("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("border"))
    for digits in (DIGITS, 2 * DIGITS, None):
        cut = materialize(_border(rows, cut, digits, hint), "mix-border")
    plan = plan.join(hint(cut.select("key", "before", "border", "words")), "key", "left")
    part = F.when(F.col("h") < F.col("border"), F.col("size")).when(F.col("h") == F.col("border"), F.floor(F.col("size") * (F.col("rest") - F.col("before")) / F.col("words"))).otherwise(0)
    return hint(plan), rows, own, (F.col("whole") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")


HOW = {"id_col": "doc_id", "text": "text", "source": "source", "weights": (5, 2, 1), "share": 1.0, "max_epochs": 3, "seed": 11, "most_broadcast": 100_000}


def mix(docs: DataFrame, **how) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document; ``taken`` counts repetitions; ``how`` as in HOW."""
    plan, rows, _, taken = _plan(docs, **(HOW | how))
    return rows.join(plan, "key").select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as it is taken, the border's parts rounded to whole documents.

    Columns of ``docs`` only. Each row is taken by its own identifier, source and size, whatever other rows there are.
    """
    plan, _, own, taken = _plan(docs, **(HOW | how))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in own.items()))
    times = F.when(F.col("size") > 0, F.round(taken / F.col("size"))).otherwise(0).cast("int").alias("times")
    found = rows.join(plan, "key").select("row", times).where("times > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
