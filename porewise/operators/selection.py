"""Exact quantiles by selection: counts of value ranges, narrowed pass by pass to the wanted ranks.

No task holds a group's values. A pass counts, for each group and each range of values that still
holds a wanted rank, the rows in ``PIECES`` pieces of the range, with the least and the greatest value
of each piece; the piece with the rank is the range of the next pass. The first pass cuts by sign and
binary exponent, the later ones into pieces of equal width, all of which keep the order of values.
A range shrinks to what its rows span, so it ends in a single value: after as many passes as there
are digits of ``PIECES`` in a number (six at most), and after two or three where values repeat much.
What a pass shuffles is bounded by groups x ranks x pieces, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize

PIECES = 4096
#: Ranges (a few numbers each) are sent to all tasks up to so many, else joined by group.
MOST_BROADCAST = 200_000


def exponent(v: Column) -> Column:
    """Sign and binary exponent as one number that grows with the value."""
    size = F.greatest(F.least(F.floor(F.log2(F.abs(v))), F.lit(1024)), F.lit(-1080)) + 1100
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


def piece(v: Column, low: Column, high: Column) -> Column:
    """The piece of a range that a value is in, from 0 on; halves avoid an overflow of wide ranges."""
    share = F.try_divide(v / 2 - low / 2, high / 2 - low / 2)
    return F.when(high > low, F.least(F.floor(share * PIECES), F.lit(PIECES - 1))).otherwise(0).cast("long")


def select_ranks(values: DataFrame, ranks: DataFrame, group: Sequence[str], passes: list[int] | None = None) -> DataFrame:
    """(group, rank, value): the value at each 0-based rank among a group's values in ascending order.

    ``values`` has the columns of ``group`` and ``value``, a double that is neither null nor NaN, and should be
    a written table; ranks beyond a group have no row. ``passes``, if given, collects the rows that each pass counted into.
    """
    keys = list(group)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    open_, done, first = ranks.select(*keys, "rank", F.col("rank").alias("rest")), None, True
    while True:
        if first:
            counts = values.groupBy(*keys, exponent(F.col("value")).alias("__piece"))
            counts = counts.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
            span = keys
        else:
            ranges = open_.select(*keys, "low", "high").distinct()
            few = F.broadcast(ranges) if size <= MOST_BROADCAST else ranges
            inside = (F.col("v.value") >= F.col("r.low")) & (F.col("v.value") <= F.col("r.high"))
            met = values.alias("v").join(few.alias("r"), [*same("v", "r"), inside])
            place = piece(F.col("v.value"), F.col("r.low"), F.col("r.high"))
            counts = met.groupBy(*(F.col(f"v.{k}").alias(k) for k in keys), "r.low", "r.high", place.alias("__piece"))
            counts = counts.agg(F.count("*").alias("n"), F.min("v.value").alias("least"), F.max("v.value").alias("most"))
            span = [*keys, "low", "high"]
        upto = F.sum("n").over(Window.partitionBy(*span).orderBy("__piece"))
        counts = counts.withColumn("upto", upto).alias("c")
        wanted = open_.alias("o")
        at = [*same("o", "c"), *([] if first else [F.col("o.low") == F.col("c.low"), F.col("o.high") == F.col("c.high")])]
        at += [F.col("o.rest") < F.col("c.upto"), F.col("o.rest") >= F.col("c.upto") - F.col("c.n")]
        found = wanted.join(counts, at).select(*(F.col(f"o.{k}").alias(k) for k in keys), "o.rank", (F.col("o.rest") - F.col("c.upto") + F.col("c.n")).alias("rest"), F.col("c.least").alias("low"), F.col("c.most").alias("high"), "c.n")
        found = materialize(found, "ranks")
        told = found.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
        done = told if done is None else done.union(told)
        open_, first = found.where("low < high"), False
        size = open_.count()
        if passes is not None:
            passes.append(int(open_.agg(F.sum("n")).first()[0] or 0))
        if not size:
            return done


def quantiles(rows: DataFrame, values: Sequence[str], points: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group, n rows, an array for each of ``values``): the values at the points, interpolated between the two nearest ranks.

    A null or NaN is no value; a group without values has a null array. Minus zero is zero.
    """
    keys = list(group)
    long = F.explode(F.array(*(F.struct(F.lit(i).alias("__of"), F.col(v).cast("double").alias("value")) for i, v in enumerate(values)))).alias("p")
    table = rows.select(*keys, long).select(*keys, "p.__of", (F.col("p.value") + F.lit(0.0)).alias("value"))
    table = materialize(table, "values")
    real = table.where("value is not null and not isnan(value)")
    sizes = real.groupBy(*keys, "__of").agg(F.count("*").alias("n"))
    at = F.explode(F.array(*(F.struct(F.lit(j).alias("point"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for j, q in enumerate(points)))).alias("p")
    wanted = materialize(sizes.select(*keys, "__of", at).select(*keys, "__of", "p.point", F.col("p.at").alias("at")), "points")
    ranks = wanted.select(*keys, "__of", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    chosen = materialize(select_ranks(real, ranks, [*keys, "__of"]), "quantiles").alias("s")
    w = wanted.alias("w")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__of"]]
    near = w.join(chosen, [*same, (F.col("s.rank") == F.floor("w.at")) | (F.col("s.rank") == F.ceil("w.at"))])
    low, high, part = F.min("s.value"), F.max("s.value"), F.first("w.at") - F.floor(F.first("w.at"))
    each = near.groupBy(*(F.col(f"w.{k}").alias(k) for k in [*keys, "__of"]), "w.point").agg((low * (1 - part) + high * part).alias("value"))
    arrays = each.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col("__of") == i, F.struct("point", "value"))))["value"].alias(v) for i, v in enumerate(values)))
    arrays = arrays.select(*keys, *(F.when(F.size(v) > 0, F.col(v)).alias(v) for v in values)).alias("a")
    counted = table.groupBy(*keys).agg(F.count(F.when(F.col("__of") == 0, 1)).alias("n")).alias("t")
    return counted.join(arrays, [F.col(f"t.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys] or F.lit(True), "left").select(*(F.col(f"t.{k}").alias(k) for k in keys), "t.n", *(F.col(f"a.{v}").alias(v) for v in values))
