"""Intervals near sites, and runs of neighbouring sites: sorted scans over stretches, with values carried over their borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize
from . import bed
from .stretches import NAME, STRETCH, carry, inside, stretch_of, totals

_EVENT = "struct<at:bigint,start:bigint,end:bigint,name:string>"


def nearest_intervals(features: DataFrame, intervals: DataFrame, size: int = STRETCH) -> DataFrame:
    """Adds the nearest interval that ends before each site and the nearest that begins after it, with their distances.

    ``up_distance`` counts from the interval's last base to the site, ``down_distance`` from the site to
    the interval's first base; both are 1 for direct neighbours and null, as the name is, where there is
    none. Intervals that hold the site are neither. Of several that end together the shortest counts,
    then the smallest name (null first); of several that begin together likewise. Empty intervals do not
    count, repeated rows and sites are no matter, and sites without a number have no neighbours.

    Sites and ends of intervals are sorted together in stretches of positions; the last end and the next
    beginning beyond a stretch's borders come from one row for each stretch.
    """
    full = intervals.where("end > start")
    ends = full.groupBy("chr", F.col("end").alias("pos")).agg(F.min(F.struct((-F.col("start")).alias("s"), "name")).alias("v"))
    ends = ends.select("chr", "pos", F.lit(2).alias("kind"), F.struct(F.col("pos").alias("at"), (-F.col("v.s")).alias("start"), F.col("pos").alias("end"), F.col("v.name").alias("name")).cast(_EVENT).alias("up"), F.lit(None).cast(_EVENT).alias("down"))
    begins = full.groupBy("chr", "start").agg(F.min(F.struct("end", "name")).alias("v"))
    first = F.col("start") + 1
    begins = begins.select("chr", first.alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast(_EVENT).alias("up"), F.struct(first.alias("at"), "start", F.col("v.end").alias("end"), F.col("v.name").alias("name")).cast(_EVENT).alias("down"))
    events = ends.union(begins).withColumn(NAME, stretch_of("pos", size))
    site = F.col("site").alias("pos")
    seen = features.select("chr", site).withColumn(NAME, stretch_of("pos", size)).dropDuplicates(["chr", NAME])
    borders = totals(events.unionByName(seen, allowMissingColumns=True), before=(F.max("up"), F.max, 1), after=(F.min("down"), F.min, -1))
    rows = features.select("chr", site, F.lit(1).alias("kind"), F.struct(*features.columns).alias("__row")).withColumn(NAME, stretch_of("pos", size))
    sorted_ = rows.unionByName(events, allowMissingColumns=True)
    # at one position a beginning comes before a site and an end after it, so neither counts for a site that it holds
    near = sorted_.withColumn("up", F.last("up", ignorenulls=True).over(inside("pos", "kind"))).withColumn("down", F.last("down", ignorenulls=True).over(inside(F.desc("pos"), F.desc("kind"))))
    found = near.where("kind = 1").join(borders, ["chr", NAME], "left")
    up, down = F.coalesce("up", "before"), F.coalesce("down", "after")
    return found.select("__row.*", (F.col("pos") - up["at"]).alias("up_distance"), up["name"].alias("up_name"), (down["at"] - F.col("pos")).alias("down_distance"), down["name"].alias("down_name"))


def error_runs(features: DataFrame, intervals: DataFrame, threshold: float = 0.5, gap: int = 1, size: int = STRETCH) -> DataFrame:
    """Longest runs of sites in error no more than ``gap`` apart, as (chr, start, end, sites, covered, bed_name, worst).

    ``sites`` counts the different sites in error, ``covered`` those that an interval holds; ``bed_name``
    is that of the first of them (null if none is held or the name is null), ``worst`` the highest rate. A run
    goes on over the borders of stretches: the last site and the beginning of the last run before a
    stretch come from one row for each stretch, so one run may be as long as a chromosome.
    """
    wrong = features.where(F.col("mismatch_rate") >= threshold).where("chr is not null and site is not null")
    wrong = wrong.groupBy("chr", "site").agg(F.max("mismatch_rate").alias("rate"))
    held = F.struct(F.lit(True).alias("held"), F.col("name").alias("name"))
    named = bed.annotate(wrong, intervals.withColumn("name", held), "__held")
    rows = materialize(named.withColumn(NAME, stretch_of("site", size)), "error-runs")
    last = carry(rows, before=(F.max("site"), F.max, 1))
    apart = F.col("site") - F.coalesce(F.lag("site").over(Window.partitionBy("chr", NAME).orderBy("site")), "before")
    begun = last.withColumn("begin", F.when(apart <= gap, None).otherwise(F.col("site"))).drop("before")
    run = F.coalesce(F.last("begin", ignorenulls=True).over(inside("site")), "begun")
    placed = carry(begun, begun=(F.max("begin"), F.max, 1)).withColumn("run", run)
    first = F.min(F.when(F.col("__held.held"), F.struct("site", F.col("__held.name").alias("name"))))
    return placed.groupBy("chr", "run").agg(F.max("site").alias("end"), F.count("*").alias("sites"), F.count("__held.held").alias("covered"), first["name"].alias("bed_name"), F.max("rate").alias("worst")).select("chr", (F.col("run") - 1).alias("start"), "end", "sites", "covered", "bed_name", "worst")

