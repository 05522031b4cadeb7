"""Operations on intervals and position sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import NAME, STRETCH, carry, inside, stretch_of

#: Width of a bin of positions, and of a word of them.
BIN, WORD = 1024, 64


def to_bed(features: DataFrame) -> DataFrame:
    return features.select("chr", (F.col("site") - 1).alias("start"), F.col("site").alias("end"))


def _bins(intervals: DataFrame, *columns: str) -> DataFrame:
    """A row of each interval for each bin of 0-based positions that it meets; empty intervals have none."""
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))
    return intervals.where("end > start").select("chr", "start", "end", *columns, F.explode(bins).alias("bin"))


def single_bases(intervals: DataFrame, *columns: str) -> DataFrame:
    """A row of each interval for each 0-based position, as ``start``; a long interval is opened bin by bin."""
    inside = F.sequence(F.greatest("start", F.col("bin") * BIN), F.least("end", (F.col("bin") + 1) * BIN) - 1)
    return _bins(intervals, *columns).select("chr", F.explode(inside).alias("start"), *columns)


def position_set(intervals: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct (chr, site), 1-based; ``compat`` takes only the first base of each interval."""
    bases = intervals.where("end > start").select("chr", "start") if compat else single_bases(intervals)
    return bases.select("chr", (F.col("start") + 1).alias("site")).distinct()


def cover(intervals: DataFrame, *columns: str, size: int = STRETCH) -> DataFrame:
    """Disjoint ranges (chr, start, end, columns...) that hold the same positions as the intervals.

    In the order of start and end, an interval keeps what lies beyond the furthest end of those before
    it, so each position belongs to the first interval that holds it, and what an interval keeps is one
    range. The furthest end is a running maximum within stretches of starts; the one of the stretches
    before comes from one row for each stretch. Of equal intervals the smallest columns count.
    """
    rows = intervals.where("end > start").groupBy("chr", "start", "end")
    rows = rows.agg(F.min(F.struct(*columns)).alias("v")).select("chr", "start", "end", "v.*") if columns else rows.agg(F.count("*").alias("n")).drop("n")
    rows = rows.withColumn(NAME, stretch_of("start", size))
    reached = F.max("end").over(inside("start", "end", last=-1))
    rows = carry(rows, __before=(F.max("end"), F.max, 1)).withColumn("__reached", reached)
    begin = F.greatest("start", "__reached", "__before")
    return rows.select("chr", begin.alias("start"), "end", *columns).where("start < end")


def _words(ranges: DataFrame, *columns: str) -> DataFrame:
    """A row of each range for each word of positions that it meets; long ranges are opened in two steps."""
    step = WORD << 10
    blocks = F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step))
    opened = ranges.select("chr", "start", "end", *columns, F.explode(blocks).alias("__block"))
    first, last = F.greatest("start", F.col("__block") * step), F.least("end", (F.col("__block") + 1) * step) - 1
    return opened.select("chr", "start", "end", *columns, F.explode(F.sequence(F.floor(first / WORD), F.floor(last / WORD))).alias("word"))


def position_bits(intervals: DataFrame) -> DataFrame:
    """(chr, word, bits): one row for each word of 0-based positions of which any is held; bit i is that of word * 64 + i."""
    low, high = F.greatest(F.col("start") - F.col("word") * WORD, F.lit(0)).cast("int"), F.least(F.col("end") - F.col("word") * WORD, F.lit(WORD)).cast("int")
    # as many ones as the range holds of the word, moved up to its first position there
    words = _words(cover(intervals)).select("chr", "word", low.alias("low"), (high - low).alias("n"))
    bits = F.expr(f"shiftleft(shiftrightunsigned(-1L, {WORD} - n), low)")
    return words.groupBy("chr", "word").agg(F.bit_or(bits).alias("bits"))


def _held(features: DataFrame, intervals: DataFrame, how: str, compat: bool = False) -> DataFrame:
    """Rows of the features by whether an interval holds their site: each meets one word of positions at most."""
    if compat:
        return features.join(position_set(intervals, True), ["chr", "site"], how)
    f, w = features.alias("f"), position_bits(intervals).alias("w")
    there = (F.col("f.chr") == F.col("w.chr")) & (F.floor((F.col("f.site") - 1) / WORD) == F.col("w.word")) & F.expr(f"(shiftright(w.bits, cast(pmod(f.site - 1, {WORD}) as int)) & 1L) = 1L")
    return f.join(w, there, how)


def include(features: DataFrame, intervals: DataFrame, compat: bool = False) -> DataFrame:
    return _held(features, intervals, "left_semi", compat)


def exclude(features: DataFrame, intervals: DataFrame, compat: bool = False) -> DataFrame:
    return _held(features, intervals, "left_anti", compat)


def annotate(features: DataFrame, intervals: DataFrame, column: str = "bed_name") -> DataFrame:
    """Adds the name of an interval that holds each site, or null; of several, the first by start, end and name.

    Since ``cover`` gives a position to the first interval that holds it, each row meets one word of
    positions, with the few disjoint ranges in it.
    """
    # words come first in keys: most comparisons of a sort end with them, where names of chromosomes are alike
    ranges = _words(cover(intervals, "name"), "name").groupBy("word", "chr").agg(F.collect_list(F.struct("start", "end", "name")).alias("__ranges"))
    ranges = ranges.withColumnRenamed("word", "__word")
    found, at = features.withColumn("__word", F.floor((F.col("site") - 1) / WORD)), F.col("site") - 1
    holds = F.get(F.filter("__ranges", lambda r: (r["start"] <= at) & (at < r["end"])), F.lit(0))
    return found.join(ranges, ["__word", "chr"], "left").withColumn(column, holds["name"]).drop("__word", "__ranges")


def add_info(features: DataFrame, intervals: DataFrame, n_columns: int, compat: bool = False) -> DataFrame:
    """Appends ``bed_col_1..n``: further fields of the last interval that starts at the site (``compat``: one before it)."""
    last = intervals.select("chr", (F.col("start") + (0 if compat else 1)).alias("site"), "extras", "file", "line")
    last = last.groupBy("chr", "site").agg(F.max_by("extras", F.struct("file", "line")).alias("__extras"))
    found = features.join(last, ["chr", "site"], "left")
    return found.withColumns({f"bed_col_{i + 1}": F.get("__extras", F.lit(i)) for i in range(n_columns)}).drop("__extras")


def intersect(a: DataFrame, b: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Whole intervals with ``name`` telling whether both files have them, or which one; one shuffle."""
    tagged = a.select("chr", "start", "end", F.lit(1).alias("of")).union(b.select("chr", "start", "end", F.lit(2).alias("of")))
    have = tagged.groupBy("chr", "start", "end").agg(F.bit_or("of").alias("of"))
    return have.select("chr", "start", "end", F.when(F.col("of") == 3, f"{label_a}+{label_b}").when(F.col("of") == 1, label_a).otherwise(label_b).alias("name"))


def merge(files: list[DataFrame]) -> DataFrame:
    """Single bases of all files, names joined in order of arrival; the first is kept even if empty, later ones if not."""
    tagged = [f.select("chr", "start", "end", F.coalesce("name", F.lit("")).alias("name"), F.lit(i).alias("file"), "line") for i, f in enumerate(files)]
    bases = single_bases(reduce(DataFrame.unionAll, tagged), "file", "line", "name").select("chr", "start", F.struct("file", "line", "name").alias("n"))
    gathered = bases.groupBy("chr", "start").agg(F.sort_array(F.collect_list("n"))["name"].alias("names"))
    rest = F.filter(F.slice("names", 2, F.size("names")), lambda x: x != "")
    return gathered.select("chr", "start", (F.col("start") + 1).alias("end"), F.array_join(F.concat(F.slice("names", 1, 1), rest), ",").alias("name"))


def difference(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """Bases of ``a`` that ``b`` lacks, with the last name; ``compat`` gives those that both have."""
    bases = single_bases(a, "name", "line").withColumn("site", F.col("start") + 1)
    named = bases.groupBy("chr", "start", "site").agg(F.coalesce(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("line"))), F.lit("")).alias("name"))
    kept = _held(named, b, "left_semi" if compat else "left_anti")
    return kept.select("chr", "start", F.col("site").alias("end"), "name")
