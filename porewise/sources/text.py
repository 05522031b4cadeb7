"""Readers and writers of pileup text, FASTA, BED and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import decode_neighbours, encode_neighbours
from ..functions.pileup import to_rna
from ..schema import COLUMNS, FEATURES
from .storage import materialize


def _paths(paths: str | Sequence[str]) -> list[str]:
    return paths.split(",") if isinstance(paths, str) else list(paths)


#: Where a line stands: the number of its file among those given, and its place in it. These columns in order are the order of the input.
PLACE = ("file", "line")


def _lines(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """Lines of the files, each with the number of its file and a key that keeps their order in it.

    A key holds the path, the block of the file and a number that grows within the block, whatever
    tasks read the blocks; it goes through any shuffle. ``whole`` keeps carriage returns in lines.
    """
    parts = [spark.read.text(p, lineSep="\n" if whole else None).select("value", F.lit(i).alias("file"), F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line")) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``number``, the 0-based number of a line among all that were read; the lines must be whole files.

    Lines of a block bear consecutive keys, so only the first key and the count of each block are
    needed, and one row for each block of a file meets in one task, and is sent to all: lines stay where they are.
    """
    block = [F.col("file"), F.col("line.path").alias("path"), F.col("line.block").alias("block")]
    counts = lines.groupBy(*block).agg(F.min("line.line").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "path", "block").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("file", F.struct("path", "block").alias("__in"), "first", F.coalesce(before, F.lit(0)).alias("begin"))
    keyed = lines.withColumn("__in", F.struct(F.col("line.path").alias("path"), F.col("line.block").alias("block")))
    return keyed.join(F.broadcast(begins), ["file", "__in"]).withColumn("number", F.col("begin") + F.col("line.line") - F.col("first")).drop("__in", "first", "begin")


def read_pileup(spark: SparkSession, paths: str | Sequence[str], ordered: bool = False) -> DataFrame:
    """Six fields of each line; lines with fewer, or without numbers where they belong, are dropped. ``ordered`` adds the line's place."""
    lines = _lines(spark, _paths(paths))
    return parse_pileup(lines if ordered else lines.select("value"), PLACE if ordered else ())


def parse_pileup(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The same for a (streaming or batch) frame with a ``value`` column and columns to ``keep``."""
    f = F.split("value", "\t", -1)
    rows = lines.select(*keep, f[0].alias("chr"), f[1].try_cast("long").alias("site"), to_rna(f[2]).alias("ref_base"), F.when(F.size(f) >= 6, f[3].try_cast("int")).alias("n_reads"), F.get(f, 4).alias("bases"), F.get(f, 5).alias("qualities"), (F.size(f) == 6).alias("ends_with_qualities"))
    return rows.where("site is not null and n_reads is not null")


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """Stretches (chr, offset, seq, length) cut so that none is longer than ``size``, by one walk over each."""
    cut = F.posexplode_outer(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("place", "part")
    whole = rows.where(F.length("seq") <= size).select("chr", "offset", "seq", "length")
    long = rows.where(F.length("seq") > size).select("chr", "offset", "length", cut)
    return whole.union(long.select("chr", F.col("offset") + F.col("place") * size, "part", "length"))


#: Lines of a FASTA file that one task puts in order.
CHUNK_LINES = 1 << 16


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(chr, offset, seq, length): stretches of each record's sequence; the last record of a repeated name counts.

    Lines are numbered where they lie, in chunks of a bounded number of lines, and only the totals of
    chunks are added up in one task, so neither a chromosome nor a file that can't be split is held as a
    whole. Each record has a stretch, an empty one at least.
    """
    head = F.col("value").startswith(">")
    lines = _lines(spark, _paths(path)).select("file", "line.path", "line.block", F.floor(F.col("line.line") / CHUNK_LINES).alias("chunk"), "line.line", head.alias("head"), F.when(head, F.split(F.substring("value", 2, 1 << 20), r"\s")[0]).alias("chr"), F.when(head, "").otherwise(F.upper(F.regexp_replace("value", r"\s", ""))).alias("seq"))
    part = ["file", "path", "block", "chunk"]
    so_far = Window.partitionBy(*part).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("record", F.sum(F.col("head").cast("long")).over(so_far)).withColumn("offset", F.sum(F.length("seq").cast("long")).over(so_far) - F.length("seq"))
    totals = lines.groupBy(*part).agg(F.sum(F.col("head").cast("long")).alias("heads"), F.sum(F.length("seq").cast("long")).alias("bases"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(*part, F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("heads"), F.coalesce(F.sum("bases").over(before), F.lit(0)).alias("bases"))
    placed = placed.join(begins, part).select((F.col("record") + F.col("heads")).alias("record"), (F.col("offset") + F.col("bases")).alias("offset"), "chr", "seq", "head")
    placed = materialize(placed, "fasta-lines")
    records = placed.groupBy("record").agg(F.max("chr").alias("chr"), F.min(F.when(F.col("head"), F.col("offset"))).alias("begin"), F.sum(F.length("seq").cast("long")).alias("length"))
    last = records.where("chr is not null").groupBy("chr").agg(F.max_by(F.struct("record", "begin", "length"), "record").alias("r")).select("chr", "r.*")
    found = placed.select("record", "offset", "seq").join(last, "record")
    return found.select("chr", (F.col("offset") - F.col("begin")).alias("offset"), "seq", "length")


def reference_chunks(reference: DataFrame, size: int = 1 << 14, halo: int = 2) -> DataFrame:
    """(chr, chunk, piece, length): pieces of ``size`` bases with N-padded halos, for joins by position.

    ``reference`` has stretches as ``read_fasta`` gives them, or whole sequences (chr, seq, length).
    """
    rows = reference if "offset" in reference.columns else reference.withColumn("offset", F.lit(0).cast("long"))
    end, last = F.col("offset") + F.length("seq"), F.floor((F.col("length") - 1) / size)
    chunks = F.sequence(F.greatest(F.floor((F.col("offset") - halo) / size), F.lit(0)), F.least(F.floor((end - 1 + halo) / size), last))
    parts = _segments(rows, size).where("length(seq) > 0").withColumn("chunk", F.explode(chunks))
    low, high = F.col("chunk") * size - halo, (F.col("chunk") + 1) * size + halo
    begin = F.greatest("offset", low)
    part = F.substring("seq", (begin - F.col("offset") + 1).cast("int"), F.greatest(F.least(end, high) - begin, F.lit(0)).cast("int"))
    pieces = parts.groupBy("chr", "chunk", "length").agg(F.array_join(F.sort_array(F.collect_list(F.struct(begin.alias("at"), part.alias("part"))))["part"], "").alias("piece"))
    full = F.concat(F.when(F.col("chunk") == 0, "N" * halo).otherwise(""), "piece")
    room = F.least(F.lit(size), F.col("length") - F.col("chunk") * size) + 2 * halo
    return pieces.select("chr", "chunk", F.rpad(full, room.cast("int"), F.lit("N")).alias("piece"), "length")


def sequence_lengths(reference: DataFrame) -> DataFrame:
    """(chr, length) of each record."""
    return reference.select("chr", "length").distinct()


def read_bed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(chr, start, end, name, extras, file, line); lines with fewer than three fields are dropped."""
    f = F.split(F.trim("value"), "\t", -1)
    rows = _lines(spark, _paths(paths)).where(F.size(f) >= 3)
    return rows.select(f[0].alias("chr"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), F.get(f, 3).alias("name"), F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0))).alias("extras"), "file", "line").where("start is not null and end is not null")


_KINDS = {f.name: f.dataType.simpleString() for f in FEATURES.fields}
_HEAD = "\t".join(COLUMNS[:2])


def read_feature_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of feature tables as they are (``value``), each with its place, and the columns that are read out of it.

    ``head`` tells lines with column names, of which every part file may have one. Further fields of a line
    belong to no column. A field that is missing or no number is null.
    """
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    cell = lambda i, c: decode_neighbours(F.get(fields, i)) if c == "neighbour_error_pos" else F.get(fields, i) if _KINDS[c] == "string" else F.get(fields, i).try_cast(_KINDS[c])
    columns = [cell(F.lit(i), c).alias(c) for i, c in enumerate(COLUMNS)]
    return _lines(spark, _paths(paths), whole=True).select(*PLACE, "value", F.col("value").startswith(_HEAD).alias("head"), *columns)


def read_header(spark: SparkSession, paths: str | Sequence[str]) -> str | None:
    """The first line with column names that is found; files begin with it, so little is read."""
    for path in _paths(paths):
        if row := spark.read.text(path, lineSep="\n").where(F.col("value").startswith(_HEAD)).first():
            return row["value"]
    return None


def read_features(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = COLUMNS, ordered: bool = False) -> DataFrame:
    """Feature tables in text form; ``replicate`` numbers the files. ``ordered`` adds the line's place."""
    rows = read_feature_lines(spark, paths).where(~F.col("head") & (F.col("value") != ""))
    return rows.select(*columns, F.col("file").alias("replicate"), *(PLACE if ordered else ()))


def write_lines(rows: DataFrame, path: str, header: str | None = None, order: Sequence[str] = PLACE, compression: str | None = None) -> None:
    """The lines ``value`` in order, after the header: part files of one folder, which are the whole file one after the other.

    Rows are dealt to ranges of the order, so the parts' numbers follow it and none is sorted as a whole.
    Parts may be written with a ``compression``, which readers know by their names; each is then read by one task.
    """
    body = rows.select(F.lit(1).alias("__body"), *order, "value")
    if header is not None:
        head = rows.sparkSession.range(1).select(F.lit(0).alias("__body"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), F.lit(header).alias("value"))
        body = head.union(body)
    body.orderBy("__body", *order).select("value").write.text(path, compression=compression, lineSep="\n")


def append_fields(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as further fields at the end of each line; a null is an empty field."""
    return rows.withColumn("value", F.concat_ws("\t", F.regexp_replace("value", "\r$", ""), *(F.coalesce(c, F.lit("")) for c in columns)))


def append_header(header: str | None, columns: Sequence[str]) -> str | None:
    return None if header is None else "\t".join([header.removesuffix("\r"), *columns])


def _line(rows: DataFrame, columns: Sequence) -> DataFrame:
    """Adds ``value``: the columns as one line; a null is an empty field."""
    return rows.withColumn("value", F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)))


def _order(rows: DataFrame) -> Sequence[str]:
    return PLACE if set(PLACE) <= set(rows.columns) else ("chr", "site")


def write_features(features: DataFrame, path: str, columns: Sequence[str] = COLUMNS, compression: str | None = None) -> None:
    """Text form with one header, in the order of the input if rows know their place in it, else by chromosome and site."""
    shown = [encode_neighbours(F.col(c)) if c == "neighbour_error_pos" else F.col(c) for c in columns]
    write_lines(_line(features, shown), path, "\t".join(columns), _order(features), compression)


def write_bed(intervals: DataFrame, path: str) -> None:
    """Columns chr, start, end and, where present, name, without a header, in order."""
    names = ["chr", "start", "end", *(["name"] if "name" in intervals.columns else [])]
    intervals.orderBy("chr", "start").select(*names).write.csv(path, sep="\t", header=False, quote="", emptyValue="", nullValue="")


#: Columns of the annotated text table, in its order.
ANNOTATED = "chr site n_reads ref_base majority_base a_rate c_rate g_rate u_rate deletion_rate insertion_rate refskip_rate mismatch_rate q_mean motif neighbour_error_pos bed_name".split()


def write_annotated(rows: DataFrame, path: str) -> None:
    """The table with names of intervals, where an unknown name and a row without neighbours in error read ``None``."""
    near = F.when(F.size("neighbour_error_pos") > 0, encode_neighbours(F.col("neighbour_error_pos")))
    shown = [F.coalesce(near, F.lit("None")) if c == "neighbour_error_pos" else F.coalesce(c, F.lit("None")) if c == "bed_name" else F.col(c) for c in ANNOTATED]
    write_lines(_line(rows, shown), path, "\t".join(ANNOTATED), _order(rows))
