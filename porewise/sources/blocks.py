"""Pileup in block-compressed files: gzip members of bounded size, an index of positions beside each file.

A part file is a row of gzip members (any gzip tool reads it as a whole), each with its own size in an
extra field, as block gzip files have it, and an empty member at the end, without which a file counts as
truncated. A block holds lines of one chromosome. The index, a text file beside it, has a line for each
block: where it begins, its size, its chromosome, and the least and greatest site in it. A reader splits
files at blocks and reads only blocks that a condition on ``chr`` or ``site`` does not exclude; the driver
knows files and sizes, and each task reads the index of its own file. The folder must be mounted on the
workers (a ``file:`` path). Lines with other than six fields are not written this way.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "pileup_blocks"
SCHEMA = "chr string, site long, ref_base string, n_reads int, bases string, qualities string"
#: Bytes of text in a block at most (a longer line is a block of its own).
BLOCK_BYTES = 60_000
#: The start of a gzip member with an extra field of subfield BC, and the empty member that ends a file.
HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: A larger block's size does not fit the field; it is 0 there, and the index tells it.
LARGEST = 1 << 16


def local(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"block files need a mounted folder, not {path!r}")
    return parts.path if parts.scheme else path


def member(text: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    size = len(HEAD) + 2 + len(body) + 8
    return HEAD + struct.pack("<H", size - 1 if size <= LARGEST else 0) + body + struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)


def text_of(block: bytes, where: str) -> bytes:
    """The text of one whole member, checked."""
    unpacker = zlib.decompressobj(31)
    try:
        out = unpacker.decompress(block)
    except zlib.error as e:
        raise OSError(f"{where}: {e}") from e
    if not unpacker.eof or unpacker.unused_data:
        raise OSError(f"{where}: the block is truncated")
    return out


# ------------------------------------------------------------------ writing


@dataclass
class Written(WriterCommitMessage):
    part: str


class BlockWriter(DataSourceArrowWriter):
    """A part file and its index for each task; files of failed attempts have other names and are left out."""

    def __init__(self, path: str):
        self.path = local(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        part = f"part-{uuid.uuid4().hex}"
        index, at = [], 0
        with open(f"{self.path}/_{part}.gz", "wb") as f:
            for name, low, high, text in _blocks(batches):
                packed = member(text)
                f.write(packed)
                index.append(f"{at}\t{len(packed)}\t{low}\t{high}\t{name}\n")
                at += len(packed)
            f.write(END)
        with open(f"{self.path}/_{part}.index", "w") as f:
            f.writelines(index)
        return Written(part)

    def commit(self, messages: list[Written | None]) -> None:
        for number, m in enumerate(x for x in messages if x is not None):
            for kind in ("index", "gz"):
                os.replace(f"{self.path}/_{m.part}.{kind}", f"{self.path}/part-{number:05d}.{kind}")
        with open(f"{self.path}/_parts.json", "w") as f:
            json.dump(sum(m is not None for m in messages), f)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for kind in ("index", "gz") if m else ():
                if os.path.exists(file := f"{self.path}/_{m.part}.{kind}"):
                    os.remove(file)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(chromosome, least site, greatest site, text) of blocks in the order of the rows."""
    name, low, high, lines, size = None, 0, 0, [], 0
    for batch in batches:
        fields = [pc.fill_null(c.cast(pa.string()), "") for c in batch.columns]
        text = pc.binary_join_element_wise(*fields, "\t").to_pylist()
        for c, site, line in zip(fields[0].to_pylist(), batch.column(1).to_pylist(), text, strict=True):
            if lines and (c != name or size + len(line) >= BLOCK_BYTES):
                yield name, low, high, ("\n".join(lines) + "\n").encode()
                lines, size = [], 0
            if not lines:
                name, low, high = c, site, site
            low, high = min(low, site), max(high, site)
            lines.append(line)
            size += len(line) + 1
    if lines:
        yield name, low, high, ("\n".join(lines) + "\n").encode()


# ------------------------------------------------------------------ reading


@dataclass
class Stretch(InputPartition):
    """The blocks of a file that begin at a byte from ``begin`` to before ``end``."""

    file: str
    begin: int
    end: int

    def __post_init__(self):
        super().__init__(None)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = local(path), split_bytes
        self.names: set[str] | None = None
        self.low, self.high = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters):
        """Bounds of sites and names of chromosomes choose blocks; the rows in them are filtered by Spark all the same."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "chr" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif column == "site":
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Stretch]:
        """Stretches of files of about ``split_bytes``; each file must be there, and end as it should."""
        with open(f"{self.path}/_parts.json") as f:
            parts = json.load(f)
        out = []
        for number in range(parts):
            file = f"{self.path}/part-{number:05d}"
            size = os.path.getsize(f"{file}.gz")
            with open(f"{file}.gz", "rb") as f:
                f.seek(max(0, size - len(END)))
                if f.read() != END:
                    raise OSError(f"{file}.gz is truncated")
            out += [Stretch(file, at, at + self.split_bytes) for at in range(0, max(1, size - len(END)), self.split_bytes)]
        return out

    def chosen(self, p: Stretch) -> Iterator[tuple[int, int]]:
        """Where the wanted blocks of a stretch begin, and their sizes."""
        with open(f"{p.file}.index") as f:
            for line in f:
                at, size, low, high, name = line.rstrip("\n").split("\t", 4)
                if int(at) >= p.end:
                    return
                if int(at) >= p.begin and int(high) >= self.low and int(low) <= self.high and (self.names is None or name in self.names):
                    yield int(at), int(size)

    def read(self, p: Stretch) -> Iterator[pa.RecordBatch]:
        kinds = {"chr": pa.string(), "site": pa.int64(), "ref_base": pa.string(), "n_reads": pa.int32(), "bases": pa.string(), "qualities": pa.string()}
        with open(f"{p.file}.gz", "rb") as f:
            for at, size in self.chosen(p):
                f.seek(at)
                text = text_of(f.read(size), f"{p.file}.gz at {at}")
                table = csv.read_csv(pa.BufferReader(text), csv.ReadOptions(column_names=list(kinds), use_threads=False, block_size=len(text) + 1), csv.ParseOptions(delimiter="\t", quote_char=False, double_quote=False, escape_char=False), csv.ConvertOptions(column_types=kinds, strings_can_be_null=False))
                yield from table.to_batches()


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options.get("splitbytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        if os.path.exists(local(self.options["path"])) and os.listdir(local(self.options["path"])):
            raise FileExistsError(self.options["path"])
        return BlockWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)


def write_blocks(rows: DataFrame, path: str) -> None:
    """Pileup rows, sorted by chromosome and site over the part files, which makes blocks narrow."""
    register(rows.sparkSession)
    shaped = rows.selectExpr(*(f"cast({c} as {k}) as {c}" for c, k in (x.split() for x in SCHEMA.split(", "))))
    shaped.where("site is not null").orderBy("chr", "site").write.format(NAME).mode("append").save(path)


def read_blocks(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("splitBytes", split_bytes).load(path)
