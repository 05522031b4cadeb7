"""Vectors in inverted lists: a bounded sample gives the centroids, every row goes to its nearest one.

Lists lie as plain numpy files in the shared folder, in parts of bounded size, so a list that holds
a third of all rows is many files; workers memory-map what they need. The driver holds one row for
each list (at most ``most_lists``): rows, parts and radius. A part that cannot be opened is empty
only if the list's rows are complete without it; else the task fails.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import materialize, mounted_path, new_folder, small_batches
from .kneser_ney import save

INFINITY = float("inf")


# ------------------------------------------------------------------ rows


def finite(vector: str | Column) -> Column:
    """Whether a vector is there, with all its components numbers; an empty vector has none to fail."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY))


def of_one_length(rows: DataFrame, vector: str, dims: int | None) -> tuple[DataFrame, int]:
    """The rows whose vector has ``dims`` components, or else as many as most have (the longer of equally frequent ones)."""
    if dims is None:
        sizes = rows.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n")).where("dims > 0")
        most = sizes.agg(F.max(F.struct("n", "dims"))["dims"].alias("dims")).first()
        dims = (most and most["dims"]) or 0
    return rows.where(F.size(vector) == dims), dims


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A row for each array of a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not dims:
        return np.zeros((len(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


# ------------------------------------------------------------------ centroids


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]


def sum_rows(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of each label from 0 to k - 1."""
    out = np.zeros((k, x.shape[1]), x.dtype)
    if len(x):
        order = np.argsort(label, kind="stable")
        labels, begins = np.unique(label[order], return_index=True)
        out[labels] = np.add.reduceat(x[order], begins, axis=0)
    return out


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of a sample that fits into memory; ones that lose all their rows stay where they are."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = squared_distances(x, centroids).argmin(axis=1)
        sums = sum_rows(x, near, len(centroids))
        count = np.bincount(near, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def sampled(rows: DataFrame, id_col: str, vector: str, count: int, most: int, dims: int) -> np.ndarray:
    """About ``most`` vectors at most, chosen by a hash of the identifier and the vector, in a fixed order."""
    h = F.pmod(F.xxhash64(F.lit(13), id_col, vector), F.lit(1 << 30))
    if count > most:
        rows = rows.where(h < int((1 << 30) * most / count))
    found = rows.select(h.alias("h"), F.col(id_col).alias("id"), F.col(vector).alias("v")).limit(2 * most).toArrow()
    x = matrix(found.column("v"), dims).astype(np.float64)
    return x[np.lexsort((*x.T[::-1], found.column("h").to_numpy()))] if len(x) else x


# ------------------------------------------------------------------ the index


@dataclass(frozen=True)
class Lists:
    """What the driver and every worker know of the lists."""

    folder: str
    centroids: np.ndarray
    counts: np.ndarray
    parts: np.ndarray
    radii: np.ndarray


class Parts:
    """Arrays of the parts of lists, mapped when they are used; the last ``keep`` files stay open."""

    def __init__(self, lists: Lists, keep: int = 1024):
        self.lists, self.keep, self.open = lists, keep, OrderedDict()

    def array(self, of: int, part: int, name: str) -> np.ndarray:
        key = (of, part, name)
        if key in self.open:
            self.open.move_to_end(key)
        else:
            if len(self.open) >= self.keep:
                self.open.popitem(last=False)
            self.open[key] = np.load(f"{self.lists.folder}/{of}-{part}.{name}.npy", mmap_mode="r")
        return self.open[key]

    def there(self, of: int) -> list[int]:
        """The parts of a list that hold rows; together they must hold all of its rows."""
        key = (of, -1, "there")
        if key not in self.open:
            found = [p for p in range(int(self.lists.parts[of])) if os.path.exists(f"{self.lists.folder}/{of}-{p}.id.npy")]
            rows = sum(len(self.array(of, p, "id")) for p in found)
            if rows != self.lists.counts[of]:
                raise FileNotFoundError(f"list {of} in {self.lists.folder} has {rows} of its {self.lists.counts[of]} rows")
            self.open[key] = found
        return self.open[key]


def assign(rows: DataFrame, centroids: np.ndarray, vector: str, keep: list[str]) -> DataFrame:
    """(list, distance, keep..., vector): each row's nearest centroid, the first of equally near ones."""
    small_batches(rows.sparkSession, 5000)
    c = rows.sparkSession.sparkContext.broadcast(centroids)
    names = ["list", "distance", *keep, vector]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(len(keep)), c.value.shape[1]).astype(np.float64)
            d = squared_distances(x, c.value)
            near = d.argmin(axis=1)
            far = np.sqrt(((x - c.value[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), *batch.columns], names=names)

    shape = rows.select(*keep, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields)
    return shape.mapInArrow(run, f"list int, distance double, {kinds}")


def build(assigned: DataFrame, centroids: np.ndarray, vector: str, name: str, write, part_rows: int) -> Lists:
    """Write every row of a materialised ``assigned`` into the parts of its list.

    ``write(table, put)`` gets one part's rows, ordered by id, and puts arrays by name; ``id`` is put for it.
    Rows go to parts by a hash of their place in the table, so copies of one row are spread too.
    """
    spark = assigned.sparkSession
    k = len(centroids)
    counts, radii = np.zeros(k, np.int64), np.zeros(k)
    for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect():  # one row a list
        counts[r["list"]], radii[r["list"]] = r["n"], r["radius"]
    parts = -(-counts // part_rows)
    folder = mounted_path(new_folder(spark, name))

    def store(table: pa.Table) -> pa.Table:
        of, part = table.column("list")[0].as_py(), table.column("part")[0].as_py()
        table = table.sort_by("id")
        put = lambda what, array: save(f"{folder}/{of}-{part}.{what}.npy", np.ascontiguousarray(array))
        write(table, put)
        put("id", table.column("id").to_numpy())  # last: a part with ids is whole
        return pa.table({"list": pa.array([of], pa.int32()), "n": pa.array([len(table)], pa.int64())})

    per = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts.tolist())], "list int, parts int") if k else None
    if per is not None:
        dealt = assigned.drop("distance").join(F.broadcast(per), "list")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")).cast("int")).drop("parts")
        written = dealt.groupBy("list", "part").applyInArrow(store, "list int, n long").agg(F.sum("n").alias("n")).first()["n"] or 0
        if written != counts.sum():
            raise RuntimeError(f"{written} of {counts.sum()} rows were written")
    return Lists(folder, centroids, counts, parts, radii)


def in_chunks(rows: DataFrame, chunk: int, count: int, order: list[str], search, schema: str) -> DataFrame:
    """``search(table)`` over chunks of rows that lie near each other in ``order``, many chunks at once."""
    partitions = max(1, -(-count // chunk))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                if size and size + piece.num_rows > chunk:
                    yield from search(pa.Table.from_batches(held)).to_batches()
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield from search(pa.Table.from_batches(held)).to_batches()

    return rows.repartitionByRange(partitions, *order).mapInArrow(run, schema)


def index_table(rows: DataFrame, id_col: str, vector: str, more: dict[str, Column], name: str, list_rows: int | None, most_lists: int, most_sample: int, dims: int) -> tuple[DataFrame, np.ndarray, int]:
    """The rows (id, more..., v) with their list, as a table; the centroids; how many rows there are.

    There are as many lists as ``list_rows`` asks for, or else the square root of the rows, up to ``most_lists``.
    """
    rows = rows.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in more.items()), F.col(vector).alias("v"))
    count = rows.count()
    wanted = int(count**0.5) if list_rows is None else -(-count // list_rows)
    k = max(1, min(most_lists, wanted))
    sample = sampled(rows, "id", "v", count, most_sample, dims)
    centroids = lloyd(sample, k) if len(sample) else np.zeros((1, max(dims, 1)))
    return materialize(assign(rows, centroids, "v", ["id", *more]), name), centroids, count


def is_float_array(df: DataFrame, vector: str) -> bool:
    kind = df.schema[vector].dataType
    return isinstance(kind, ArrayType) and kind.elementType.simpleString() == "float"
