"""Approximate nearest neighbours: inverted lists of rotated vectors in column blocks, scanned adaptively.

All vectors are turned by one seeded random rotation, which spreads their length over the
dimensions, and each part of a list is stored dimension by dimension in blocks. A query visits lists
by the distance of their centroids. In a list it adds up squared differences block by block; after
d of D dimensions, a candidate whose partial sum exceeds

    d/D * (1 + eps / sqrt(d))^2 * (distance of the k-th best so far)^2

is not among the best but for a chance that ``eps`` bounds, and is abandoned, so its further blocks
are never read. Who passes all blocks is measured exactly, on the original vectors in double
precision, and only such distances are compared and returned; of equal ones the smaller id is first.

A list is left out for certain when its centroid is farther from the query than its radius and the
k-th best together; otherwise a query goes on until it has visited lists with ``share`` of all rows.
For vectors without any clusters, as random directions are, recall grows with that share (README
has figures); clustered ones end by the certain rule long before.

Rows with a null id or vector, a component that is null or not finite, or no component but zeros,
take no part, nor do vectors of another length than most have. Rows are told apart by their id: of
rows that share a query's id, the one with the smallest vector is the query, and none of them is its
neighbour. An empty table has no neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory
from .inverted_lists import Lists, Parts, build, finite, in_chunks, index_table, is_float_array, matrix, of_one_length

FOUND = "query_id long, rank int, id long, distance double"


@dataclass(frozen=True)
class Settings:
    """``most_sample`` vectors at most fit the centroids; ``part_rows`` bounds a file of a list."""

    k: int = 10
    share: float = 0.6
    eps: float = 2.1
    block: int = 16
    list_rows: int | None = None
    most_lists: int = 4096
    most_sample: int = 20_000
    part_rows: int = 8192
    chunk: int = 64
    seed: int = 3


@dataclass
class Work:
    """Component differences computed in the scan, and those that a full scan of the same lists computes; exact distances."""

    scanned: int = 0
    full: int = 0
    exact: int = 0


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x.astype(np.float64) - q) ** 2).sum(axis=1))


def scan(query: np.ndarray, turned: np.ndarray, own: int, parts: Parts, unit: float, s: Settings, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the nearest found; ``turned`` is the query divided by ``unit`` and rotated."""
    lists, work = parts.lists, work or Work()
    dims = len(query)
    away = np.sqrt(((lists.centroids - query) ** 2).sum(axis=1))
    order = np.lexsort((np.arange(len(away)), away))
    order = order[lists.counts[order] > 0]
    best_id, best = np.empty(0, np.int64), np.empty(0)
    visited, enough = 0, s.share * lists.counts.sum()
    # what rounding to single precision may add to a squared distance, beside a share of it
    loose = 2e-9 * float(turned @ turned) + 1e-300
    for of in order:
        worst = best[-1] if len(best) == s.k else np.inf
        if away[of] - lists.radii[of] > worst * (1 + 1e-9):
            continue  # certain, whatever has been visited
        if visited >= enough and len(best) == s.k:
            break
        visited += lists.counts[of]
        for p in parts.there(of):
            ids = parts.array(of, p, "id")
            alive, partial = None, np.zeros(len(ids))
            work.full += len(ids) * dims
            for b, at in enumerate(range(0, dims, s.block)):
                columns = parts.array(of, p, f"block{b}")
                columns = columns if alive is None else columns[:, alive]
                work.scanned += columns.size
                partial = partial + ((columns - turned[at : at + s.block, None]) ** 2).sum(axis=0)
                if worst < np.inf:
                    d = min(at + s.block, dims)
                    factor = d / dims * (1 + s.eps / d**0.5) ** 2 if d < dims else 1 + 3e-5
                    stays = partial <= factor * (worst / unit) ** 2 + loose
                    alive = np.flatnonzero(stays) if alive is None else alive[stays]
                    partial = partial[stays]
                    if not len(alive):
                        break
            rows = np.arange(len(ids)) if alive is None else alive
            rows = rows[ids[rows] != own]
            if not len(rows):
                continue
            if alive is None and len(rows) > 4 * s.k:  # the first lists: what is far behind need not be measured
                near = partial[rows]
                rows = rows[near <= np.partition(near, s.k)[s.k] * (1 + 6e-5) + loose]
            distance = exact_distances(parts.array(of, p, "raw")[rows], query)
            work.exact += len(rows)
            best_id, best = np.concatenate([best_id, ids[rows]]), np.concatenate([best, distance])
            first = np.lexsort((best_id, best))[: s.k]
            best_id, best = best_id[first], best[first]
            worst = best[-1] if len(best) == s.k else np.inf
    return best_id, best


def _store(dims: int, unit: float, single: bool, s: Settings):
    turn = rotation(dims, s.seed) if dims else None

    def write(table: pa.Table, put) -> None:
        raw = matrix(table.column("v"), dims)
        turned = (raw.astype(np.float64) / unit @ turn).astype(np.float32)
        for b, at in enumerate(range(0, dims, s.block)):
            put(f"block{b}", turned[:, at : at + s.block].T)
        put("raw", raw.astype(np.float32) if single else raw)

    return write


def nearest(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", dims: int | None = None, settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest found of every query (a condition on ``rows``)."""
    s = settings or Settings()
    spark, single = rows.sparkSession, is_float_array(rows, vector)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.col(vector).alias("v"))
    rows = rows.where("id is not null").where(finite("v")).where(F.exists("v", lambda x: x != 0))
    rows, dims = of_one_length(rows, "v", dims)
    rows = rows.withColumn("v", F.col("v").cast("array<double>")) if not single else rows
    assigned, centroids, _ = index_table(rows, "id", "v", {"query": F.col("query")}, "nearest-assigned", s.list_rows, s.most_lists, s.most_sample, dims)
    most = assigned.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))).alias("m"), F.count(F.when(F.col("query"), 1)).alias("n")).first()
    unit = most["m"] or 1.0
    lists = spark.sparkContext.broadcast(build(assigned.drop("query"), centroids, "v", "nearest", _store(dims, unit, single, s), s.part_rows))
    chosen = assigned.where("query").groupBy("id").agg(F.min(F.struct("v", "list")).alias("q")).select("id", "q.list", "q.v")

    def run(table: pa.Table) -> pa.Table:
        raw = matrix(table.column("v"), dims).astype(np.float64)
        turned = raw / unit @ rotation(dims, s.seed)
        ids, parts = table.column("id").to_numpy(), Parts(lists.value)
        found = [scan(raw[i], turned[i], int(ids[i]), parts, unit, s) for i in range(len(raw))]
        give_back_memory()
        each = [len(d) for _, d in found]
        flat = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.empty(0, kind)
        rank = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in each]) if each else np.empty(0, np.int32)
        return pa.table({"query_id": pa.array(np.repeat(ids, each)), "rank": pa.array(rank, pa.int32()), "id": pa.array(flat(0, np.int64)), "distance": pa.array(flat(1, np.float64))})

    return in_chunks(chosen, s.chunk, most["n"], ["list", "id"], run, FOUND)
