"""Centroid clustering: exact k-means in whole numbers with Yinyang bounds.

Components are scaled and floored, so distances are whole numbers and every round is exact: a vector
goes to the nearest centroid (of equally near ones the smaller number), then each centroid becomes
the floored mean of its vectors; one without vectors stays. Centroids are put into groups once, by
clustering the first ones. Each vector carries an upper bound of the distance to its own centroid
and, for each group, a lower bound of the distance to that group's other centroids. After a move the
bounds give way by how far centroids went. A vector whose upper bound is below all lower bounds
stays where it is (global filter), else its own distance is measured and the test repeated; then
only groups whose bound is not above the best distance are looked into (group filter), and in them
only centroids that the group's old bound less their own move does not exclude (local filter).
Distances to these are measured exactly. Bounds are rounded outwards, so no filter loses a tie.

A round is one pass over the vectors in the shared folder, without a shuffle: tasks write vectors with
new bounds and, beside them, what moved in and out of each centroid in sum. The driver reads only
these sums, one row for each task and centroid, added up. The tables of a round are removed when the
next has been written, and a lost executor repeats its part of a round.

Vectors of another length than ``dims``, null ones and those with a component that is null or not
finite take no part. Rows are told apart by nothing: repeated rows count repeatedly, a null id is
like any other (its hash is that of an empty text). With fewer vectors than ``k`` there are as many
centroids as vectors; an empty table has no rows. Components beyond 2**27 after scaling end in an
error, since squared distances would exceed a 64-bit number.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, new_folder, small_batches
from .hard_negatives import scaled
from .inverted_lists import finite, lloyd, matrix, sum_rows

LARGEST = 1 << 27
ROWS = "kind byte, id long, v binary, cluster int, upper float, lower binary, distance long, moved long, sums array<long>"


@dataclass(frozen=True)
class Settings:
    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    seed: int = 3
    #: Groups of centroids; by default one for four of them, two at least.
    groups: int | None = None


@dataclass
class Work:
    """Exact distances that were measured, and those of a plain scan."""

    measured: int = 0
    plain: int = 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors: of each row to each centroid."""
    top = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * max(1, x.shape[1]) < 1 << 53:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((x.astype(np.int64) - one) ** 2).sum(axis=1) for one in c.astype(np.int64)], axis=1)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def group_centroids(centroids: np.ndarray, groups: int | None) -> np.ndarray:
    """The group of each centroid."""
    wanted = max(1, min(len(centroids), groups or max(2, -(-len(centroids) // 4))))
    c = centroids.astype(np.float64)
    heads = lloyd(c, wanted, rounds=5)
    near = ((c[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
    return np.unique(near, return_inverse=True)[1]


def assign_first(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance, and bounds of vectors without a history."""
    d = distances(x, c)
    near = d.argmin(axis=1)  # the first of equal ones
    own = d[np.arange(len(x)), near]
    root = np.sqrt(d.astype(np.float64))
    root[np.arange(len(x)), near] = np.inf
    lower = np.stack([root[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return near, own, up(np.sqrt(own.astype(np.float64))), down(lower)


def assign_again(x: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New clusters and bounds after the centroids have moved by at most ``drift``."""
    near, old_lower = near.copy(), lower.astype(np.float64)
    groups = group.max() + 1
    moved = np.array([drift[group == g].max() for g in range(groups)])
    upper = up(upper.astype(np.float64) + drift[near])
    lower = down(old_lower - moved[None])
    if work:
        work.plain += len(x) * len(c)
    rows = np.flatnonzero(upper >= lower.min(axis=1))  # global filter
    if len(rows):
        best = distances_to(x[rows], c, near[rows])
        if work:
            work.measured += len(rows)
        upper[rows] = up(np.sqrt(best.astype(np.float64)))
        again = upper[rows] >= lower[rows].min(axis=1)
        rows, best = rows[again], best[again]
    if len(rows):
        first, first_distance = near[rows].copy(), best.copy()
        searched = lower[rows] <= upper[rows][:, None]  # group filter; the best so far only gets better
        # the least distance of the centroids of each searched group, by what is known: measured or bounded
        known = np.full((len(rows), len(c)), np.inf)
        known[np.arange(len(rows)), first] = np.sqrt(best.astype(np.float64))
        for j in range(len(c)):
            bound = old_lower[rows, group[j]] - drift[j] * (1 + 1e-6) - 1e-6
            here = searched[:, group[j]] & (first != j)
            fits = here & (bound <= up(np.sqrt(best.astype(np.float64))))  # local filter
            known[here, j] = bound[here]
            some = np.flatnonzero(fits)
            if not len(some):
                continue
            d = distances(x[rows[some]], c[j : j + 1])[:, 0]
            if work:
                work.measured += len(some)
            known[some, j] = np.sqrt(d.astype(np.float64))
            better = (d < best[some]) | ((d == best[some]) & (j < near[rows[some]]))
            best[some[better]] = d[better]
            near[rows[some[better]]] = j
        known[np.arange(len(rows)), near[rows]] = np.inf  # bounds are of the others
        least = np.stack([known[:, group == g].min(axis=1) for g in range(groups)], axis=1)
        # a group that was not searched keeps its bound, but may have got the former centroid as one of the others
        left = near[rows] != first
        kept = lower[rows].astype(np.float64)
        at = np.flatnonzero(left)
        kept[at, group[first[at]]] = np.minimum(kept[at, group[first[at]]], np.sqrt(first_distance[at].astype(np.float64)))
        lower[rows] = down(np.where(searched, least, kept))
        upper[rows] = up(np.sqrt(best.astype(np.float64)))
    return near, upper, lower


def distances_to(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to one centroid of its own."""
    return ((x.astype(np.int64) - c[of].astype(np.int64)) ** 2).sum(axis=1)


# ------------------------------------------------------------------ rounds


class Round:
    """What a task needs: centroids, their groups and how far they moved; none of these in the first round."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None, kind: type):
        self.centroids, self.group, self.drift, self.kind = centroids, group, drift, kind

    def batch(self, x, near, upper, lower):
        if self.drift is None:
            near, _, upper, lower = assign_first(x, self.centroids, self.group)
            return near, upper, lower
        return assign_again(x, self.centroids, self.group, self.drift, near, upper, lower)


def _array(sums: np.ndarray) -> pa.Array:
    return pa.array(list(sums), pa.list_(pa.int64()))


def _step(now, last: bool):
    """One round over the vectors: rows of kind 0 are vectors with bounds, of kind 1 what each centroid gains in sum.

    In the last round, rows have distances instead of bounds, and nothing moves any more.
    """
    names = [p.split()[0] for p in ROWS.split(", ")]
    blank = lambda n: pa.nulls(n)

    def frame(n, **columns):
        kinds = {"kind": pa.int8(), "id": pa.int64(), "v": pa.binary(), "cluster": pa.int32(), "upper": pa.float32(), "lower": pa.binary(), "distance": pa.int64(), "moved": pa.int64(), "sums": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else blank(n).cast(kinds[k]) for k in names], names=names)

    def run(batches):
        r = now.value
        k, dims = r.centroids.shape
        gained, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, column = batch.num_rows, lambda name: batch.column(names.index(name))  # noqa: B023
            x = np.frombuffer(b"".join(column("v").to_pylist()), r.kind).reshape(n, dims).astype(np.int64)
            if r.drift is None:
                old, (near, upper, lower) = None, r.batch(x, None, None, None)
            else:
                old = column("cluster").to_numpy()
                bounds = np.frombuffer(b"".join(column("lower").to_pylist()), np.float32).reshape(n, -1)
                near, upper, lower = r.batch(x, old, column("upper").to_numpy(), bounds)
            shown = {"kind": pa.array(np.zeros(n, np.int8)), "id": column("id"), "cluster": pa.array(near.astype(np.int32))}
            if last:
                yield frame(n, **shown, distance=pa.array(distances_to(x, r.centroids, near)))
                continue
            changed = np.arange(n) if old is None else np.flatnonzero(near != old)
            for sign, labels in ((1, near), (-1, old)):
                if labels is not None:
                    sums += sign * sum_rows(x[changed], labels[changed], k)
                    gained += sign * np.bincount(labels[changed], minlength=k)
            yield frame(n, **shown, v=column("v"), upper=pa.array(upper), lower=pa.array([b.tobytes() for b in lower], pa.binary()))
        if not last:
            some = np.flatnonzero(np.any(sums != 0, axis=1) | (gained != 0))
            yield frame(len(some), kind=pa.array(np.ones(len(some), np.int8)), cluster=pa.array(some.astype(np.int32)), moved=pa.array(gained[some]), sums=_array(sums[some]))
        give_back_memory()

    return run


def _remove(spark, folder: str | None) -> None:
    """Delete the table of a round that is no longer needed."""
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _packed(kind: type):
    def run(batches):
        for batch in batches:
            dims = len(batch.column(1)[0]) if batch.num_rows else 1
            v = matrix(batch.column(1), dims).astype(kind)
            n = batch.num_rows
            empty = lambda t: pa.nulls(n).cast(t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), empty(pa.int32()), empty(pa.float32()), empty(pa.binary()), empty(pa.int64()), empty(pa.int64()), empty(pa.list_(pa.int64()))], names=[p.split()[0] for p in ROWS.split(", ")])

    return run


def first_centroids(rows: DataFrame, s: Settings) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order; of equal hashes the smaller vector."""
    h = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(s.k).collect()
    return np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), s.dims)


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    s, spark = settings or Settings(), df.sparkSession
    small_batches(spark, 5000)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(finite("v") & (F.size("v") == s.dims))
    rows = rows.withColumn("v", scaled("v", s.scale))
    largest = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if largest is not None and not -LARGEST <= largest <= LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling")
    kind = np.int16 if (largest or 0) < 1 << 15 else np.int32
    centroids = first_centroids(rows, s)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    group = group_centroids(centroids, s.groups)
    state, folder = rows.mapInArrow(_packed(kind), ROWS), None
    count, sums, drift = np.zeros(len(centroids), object), np.zeros(centroids.shape, object), None
    for _ in range(s.rounds):
        now = spark.sparkContext.broadcast(Round(centroids, group, drift, kind))
        path = new_folder(spark, "clusters")
        state.mapInArrow(_step(now, False), ROWS).write.parquet(path)
        _remove(spark, folder)
        folder = path
        written = spark.read.schema(ROWS).parquet(path)
        state = written.where("kind = 0").select(*(c.split()[0] for c in ROWS.split(", ")))
        # sums of one column each, as decimals: exact at any number of vectors
        exact = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(s.dims)]
        for r in written.where("kind = 1").groupBy("cluster").agg(F.sum("moved").alias("moved"), *exact).collect():  # one row a centroid
            count[r["cluster"]] += r["moved"]
            sums[r["cluster"]] += np.array([int(r[f"s{j}"]) for j in range(s.dims)], object)
        new = np.array([[int(x) // int(n) for x in row] if n else old for row, n, old in zip(sums, count, centroids.tolist(), strict=True)], np.int64)
        drift = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        centroids = new
    now = spark.sparkContext.broadcast(Round(centroids, group, drift, kind))
    path = new_folder(spark, "clusters-last")
    state.mapInArrow(_step(now, True), ROWS).select("id", "cluster", "distance").write.parquet(path)
    _remove(spark, folder)
    told = spark.read.schema("id long, cluster int, distance long").parquet(path)
    each = {r["cluster"]: int(r["d"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shown = spark.createDataFrame([(i, d, sum(each.values()), digest[i]) for i, d in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(shown), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
