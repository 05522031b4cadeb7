"""Hard negatives: exact search of inverted lists by Cauchy-Schwarz bounds.

A row's score for an anchor is the inner product of their vectors, in whole numbers (components are
scaled and floored). Every list of vectors has a centroid c and a radius r, so for an anchor a no
member scores above a.c + |a|r or below a.c - |a|r. A chunk of anchors visits lists by that upper
bound. First each anchor looks for its positives, the best rows of its own label: a list whose
bound is strictly below the anchor's k-th score is left out, and once all lists to come are, the
chunk stops. Then each positive has a window of scores for negatives, rows of other labels between
``low`` and ``high`` percent of the positive's score: lists that lie outside the window as a whole
are skipped, and so is one whose bound is strictly below the window's k-th score. Ties at a bound
are visited, so results are exact: higher scores first, of equal ones the smaller id.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part,
nor do vectors of another length than most have. Rows are told apart by their id: of rows that
share an anchor's id, the one with the smallest label and vector is the anchor, and none of them is
its positive or negative. An empty table has no negatives. Scores that may reach 2**53 end in an
error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory
from .inverted_lists import Lists, Parts, build, finite, in_chunks, index_table, matrix, of_one_length

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high`` are percents; ``most_sample`` vectors at most fit the centroids, ``part_rows`` bounds a file of a list."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    list_rows: int = 2000
    most_lists: int = 4096
    most_sample: int = 20_000
    part_rows: int = 8192
    chunk: int = 128


def scaled(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


# ------------------------------------------------------------------ the best of several parts


class Best:
    """For each of n searches the k best (score, id) so far, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), LAST)
        self.k = k

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, searches: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Let the rows of a part (scores of shape searches x ids, -inf for none) compete."""
        k, m = self.k, len(ids)
        least = self.score[searches, -1]
        if m > k:
            least = np.maximum(least, np.partition(scores, m - k, axis=1)[:, m - k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        all_row = np.concatenate([row, np.repeat(np.arange(len(searches)), k)])
        all_score = np.concatenate([scores[row, col], self.score[searches].ravel()])
        all_id = np.concatenate([ids[col], self.id[searches].ravel()])
        order = np.lexsort((all_id, -all_score, all_row))
        all_row = all_row[order]
        place = np.arange(len(order)) - np.searchsorted(all_row, all_row)
        keep = order[place < k]
        self.score[searches] = all_score[keep].reshape(-1, k)
        self.id[searches] = all_id[keep].reshape(-1, k)


# ------------------------------------------------------------------ search


@dataclass
class Visits:
    """How many (anchor, list) pairs were searched for positives and for negatives, and how many there are."""

    positives: int = 0
    negatives: int = 0
    pairs: int = 0


def _products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as float64 where these hold them."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return a.astype(np.float64) @ v.T.astype(np.float64)
    raise OverflowError("scores of 2**53 or more")


def search(ids: np.ndarray, labels: np.ndarray, a: np.ndarray, lists: Lists, s: Settings, visits: Visits | None = None) -> list[tuple]:
    """The rows of the result for a chunk of anchors."""
    parts, visits = Parts(lists), visits or Visits()
    x = a.astype(np.float64)
    there = np.flatnonzero(lists.counts > 0)
    middle, reach = x @ lists.centroids[there].T, np.linalg.norm(x, axis=1)[:, None] * lists.radii[there][None]
    slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # of the floating-point bounds
    upper, lower = middle + reach + slack, middle - reach - slack
    visits.pairs += upper.size
    order = np.argsort(-upper.max(axis=0), kind="stable")
    to_come = np.maximum.accumulate(upper[:, order[::-1]], axis=1)[:, ::-1]  # the best bound from here on
    positives = Best(len(a), s.positives)
    for step, at in enumerate(order):
        if (to_come[:, step] < positives.last).all():
            break
        active = np.flatnonzero(upper[:, at] >= positives.last)
        visits.positives += len(active)
        for p in parts.there(there[at]) if len(active) else ():
            other = parts.array(there[at], p, "id")
            scores = _products(a[active], parts.array(there[at], p, "vector"))
            fits = (parts.array(there[at], p, "label")[None] == labels[active][:, None]) & (other[None] != ids[active][:, None])
            positives.take(active, np.where(fits, scores, -np.inf), other)
    # a window for each anchor and positive; one without a positive is empty
    known = positives.score > -np.inf
    score = np.where(known, positives.score, 0).astype(np.int64)
    if score.size and int(np.abs(score).max()) * 100 > LAST:
        raise OverflowError("scores too large for percents of them")
    low = np.where(known, -((-s.low * score) // 100), LAST).astype(np.float64)
    high = np.where(known, (s.high * score) // 100, -1).astype(np.float64)
    found = [Best(len(a), s.negatives) for _ in range(s.positives)]
    for step, at in enumerate(order):
        wanted = [(upper[:, at] >= np.maximum(low[:, j], found[j].last)) & (lower[:, at] <= high[:, j]) & (low[:, j] <= high[:, j]) for j in range(s.positives)]
        active = np.flatnonzero(np.any(wanted, axis=0))
        visits.negatives += len(active)
        if not len(active):
            if all((to_come[:, step] < np.maximum(low[:, j], found[j].last)).all() for j in range(s.positives)):
                break
            continue
        for p in parts.there(there[at]):
            other = parts.array(there[at], p, "id")
            scores = _products(a[active], parts.array(there[at], p, "vector"))
            fits = (parts.array(there[at], p, "label")[None] != labels[active][:, None]) & (other[None] != ids[active][:, None])
            scores = np.where(fits, scores, -np.inf)
            for j in range(s.positives):
                mine = np.flatnonzero(wanted[j][active])
                if len(mine):
                    own, rows = active[mine], scores[mine]
                    found[j].take(own, np.where((rows >= low[own, j][:, None]) & (rows <= high[own, j][:, None]), rows, -np.inf), other)
    out = []
    for i in range(len(a)):
        for j in range(s.positives):
            for r in range(s.negatives):
                if found[j].score[i, r] > -np.inf:
                    out.append((int(ids[i]), int(positives.id[i, j]), r + 1, int(found[j].id[i, r]), int(score[i, j]), int(found[j].score[i, r])))
    return out


def _store(dims: int):
    def write(table: pa.Table, put) -> None:
        v = matrix(table.column("v"), dims)
        top = int(max(v.max(initial=0), -v.min(initial=0)))
        put("vector", v.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64))
        put("label", table.column("label").to_numpy())

    return write


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding", dims: int | None = None, settings: Settings | None = None) -> DataFrame:
    """For each anchor (a condition on ``rows``) and each of its positives, the first negatives in the window."""
    s = settings or Settings()
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).alias("v"))
    rows, dims = of_one_length(rows.where("id is not null and label is not null").where(finite("v")), "v", dims)
    rows = rows.withColumn("v", scaled("v", s.scale))
    assigned, centroids, _ = index_table(rows, "id", "v", {"label": F.col("label"), "anchor": F.col("anchor")}, "negatives-assigned", s.list_rows, s.most_lists, s.most_sample, dims)
    lists = spark.sparkContext.broadcast(build(assigned.drop("anchor"), centroids, "v", "negatives", _store(dims), s.part_rows))
    chosen = assigned.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v", "list")).alias("a")).select("id", "a.list", "a.label", "a.v")
    kind = FOUND.replace(" long", "").replace(" int", "").split(", ")

    def run(table: pa.Table) -> pa.Table:
        found = search(table.column("id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v"), dims), lists.value, s)
        give_back_memory()
        columns = list(zip(*found, strict=True)) or [[]] * len(kind)
        return pa.table({k: pa.array(c, pa.int32() if k == "rank" else pa.int64()) for k, c in zip(kind, columns, strict=True)})

    return in_chunks(chosen, s.chunk, assigned.where("anchor").count(), ["list", "id"], run, FOUND)
