"""Connected components: a forest of each partition's edges, then alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EDGE = "u long, v long"


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every node to the smallest node which these edges link it with; that node has none."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != root[root]).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forest(edges_at_once: int):
    def run(batches):
        u, v, waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

        def merged():
            return contract(np.concatenate([u, *(b.column(0).to_numpy() for b in waiting)]), np.concatenate([v, *(b.column(1).to_numpy() for b in waiting)]))

        for batch in batches:
            waiting.append(batch)
            if sum(len(b) for b in waiting) >= edges_at_once:
                (u, v), waiting = merged(), []
        u, v = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _smallest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest neighbour of u, u included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _both(edges: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two edges (u, v) of each row, in one pass over the rows."""
    pairs = F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (first, second)))
    return edges.select(F.inline(pairs))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root has any."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
    return seen.where("out > 1 or out = 1 and low = 0").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60, edges_at_once: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); a root is its component's smallest node.

    Each task first reduces its own edges to a forest, ``edges_at_once`` at a time, which leaves
    few rounds of stars. Hot nodes are aggregated before the shuffle, and their joins are left to
    Spark's skew handling. Self-loops and repeated edges do no harm; an edge with a null end links
    nothing and names no node; an empty table gives an empty result.
    """
    forest = _forest(edges_at_once)
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(ends.mapInArrow(forest, EDGE), "components")
    for _ in range(most_rounds):
        if _all_stars(now):
            break
        large = _smallest(_both(now, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _both(_smallest(large), ("v", "m"), ("u", "m")).where("u <> v").distinct()
        now = materialize(down.mapInArrow(forest, EDGE), "components")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
