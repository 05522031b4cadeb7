"""Hard negatives, nearest neighbours and clusters against plain scans of all rows."""

import math
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from porewise.llm import hard_negatives, inverted_lists, nearest, queries, yinyang

NAN, INF = float("nan"), float("inf")
KINDS = "vec_id long, embedding array<float>, label int"


def _rows(seed=0, n=400, dims=8, clusters=6):
    """Clustered vectors with copies, ties, and every kind of row that takes no part."""
    random = np.random.default_rng(seed)
    heads = random.standard_normal((clusters, dims))
    x = heads[random.integers(0, clusters, n)] + 0.2 * random.standard_normal((n, dims))
    x[n // 2 : n // 2 + 60] = x[7]  # many copies
    x[-20:] = np.round(x[-20:])
    rows = [(i, v.astype(np.float32).tolist(), int(random.integers(0, 10))) for i, v in enumerate(x)]
    v = rows[3][1]
    rows += [(n, None, 1), (n + 1, v, None), (n + 2, [*v[:-1], None], 1), (n + 3, [*v[:-1], NAN], 2), (n + 4, [*v[:-1], INF], 2), (n + 5, [], 1), (n + 6, v[:3], 1), (n + 7, [0.0] * dims, 4), (None, v, 3)]
    return rows


def _frame(spark, rows, kinds=KINDS):
    df = spark.createDataFrame(rows, kinds).repartition(3)
    for name in ("id", "v", "list", "part", "distance", "anchor", "query", "cluster", "kind", "upper"):
        df = df.withColumn(name, F.lit("x"))
    return df


def _good(rows, dims):
    return [(i, np.array(v, np.float64), y) for i, v, y in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


# ------------------------------------------------------------------ hard negatives


def _negatives(rows, dims, every):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in _good(rows, dims) if i is not None and y is not None]
    out = []
    for i, a, y in kept:
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b, strict=True)), j, z) for j, b, z in kept if j != i]
        for s, p, _ in sorted(r for r in scored if r[2] == y)[:5]:
            window = sorted(r for r in scored if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s)
            out += [(i, p, k, j, -s, -t) for k, (t, j, _) in enumerate(window[:3], 1)]
    return sorted(out)


TINY = hard_negatives.Settings(list_rows=25, part_rows=9, chunk=7)


@pytest.mark.parametrize("settings", [None, TINY])
def test_negatives(spark, settings):
    rows = _rows()
    got = hard_negatives.hard_negatives(_frame(spark, rows), F.col("vec_id") % 5 == 0, settings=settings)
    assert sorted(map(tuple, got.collect())) == _negatives(rows, 8, 5)


def test_negatives_without_rows(spark):
    for rows in ([], _rows()[-9:], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (5, [1.0], 1)]):
        assert hard_negatives.hard_negatives(_frame(spark, rows), F.col("vec_id") % 5 == 0).count() == 0


def test_repeated_anchors(spark):
    """Rows with the anchor's id are one anchor and never its positive."""
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.75, 0.25], 2)]
    got = hard_negatives.hard_negatives(_frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 2, 65536, 49152)]


def _in_lists(folder, x, store, k=12, part_rows=40, seed=1):
    """An index of the vectors without Spark."""
    centroids = inverted_lists.lloyd(x.astype(np.float64), k, seed=seed)
    near = inverted_lists.squared_distances(x.astype(np.float64), centroids).argmin(axis=1)
    radii, parts, counts = np.zeros(len(centroids)), np.zeros(len(centroids), int), np.bincount(near, minlength=len(centroids))
    for i in range(len(centroids)):
        own = np.flatnonzero(near == i)
        radii[i] = np.sqrt(((x[own] - centroids[i]) ** 2).sum(axis=1)).max(initial=0)
        for p in range(0, len(own), part_rows):
            rows = own[p : p + part_rows]
            for name, array in {"id": rows, **store(rows)}.items():
                inverted_lists.save(f"{folder}/{i}-{p // part_rows}.{name}.npy", np.ascontiguousarray(array))
            parts[i] += 1
    return inverted_lists.Lists(str(folder), centroids, counts, parts, radii)


def test_lists_are_left_out_by_bounds(tmp_path):
    """Of well separated clusters few are visited, and nothing is lost."""
    random = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(random.standard_normal((12, 16)) * 3, 50, axis=0) + 0.1 * random.standard_normal((600, 16)))).astype(np.int64)
    labels = random.integers(0, 10, 600)
    lists = _in_lists(tmp_path, x, lambda rows: {"vector": x[rows].astype(np.int32), "label": labels[rows]})
    anchors, visits = np.arange(0, 600, 7), hard_negatives.Visits()
    got = [r for a in anchors for r in hard_negatives.search(np.array([a]), labels[[a]], x[[a]], lists, hard_negatives.Settings(), visits)]
    rows = [(i, (v / 256).tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))]
    assert sorted(got) == _negatives(rows, 16, 7)
    assert visits.positives < 0.3 * visits.pairs and visits.negatives < 0.5 * visits.pairs


def test_a_lost_part_is_an_error(tmp_path):
    x = np.arange(40, dtype=np.int64).reshape(20, 2)
    lists = _in_lists(tmp_path, x, lambda rows: {"vector": x[rows], "label": rows % 2}, k=2, part_rows=4)
    next(tmp_path.glob("1-*.id.npy")).unlink()
    with pytest.raises(FileNotFoundError, match="list 1"):
        hard_negatives.search(np.array([0]), np.array([0]), x[:1], lists, hard_negatives.Settings())


def test_too_large_scores(tmp_path):
    x = np.full((3, 2), 1 << 30, np.int64)
    lists = _in_lists(tmp_path, x, lambda rows: {"vector": x[rows], "label": rows})
    with pytest.raises(OverflowError):
        hard_negatives.search(np.array([0]), np.array([0]), x[:1], lists, hard_negatives.Settings())


# ------------------------------------------------------------------ nearest neighbours


def _nearest(rows, dims, every, k=10):
    kept = [(i, v) for i, v, _ in _good(rows, dims) if i is not None and v.any()]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    out = {}
    for i, v in kept:
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def _by_query(found):
    out = {}
    for q, rank, i, d in sorted(map(tuple, found.collect())):
        out.setdefault(q, []).append((i, d))
        assert rank == len(out[q])
    return out


@pytest.mark.parametrize("settings", [nearest.Settings(eps=50, share=1.0), nearest.Settings(eps=50, share=1.0, list_rows=30, part_rows=11, chunk=5, block=3, k=70)])
def test_all_lists_without_abandoning_are_exact(spark, settings):
    rows = _rows()
    got = _by_query(nearest.nearest(_frame(spark, rows), F.col("vec_id") % 10 == 0, settings=settings))
    assert got == _nearest(rows, 8, 10, settings.k)


def test_recall_and_work(tmp_path):
    """Directions without clusters: nine tenths of the true neighbours at least, and less work than a scan."""
    random = np.random.default_rng(8)
    x = random.standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = nearest.Settings()
    turn = nearest.rotation(64, s.seed)
    assert np.allclose(turn @ turn.T, np.eye(64))
    turned = (x.astype(np.float64) @ turn).astype(np.float32)
    lists = _in_lists(tmp_path, x, lambda rows: {"raw": x[rows], **{f"block{b}": turned[rows, 16 * b : 16 * b + 16].T for b in range(4)}}, k=77, part_rows=1000)
    parts, work, hit = inverted_lists.Parts(lists), nearest.Work(), 0
    asked = range(0, 6000, 60)
    for q in asked:
        v = x[q].astype(np.float64)
        got, distance = nearest.scan(v, v @ turn, q, parts, 1.0, s, work)
        d = nearest.exact_distances(x, v)
        d[q] = np.inf
        assert np.allclose(distance, d[got], rtol=1e-15) and (np.diff(distance) >= 0).all()
        hit += len(set(got) & set(np.argsort(d)[:10]))
    assert hit >= 0.93 * 10 * len(asked)
    assert work.scanned < 0.95 * work.full and work.exact < 0.1 * 6000 * len(asked)


def test_neighbours_without_rows(spark):
    for rows in ([], _rows()[-9:-1], [(0, [1.0, 2.0], 1)]):
        assert nearest.nearest(_frame(spark, rows), F.col("vec_id") % 5 == 0).count() == 0
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 3.0], 1), (1, [4.0, 6.0], None), (2, [4.0, 6.0], 2)]
    assert _by_query(nearest.nearest(_frame(spark, rows, KINDS.replace("float", "double")), F.col("vec_id") % 5 == 0)) == {0: [(1, 5.0), (2, 5.0)]}


def test_recall_of_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, got = _nearest(rows, 64, 100), {}
    for q, _, i, d in sorted(map(tuple, queries.op12_nearest_neighbours(spark, small).collect())):
        got.setdefault(q, []).append((i, d))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.9 * 10 * len(want)


# ------------------------------------------------------------------ clusters


def _clusters(rows, dims, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in _good(rows, dims)]
    heads = [v for _, v in sorted((sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    far = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c, strict=True))
    for r in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(heads)) for _, v in kept]
        if r < rounds:
            for j in range(len(heads)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    heads[j] = [math.floor(Fraction(sum(x), len(own))) for x in zip(*own, strict=True)]
    each = [sum(d for d, c in near if c == j) for j in range(len(heads))]
    name = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in heads]
    return sorted((str(i), c, d, each[c], sum(each), name[c]) for (i, _), (d, c) in zip(kept, near, strict=True))


@pytest.mark.parametrize("settings", [yinyang.Settings(dims=8), yinyang.Settings(dims=8, k=21, groups=5, rounds=4)])
def test_clusters(spark, settings):
    rows = _rows(2)
    rows += rows[:40]  # repeated rows
    got = yinyang.cluster(_frame(spark, rows), settings=settings)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got.collect())) == _clusters(rows, 8, settings.k, settings.rounds)


def test_few_vectors(spark):
    s = yinyang.Settings(dims=2)
    for rows in ([], [(0, [1.0, 2.0], 1)], [(i, [1.0, -0.0001], 1) for i in range(12)]):
        got = yinyang.cluster(_frame(spark, rows), settings=s)
        assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got.collect())) == _clusters(rows, 2)
    with pytest.raises(ValueError, match="beyond"):
        yinyang.cluster(_frame(spark, [(0, [1e9, 2.0], 1)]), settings=s)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_lose_nothing(seed):
    """Rounds with bounds give the clusters of plain rounds, ties included, by fewer distances."""
    random = np.random.default_rng(seed)
    k, spread = int(random.integers(2, 40)), int(random.integers(1, 4))
    heads = random.integers(-1000, 1000, (k, 12)) if seed % 2 else random.integers(-4, 4, (k, 12))
    x = heads[random.integers(0, k, 2000)] + random.integers(-spread, spread + 1, (2000, 12))
    c, work = x[:k].astype(np.int64), yinyang.Work()
    group = yinyang.group_centroids(c, int(random.integers(1, 8)))
    near, _, upper, lower = yinyang.assign_first(x, c, group)
    for _ in range(8):
        new = c.copy()
        for j in np.unique(near):
            new[j] = x[near == j].sum(axis=0) // (near == j).sum()
        drift = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + 1e-9)
        c = new
        near, upper, lower = yinyang.assign_again(x, c, group, drift, near, upper, lower, work)
        d = yinyang.distances(x, c)
        assert (near == d.argmin(axis=1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(2000), near]).all()
        root[np.arange(2000), near] = np.inf
        assert all((lower[:, g] <= root[:, group == g].min(axis=1)).all() for g in range(group.max() + 1))
    assert seed % 2 == 0 or work.measured < 0.6 * work.plain


def test_exact_at_large_components():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 5]])
    assert yinyang.distances(x, x).tolist() == [[0, 1 + (5 + (1 << 26)) ** 2], [1 + (5 + (1 << 26)) ** 2, 0]]
