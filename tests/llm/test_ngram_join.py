"""Components against all pairs, with ordinary and with tiny limits."""

import random

import numpy as np
import pyarrow as pa
import pytest

from porewise.llm import ngram_join, queries
from porewise.llm.components import connected_components, contract

from .helpers import components, documents, shingles, similar_pairs


def _compare(found, rows):
    sets = [shingles(t) for _, t in rows]
    root = components(len(rows), similar_pairs(sets))
    name = {}
    for (i, _), r, s in zip(rows, root, sets, strict=True):
        if s:
            name[r] = min(i, name.get(r, i))
    want = sorted((i, len(s), name[r] if s else i) for (i, _), r, s in zip(rows, root, sets, strict=True))
    assert sorted((r[0], r[1], r[2]) for r in found) == want
    return len(want) - len({w[2] for w in want})


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choices(vocabulary, k=30))
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "a a a a a a a"), (7, "a a a a a"), (8, "É e x y z q"), (9, "é e x y z q")]
    for family in range(18):
        text = rng.choices(vocabulary, k=rng.choice([6, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 3, 8])):
            changed = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                at = rng.randrange(len(changed))
                changed[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
                changed = changed or ["x"]
            if family % 4 == 0:
                changed = common.split() + changed  # a passage that many share
            rows.append((100 + len(rows), " ".join(changed)))
            text = changed if family % 3 == 0 else text  # chains
    copies = " ".join(rng.choices(vocabulary, k=40))
    rows += [(1000 + i, copies) for i in range(30)]
    rng.shuffle(rows)
    return rows


TINY = ngram_join.Settings(shard_shingles=300, chunk_documents=9, heavy_documents=6)
GROUPS = ngram_join.Settings(shard_shingles=300, chunk_documents=9, heavy_documents=6, fan_out=4)
LONG = ngram_join.Settings(longest_extension=12, rounds=0, heavy_documents=4, chunk_documents=30)


@pytest.mark.parametrize("settings", [None, TINY, GROUPS, LONG])
@pytest.mark.parametrize("seed", range(2))
def test_all_pairs(spark, seed, settings):
    rows = _rows(seed)
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    assert _compare(ngram_join.jaccard_components(docs, settings=settings).collect(), rows) > 40


def test_border_of_similarity(spark):
    """80 of 100 shared shingles link, one fewer does not."""
    base = [f"w{i}" for i in range(94)]  # 90 shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base, *(f"x{i}" for i in range(22))])), (3, " ".join([*base, *(f"y{i}" for i in range(23))]))]
    _compare(ngram_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect(), rows)


def test_shingles_cut_to_one_token(spark, monkeypatch):
    """A set of 8 in one of 10 (similarity 0.8) stays a candidate though two of its shingles are cut to the same token."""
    few = np.array([i << 33 | 100 * i + 5 for i in range(8)], np.uint64)
    few[1] = (few[0] & np.uint64(0xFFFFFFFF)) | np.uint64(1 << 40)
    many = np.concatenate([few, np.array([i << 34 | 7 * i + 1 for i in (50, 51)], np.uint64)])
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda *_: [few, many])
    settings = ngram_join.Settings()
    heavy = type("Sent", (), {"value": np.empty(0, np.uint64)})
    texts = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], names=["text"])
    dealt = pa.Table.from_batches(list(ngram_join._deal(settings, 1, 1, heavy)([texts] * 2)))  # copies in two blocks
    found = ngram_join._prefixes(settings)(ngram_join._shared(1, 1)(dealt)).to_pylist()
    assert {r["id"]: r["shared"] for r in found} == {np.uint64(ngram_join.set_hash(x)).astype(np.int64): 8 for x in (few, many)}
    by_node = [{r["token"] for r in found if r["n"] == n} for n in (8, 10)]
    assert by_node[0] & by_node[1]


def test_blocks_only_for_shards_that_get_anything():
    """Dealing costs the same whatever the number of shards."""
    heavy = type("Sent", (), {"value": np.empty(0, np.uint64)})
    texts = pa.RecordBatch.from_arrays([pa.array([f"one two three four five six {i}" for i in range(20)])], names=["text"])
    (batch,) = ngram_join._deal(ngram_join.Settings(), 1_000_000_000, 1, heavy)([texts])
    assert 0 < batch.num_rows <= 22


def test_long_text(spark):
    rows = [(1, "".join(f"w{i} " for i in range(60_000))), (2, "".join(f"w{i} " for i in range(59_000))), (3, "w1 w2 w3 w4 w5")]
    _compare(ngram_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect(), rows)


def test_repeated_and_missing_identifiers(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone in the whole wide world"), (7, None)]
    got = ngram_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(map(str, ((r["id"], r["component_id"]) for r in got))) == sorted(["(1, 1)", "(1, 1)", "(None, 1)", "(None, None)", "(7, 7)"])


def test_empty(spark):
    assert ngram_join.jaccard_components(documents(spark, [(1, "x", "en", "s")]).where("false")).count() == 0
    one = documents(spark, [(1, None, "en", "s"), (2, "", "en", "s")])
    assert [(r[0], r[1], r[2]) for r in sorted(ngram_join.jaccard_components(one).collect())] == [(1, 0, 1), (2, 0, 2)]


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    _compare(queries.op10_ngram_join(spark, small).collect(), rows)


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 600)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    loose = [(None, 1), (2, None), (None, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges + loose, "a long, b long")).collect()}
    root = components(1300, edges)
    assert got == {i: root[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


def _brute_roots(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(20))
def test_contract(seed):
    random = np.random.default_rng(seed)
    a, b = random.integers(-30, 30, (2, int(random.integers(0, 50))))
    u, v = contract(a, b)
    roots = _brute_roots(zip(a.tolist(), b.tolist(), strict=True))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: r for x, r in roots.items() if x != r}


def test_components_over_partitions(spark):
    """A long path, a star and a clique whose edges lie in many partitions, some of them repeated."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)]
    edges = np.random.default_rng(1).permutation(np.array(edges + edges[::3])).tolist()
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8), edges_at_once=16)
    assert {r["node"]: r["root"] for r in found.collect()} == _brute_roots(edges)
    assert found.count() == found.select("node").distinct().count()


@pytest.mark.parametrize(
    ("texts", "settings"),
    [
        (["one text of a few words only"], None),
        (["red fox runs over the hill", "blue fish swims under the sea", "a third text of other words", "x", ""], None),
        (["the same text stands here twice today"] * 2, TINY),
        (["the same text stands here twice today"] * 3 + [f"number {i} has words of its own {i * i}" for i in range(40)], GROUPS),
    ],
)
def test_without_near_copies(spark, texts, settings):
    """Shards, one or many, in which no shingle is in two different sets."""
    rows = list(enumerate(texts))
    _compare(ngram_join.jaccard_components(documents(spark, [(i, t, "en", "s") for i, t in rows]), settings=settings).collect(), rows)


def test_common_shingle_below_a_chunks_share(spark):
    """A shingle in 1/200 of all documents, evenly spread, is reported by every chunk and found to be common."""
    texts = [("so common a passage of words" if i % 200 == 0 else "") + f" a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(4000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").selectExpr("id", "text", "xxhash64(text) as tag").coalesce(1)
    s = ngram_join.Settings(heavy_documents=4, chunk_documents=1000)
    described = rows.mapInArrow(ngram_join._describe(s), "kind byte, id long, n long, mark long, tag long")
    assert len(ngram_join._heavy_shingles(described, 4000, s)) == 2
