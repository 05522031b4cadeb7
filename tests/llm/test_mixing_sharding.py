"""Mixing against stepwise water-filling, SQL, and shards against their law."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from porewise.llm import mixing, queries, sharding

from .helpers import documents, words


def _fill(sizes, share=1.0, epochs=3):
    """Targets by clamping and resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, clamped = {}, set()
    total = int(share * sum(sizes.values()))
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        free = [s for s in names if s not in clamped]
        target = {s: float(epochs * sizes[s]) for s in clamped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] >= epochs * sizes[s]}
        if not over:
            return target
        clamped |= over


def _rows(seed, n=300):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "", None, "hot", "hot", "hot", "hot"]
    out = [(i, rng.choice([None, "", " ", "one", "w " * rng.randint(1, 40)]), "en", rng.choice(sources)) for i in range(n)]
    return [*out, (5, "same id", "en", "a"), (5, "same id", "en", "a"), (None, "no id", "en", "b"), (n, "long " * 20_000, "en", "a")]


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rows = _rows(seed)
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = _fill(sizes)
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, mixing.mix(documents(spark, rows).repartition(7)).collect())) == sorted(map(key, got))


def test_repeated(spark):
    docs = documents(spark, [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(40)])
    taken = {r["id"]: round(r["taken"] / r["size"]) for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in taken.items() if n})


def test_repeated_by_row(spark):
    """One identifier in two sources, or with texts of two lengths, is taken by each row's own share."""
    rows = [(i, "w " * 10, "en", "a") for i in range(60)] + [(i, "w " * (5 + 10 * (i % 2)), "en", "b") for i in range(60)]
    docs = documents(spark, [*rows, (None, "w " * 10, "en", "a"), (3, "w " * 10, "en", "a")])
    goal = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(words(r["text"]))
    assert out.columns == docs.columns
    assert all(abs(got[s] - goal[s]) <= 30 for s in goal)


def test_mix_of_nothing(spark):
    docs = documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(docs.where("false")).count() == 0


def test_mix_as_sql(spark, small):
    got = queries.op7_source_mixing(spark, small).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(queries.OP7_SQL).df()
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    rows = lambda df: sorted(tuple(str(round(v, 4)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def _dealt(docs, **how):
    return sharding.shuffle_into_shards(docs, 8, **how)


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 200])
def test_shards(spark, bucket_bytes):
    rows = [*_rows(9), *[(None, f"t{i}", "en", "s") for i in range(50)]]
    docs = documents(spark, rows)
    got = _dealt(docs, bucket_bytes=bucket_bytes).collect()
    key = lambda i, t: (str(i), str(t))
    assert sorted(key(r["doc_id"], r["text"]) for r in got) == sorted(key(r[0], r[1]) for r in rows)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r[sharding.SHARD]].append(r[sharding.SLOT])
        of[r["doc_id"]].add((r[sharding.SHARD], r[sharding.GROWN]))
        assert r[sharding.GROWN] in (r[sharding.SHARD], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    assert {g for s in of.values() for _, g in s} > {8}
    again = _dealt(docs.repartition(5), bucket_bytes=bucket_bytes).collect()
    place = lambda r: (*key(r["doc_id"], r["text"]), r[sharding.SHARD], r[sharding.SLOT])
    assert sorted(map(place, again)) == sorted(map(place, got))


def test_one_more_shard_is_as_announced(spark):
    docs = documents(spark, [(i, f"t{i}", "en", "s") for i in range(400)])
    eight = {r["doc_id"]: r[sharding.GROWN] for r in _dealt(docs).collect()}
    nine = {r["doc_id"]: r[sharding.SHARD] for r in sharding.shuffle_into_shards(docs, 9).collect()}
    assert eight == nine


def test_order_inside_shards_is_random(spark):
    docs = documents(spark, [(i, f"t{i}", "en", "s") for i in range(3000)])
    rows = sorted(_dealt(docs).where(f"{sharding.SHARD} = 0").collect(), key=lambda r: r[sharding.SLOT])
    ids = [r["doc_id"] for r in rows]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.4 < rising < 0.6


def test_sharding_is_native(spark, small, tmp_path):
    dealt = queries.op9_sharding(spark, small)
    assert "Python" not in dealt._jdf.queryExecution().executedPlan().toString()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in dealt.collect():
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 40
    docs = documents(spark, [(i, "t", "en", "s") for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select(sharding.SHARD).distinct().count() == 4


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a", "en", "s")]).where("false")
    assert _dealt(docs).count() == 0


def test_many_equal_rows_are_split(spark):
    """A row repeated until it exceeds a bucket spreads over its shard; nothing is lost and slots have no gaps."""
    rows = [(7, "copy " * 20, "en", "a")] * 3000 + [(i, f"text {i} " * 5, "en", "b") for i in range(500)] + [(None, None, None, None)] * 50
    docs = documents(spark, rows)
    take = lambda df: sharding.shuffle_into_shards(df, 4, bucket_bytes=20_000)
    out = take(docs.repartition(5)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r[sharding.SHARD]].append(r[sharding.SLOT])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r[sharding.SHARD] for r in out if r["doc_id"] == 7}) == 1
    own = sorted(r[sharding.SLOT] for r in out if r["doc_id"] == 7)
    assert own[-1] - own[0] > 3000  # others stand among them
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r[sharding.SHARD], r[sharding.SLOT])
    assert sorted(map(key, out), key=str) == sorted(map(key, take(docs.repartition(3)).collect()), key=str)


def test_maps_and_long_texts(spark):
    docs = documents(spark, [(i, "long " * 40_000 if i == 3 else f"t{i}", "en", "s") for i in range(60)]).selectExpr("*", "map('a', doc_id) as extra")
    take = lambda n: sorted((r["doc_id"], r[sharding.SHARD], r[sharding.SLOT]) for r in sharding.shuffle_into_shards(docs.repartition(n), 3, bucket_bytes=2000).collect())
    assert take(2) == take(5) and len(take(2)) == 60
