"""Every stage of the pipeline against a plain computation over what the stage before it kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from porewise.llm import mixing, toxicity
from porewise.llm.common import fold

from .helpers import components, shingles, similar_pairs
from .test_decontaminate import _least, _words


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The smallest tables, with a leak and some odd rows added."""
    out = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000 or text is null")
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = [(10**6 + i, t, "en", s, 0) for i, (t, s) in enumerate([(None, "s"), ("", None), (f"Before it. {item} After it.", "s"), ("x y", "s"), ("x y", "s")])]
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sharding":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/stage-{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/stage-{name}")
        kept[name] = (before, docs)
    assert list(stages) == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]

    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(before.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    scores = before.select("doc_id", toxicity.toxicity(before, model).alias("s")).collect()
    assert ids(after) == Counter(r["doc_id"] for r in scores if r["s"] < 0.5)

    before, after = kept["ngram_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.orderBy("doc_id").collect()]
    sets = [shingles(t) for _, t in rows]
    root = components(len(rows), similar_pairs(sets))
    assert ids(after) == Counter(rows[i][0] for i in range(len(rows)) if root[i] == i)

    before, after = kept["decontamination"]
    items = [_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items = [(set(w), w, int(0.15 * len(w))) for w in items if len(w) >= 8]
    clean = Counter()
    for r in before.collect():
        w = _words(r["text"])
        there = set(w)
        if not any(len(s - there) <= k and _least(i, w) <= k for s, i, k in items):
            clean[r["doc_id"]] += 1
    assert ids(after) == clean
    assert 10**6 + 2 not in clean

    before, after = kept["mixing"]
    taken = {r["id"]: round(r["taken"] / r["size"]) if r["size"] else 0 for r in mixing.mix(before).collect()}
    assert ids(after) == Counter({i: n for i, n in taken.items() if n})

    before, after = kept["sharding"]
    assert ids(before) == ids(after)
    slots = {}
    for r in after.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_run(spark, folder):
    first = corpus_pipeline.run(spark, folder)
    assert first.columns[-2:] == ["shard", "slot"]
    assert Counter(r["doc_id"] for r in first.collect()) == Counter(r["doc_id"] for r in spark.read.parquet(f"{folder}/stage-sharding").collect())


def test_repeated_and_null_ids(spark, small):
    """Rows, not identifiers, are copies of each other."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(12))
    rows = [(7, text("a")), (7, text("a")), (None, text("b")), (None, text("b")), (9, text("c")), (3, text("c")), (9, text("d")), (None, text("e")), (5, text("e")), (None, text("f")), (4, None), (4, None), (8, text("g")), (8, text("h"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), small)
    want = [(7, "a"), (None, "b"), (3, "c"), (9, "d"), (5, "e"), (None, "f"), (4, None), (4, None), (8, "g"), (8, "h")]
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((i, k and text(k)) for i, k in want)


def test_empty_table_and_odd_rows(spark, small, tmp_path):
    """No documents, and documents with nulls in any column and clashing columns, pass all stages."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, rows in (("empty", docs.where("false")), ("odd", docs.limit(20).selectExpr("*", "'x' as __row", "'y' as mark").unionByName(spark.range(6).selectExpr("cast(null as long) as doc_id", "case when id > 2 then concat('same words here for all of us ', cast(id % 2 as string)) end as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars", "cast(null as string) as __row", "'z' as mark")))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{small}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), allowMissingColumns=True).write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None)], "item_id long, text string"), allowMissingColumns=True).write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [*rows.columns, "shard", "slot"]
        got = out.collect()
        assert bool(got) == (name == "odd")
        if got:
            assert {r["text"] for r in got if r["doc_id"] is None} <= {"same words here for all of us 0", "same words here for all of us 1"}


def test_values_of_clashing_columns(spark, small):
    """Columns that are called as internal ones are, or have dots in their names, keep their values in all stages."""
    names = ["__row", "row", "shard", "slot", "__shard", "__slot", "a.b", "C0", "record", "times"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(25)
    docs = docs.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, small), name)
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard_", "slot_"])
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)
    assert sorted(r["slot_"] for r in rows if r["shard_"] == rows[0]["shard_"])[0] == 0
