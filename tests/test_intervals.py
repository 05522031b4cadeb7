"""Interval operations on the small fixtures, and against sets on random intervals."""

import random

import pytest

from porewise.operators import bed, filtering
from porewise.sources import text


def _bed(spark, tmp_path, name, lines):
    (tmp_path / name).write_text("".join(line.replace(" ", "\t") + "\n" for line in lines))
    return text.read_bed(spark, str(tmp_path / name))


@pytest.fixture
def ab(spark, tmp_path):
    return _bed(spark, tmp_path, "a.bed", ["c1 1 3 x", "c1 5 6 y"]), _bed(spark, tmp_path, "b.bed", ["c1 2 4 z", "c1 5 6 w", "c2 0 1 v"])


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([("c1", s) for s in range(1, 8)], "chr string, site long")


def _rows(df):
    return sorted(tuple(r) for r in df.select("chr", "start", "end", "name").collect())


def test_merge(ab):
    assert _rows(bed.merge(list(ab))) == [("c1", 1, 2, "x"), ("c1", 2, 3, "x,z"), ("c1", 3, 4, "z"), ("c1", 5, 6, "y,w"), ("c2", 0, 1, "v")]


def test_difference(ab):
    assert _rows(bed.difference(*ab)) == [("c1", 1, 2, "x")]
    assert _rows(bed.difference(*ab, compat=True)) == [("c1", 2, 3, "x"), ("c1", 5, 6, "y")]


def test_intersect(ab):
    assert _rows(bed.intersect(*ab, "A", "B")) == [("c1", 1, 3, "A"), ("c1", 2, 4, "B"), ("c1", 5, 6, "A+B"), ("c2", 0, 1, "B")]


def test_annotate(ab, sites):
    got = {r["site"]: r["bed_name"] for r in bed.annotate(sites, ab[0]).collect()}
    assert got == {1: None, 2: "x", 3: "x", 4: None, 5: None, 6: "y", 7: None}


def test_include_and_exclude(ab, sites):
    keep = lambda **how: sorted(r["site"] for r in filtering.filter_features(sites, **how).collect())
    assert keep(filter_bed=ab[0]) == [2, 3, 6]
    assert keep(filter_bed=ab[0], compat=True) == [2, 6]
    assert keep(exclude_bed=ab[0]) == [1, 4, 5, 7]
    assert keep(filter_bed=ab[0], exclude_bed=ab[1]) == [2, 3, 6]


def test_add_info(ab, sites):
    got = lambda **how: {r["site"]: r["bed_col_1"] for r in bed.add_info(sites, ab[0], 1, **how).collect() if r["bed_col_1"]}
    assert got() == {2: "x", 6: "y"}
    assert got(compat=True) == {1: "x", 5: "y"}


def test_to_bed(sites):
    assert [tuple(r) for r in bed.to_bed(sites).where("start = 5").collect()] == [("c1", 5, 6)]


def test_wide_and_overlapping_intervals(spark):
    random.seed(4)
    spans = [(random.choice("ab"), s := random.randint(0, 5000), s + random.choice([0, 1, 3, 900, 4000]), f"n{i}") for i in range(40)]
    intervals = spark.createDataFrame(spans, "chr string, start long, end long, name string")
    features = spark.createDataFrame([(c, s) for c in "abc" for s in range(1, 9000, 7)], "chr string, site long")
    for r in bed.annotate(features, intervals).collect():
        inside = [(s, e, n) for c, s, e, n in spans if c == r["chr"] and s < r["site"] <= e]
        assert r["bed_name"] == (min(inside)[2] if inside else None)


def test_lines_that_are_not_intervals(spark, tmp_path):
    rows = _bed(spark, tmp_path, "odd.bed", ["c1 1", "c1 a 2", "", "c1 1 2", "c1 1 2 n e1 e2"])
    assert [(r["name"], r["extras"]) for r in rows.orderBy("line").collect()] == [(None, []), ("n", ["n", "e1", "e2"])]


def test_empty(spark):
    none = spark.createDataFrame([], "chr string, start long, end long, name string, line long")
    assert bed.merge([none, none]).count() == bed.difference(none, none).count() == bed.intersect(none, none, "a", "b").count() == 0


def test_whole_chromosome(spark, sites):
    """An interval of 248 million bases is never opened into one array."""
    wide = spark.createDataFrame([("c1", 0, 248_000_000, "all", [], 0, 0)], "chr string, start long, end long, name string, extras array<string>, file int, line long")
    assert bed.include(sites, wide).count() == 7 and bed.exclude(sites, wide).count() == 0
    assert bed.annotate(sites, wide).where("bed_name = 'all'").count() == 7
    assert bed.single_bases(wide).where("start > 200000000").limit(3).count() == 3


def test_borders_of_bins(spark):
    spots = [(0, 1), (1023, 1025), (1024, 1025), (2047, 2048), (2048, 4096), (5, 5)]
    rows = spark.createDataFrame([("c1", a, b, "n", [], 0, i) for i, (a, b) in enumerate(spots)], "chr string, start long, end long, name string, extras array<string>, file int, line long")
    want = {s for a, b in spots for s in range(a + 1, b + 1)}
    features = spark.createDataFrame([("c1", s) for s in range(4200)], "chr string, site long")
    assert {r["site"] for r in bed.include(features, rows).collect()} == want == {r["site"] for r in bed.position_set(rows).collect()}
    assert {r["site"] for r in bed.exclude(features, rows).collect()} == set(range(4200)) - want
    assert {r["site"] for r in bed.annotate(features, rows).where("bed_name is not null").collect()} == want
