"""The grammar of filters and regions."""

import pytest

from porewise.functions import conditions as c
from porewise.functions import labels
from porewise.operators import filtering
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i / 10, "ACGU"[i % 4], "GCAU-"[i % 5]) for i in range(12)], "site long, rate double, ref_base string, majority_base string")


@pytest.mark.parametrize(("text", "test"), [("10", lambda v: v >= 10), (">=3", lambda v: v >= 3), ("<=5", lambda v: v <= 5), ("==3", lambda v: v == 3), (">0", lambda v: v > 0), ("<7", lambda v: v < 7)])
def test_comparison(rows, text, test):
    assert {r["site"] for r in rows.where(c.comparison("site", text, whole=True)).collect()} == {v for v in range(12) if test(v)}


@pytest.mark.parametrize("text", ["", "x", "=>3", "1.5", "3 4"])
def test_no_comparison(text):
    with pytest.raises(ValueError, match="not a condition"):
        c.comparison("site", text, whole=True)


@pytest.mark.parametrize(("text", "want"), [("5", {5}), ("1,3,9", {1, 3, 9}), ("3-7", {3, 4, 5, 6, 7}), ("7-3", set(range(12)))])
def test_sites(rows, text, want):
    assert {r["site"] for r in rows.where(c.sites(text)).collect()} == want


def test_bases_and_mismatch_types(rows):
    assert {r["ref_base"] for r in rows.where(c.bases("A,C")).collect()} == {"A", "C"}
    with pytest.raises(ValueError, match="not bases"):
        c.bases("A,x")
    pairs = {(r["ref_base"], r["majority_base"]) for r in rows.where(c.mismatch_types("A-G,C-C")).collect()}
    assert pairs == {("A", "G"), ("C", "C")}
    assert rows.where(c.mismatch_types("A-G,C-C", all_of=True)).count() == 0


def test_regions(spark):
    sites = spark.createDataFrame([("c1", s) for s in range(1, 11)] + [("c2", 1)], "chr string, site long")
    keep = lambda text: [r["site"] for r in sites.where(c.region(text, {"c1": 10})).collect()]
    assert keep("c1:2-4") == [2, 3, 4]
    assert len(keep("c1")) == 10
    for bad in ("c1:1,0-5", "c1:3-3", "c1:0-4", "c1:4-11", "c2"):
        with pytest.raises(ValueError):
            c.region(bad, {"c1": 10})


def test_all_conditions_together(spark):
    rows = spark.createDataFrame([("c", 5, 10, "A", "G", 0.6, 0.7, 0.1, 0.0, 0.0, "AAACG", 31.0), ("c", 6, 10, "A", "A", 0.6, 0.7, 0.1, 0.0, 0.0, "AAACG", 31.0)], "chr string, site long, n_reads int, ref_base string, majority_base string, mismatch_rate double, mismatch_rate_alt double, deletion_rate double, insertion_rate double, refskip_rate double, motif string, q_mean double")
    how = {"chrom": "c", "site": "1-9", "n_reads": "10", "base": "A", "mismatched": True, "mismatch_types": "A-G", "mismatch_rate": ">0.5", "mismatch_rate_alt": "0.7", "deletion_rate": "<=0.1", "insertion_rate": "==0", "refskip_rate": "<1", "motif": "aaacg", "q_score": ">30.5"}
    assert [r["site"] for r in filtering.filter_features(rows, **how).collect()] == [5]


def test_chromosome_order_and_neighbour_text(spark):
    rows = spark.createDataFrame([(x,) for x in ("X", "10", "2", "chr1", "1")], "chr string")
    assert [r[0] for r in rows.orderBy(*labels.chromosome_order()).collect()] == ["1", "2", "10", "X", "chr1"]
    texts = spark.createDataFrame([("-2,1,",), ("",), (None,), ("3",)], "t string")
    back = texts.select(labels.decode_neighbours(F.col("t")).alias("a")).select("a", labels.encode_neighbours(F.col("a")).alias("t"))
    assert [tuple(r) for r in back.collect()] == [([-2, 1], "-2,1,"), (None, ""), (None, ""), ([3], "3,")]
