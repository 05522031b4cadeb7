"""Closed forms against known values, rank sums and bins against plain computations."""

import random
from itertools import combinations

import pytest

from porewise.operators import binning, poi, stats, summary, twosample


def test_known_values():
    def g(values):
        n, m = len(values), sum(values) / len(values)
        m2, m3, m4 = (sum((v - m) ** k for v in values) / n for k in (2, 3, 4))
        return n, m3 / m2**1.5, m4 / m2**2 - 3

    assert stats.skew_score(*g([2, 8, 0, 4, 1, 9, 9, 0])[:2]) == pytest.approx(0.4462638537, abs=1e-9)
    assert stats.skew_score(*g(range(1, 9))[:2]) == pytest.approx(1.0108048609, abs=1e-9)
    n, _, excess = g(range(20))
    assert stats.kurtosis_score(n, excess) == pytest.approx(-1.7058104152, abs=1e-9)
    assert stats.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert stats.t_test_p(2, 0, 1, 2, 0, 1) == pytest.approx(1)
    # with 2 degrees of freedom the t distribution has a closed form
    t = 1.7
    assert stats.beta_cdf(1, 0.5, 2 / (2 + t * t)) == pytest.approx(1 - t / (2 + t * t) ** 0.5, abs=1e-12)
    assert stats.bartlett_p(10, 2.0, 12, 2.0) == pytest.approx(1)
    with pytest.raises(ValueError, match="fewer"):
        stats.normal_p(7, 0, 0)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 3), (4, 4), (3, 6)])
def test_exact_rank_test_counts_all_orders(n1, n2):
    places = range(1, n1 + n2 + 1)
    sums = [sum(c) for c in combinations(places, n1)]
    for w in set(sums):
        u = lambda s: s - n1 * (n1 + 1) / 2
        top = max(u(w), n1 * n2 - u(w))
        want = min(1, 2 * sum(u(s) >= top for s in sums) / len(sums))
        assert stats.mann_whitney_p(n1, n2, w, 0) == pytest.approx(want)


def test_rank_sums_with_ties(spark):
    random.seed(5)
    rows = [("m", random.randint(0, 1), random.choice([0.0, 0.1, 0.5, 1.0, random.random()])) for _ in range(200)] + [("m", 0, None)]
    (got,) = stats.rank_sums(spark.createDataFrame(rows, "metric string, grp int, value double"), [(0, 1)]).collect()
    values = sorted(v for _, _, v in rows if v is not None)
    rank = {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    assert got["rank_sum"] == pytest.approx(sum(rank[v] for _, g, v in rows if g == 0 and v is not None))
    assert got["ties"] == sum(values.count(v) ** 3 - values.count(v) for v in set(values))


def test_test_selection(spark):
    random.seed(6)
    rows = [("normal", g, random.gauss(g, 1)) for g in (0, 1) for _ in range(60)]
    rows += [("skewed", g, random.random() ** 6) for g in (0, 1) for _ in range(60)]
    rows += [("small", g, float(v)) for g in (0, 1) for v in range(5)] + [("alone", 0, float(v)) for v in range(9)]
    got = {r["metric"]: r for r in stats.compare_groups(spark.createDataFrame(rows, "metric string, grp int, value double"), False).collect()}
    assert {k: r["test"] for k, r in got.items()} == {"normal": "TT", "skewed": "MWU", "small": "ERROR", "alone": "ERROR"}
    assert got["normal"]["p"] < 0.01 and 0 <= got["skewed"]["p"] <= 1


@pytest.mark.parametrize(("n", "bins"), [(11, 3), (5, 9), (9, 9), (100, 7)])
def test_bins(spark, n, bins):
    random.seed(n)
    rows = [("c", s, random.random()) for s in random.sample(range(100_000), n)]
    got = binning.bin_means(spark.createDataFrame(rows, "chr string, site long, v double"), ["v"], bins).orderBy("bin").collect()
    values, at, want = [v for _, _, v in sorted(rows)], 0, []
    for i in range(min(n, bins)):
        size = n // bins + (i < n % bins) if n > bins else 1
        want.append(sum(values[at : at + size]) / size)
        at += size
    assert [r["v"] for r in got] == pytest.approx(want)


def test_two_samples(spark):
    def rep(errors, depth=50):
        return spark.createDataFrame([("c", s, depth, 0, 0.9 if s in errors else 0.1) for s in range(1, 7)], "chr string, site long, n_reads int, n_ref_skip int, mismatch_rate_alt double")

    a, b = [rep({1, 2, 5}), rep({1, 2, 6})], [rep({1, 3}), rep({1, 2, 3})]
    got = {(r["site"], r["name"]) for r in twosample.positions(a, b, "A", "B").collect()}
    assert got == {(1, "A_B"), (2, "A_excl"), (3, "B_excl")}  # 2: in error in only one replicate of B
    assert twosample.positions(a, [rep({1}, depth=10)], "A", "B").count() == 0
    with pytest.raises(ValueError, match="not one of"):
        twosample.positions(a, b, error_feature="q_mean")
    counts = {(r["name"], r["chr"]): r["n"] for r in twosample.count_table(twosample.positions(a, b, "A", "B")).collect()}
    assert counts[("A_B", None)] == counts[("A_B", "c")] == 1


def test_groups_and_categories(spark):
    rows = spark.createDataFrame([("c", 1, "A", "A", "psu"), ("c", 2, "A", "G", "psu"), ("c", 3, "A", "-", None), ("c", 4, "G", "G", "Am")], "chr string, site long, ref_base string, majority_base string, bed_name string")
    assert sorted((r["site"], r["grp"]) for r in poi.groups(rows, "psu", "A").collect()) == [(1, 0), (1, 1), (2, 2), (2, 3), (3, 3)]
    assert sorted((r["site"], r["grp"]) for r in poi.groups(rows, "psu").collect()) == [(1, 0), (2, 1)]
    assert poi.categories(rows, ["psu", "Am"], ["U", "A"]) == [("psu", "U"), ("Am", "A")]
    with pytest.raises(ValueError, match="no positions"):
        poi.categories(rows, ["Um"])
    with pytest.raises(ValueError, match="as many"):
        poi.categories(rows, ["psu"], [])


def test_confusion_of_nothing(spark):
    none = spark.createDataFrame([], "ref_base string, majority_base string")
    got = summary.confusion(none).collect()
    assert len(got) == 25 and all(r["n"] == 0 and r["percent"] is None for r in got)
