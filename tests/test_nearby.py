"""Covers, neighbours and runs of positions against plain loops; quantiles against sorted values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from porewise.operators import bed, binning, nearby, selection

BED = "chr string, start long, end long, name string"


def _intervals(seed, n=120, reach=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(-50, reach)
        rows.append((rng.choice("ab"), start, start + rng.choice([0, 1, 1, 2, 3, 30, 200]), rng.choice([None, "x", "y", f"n{i}"])))
    return rows + rows[:9] + [("a", 5, 3, "turned"), ("c", 0, 5000, "long")]


def _sites(spark, seed, reach=450):
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), rng.randrange(-60, reach), "kept", 1, 2) for _ in range(300)]
    return rows, spark.createDataFrame([*rows, (None, 5, "kept", 1, 2), ("a", None, "kept", 1, 2)], "chr string, site long, pos string, kind int, up int").repartition(4)


_first = lambda rows: min(rows, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or ""), default=None)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [7, 1 << 16])
def test_cover(spark, seed, size):
    """Ranges are disjoint, and each position has the first interval that holds it."""
    rows = _intervals(seed)
    got, where = {}, {}
    for r in bed.cover(spark.createDataFrame(rows, BED), "name", size=size).collect():
        for p in range(r["start"], r["end"]):
            assert (r["chr"], p) not in got
            got[r["chr"], p] = r["name"]
    for c, a, b, _ in rows:
        for p in range(a, b):
            where.setdefault((c, p), _first([r for r in rows if r[0] == c and r[1] <= p < r[2]])[3])
    assert got == where


def test_bits_of_wide_and_narrow_ranges(spark):
    rows = [("a", 0, 64, None), ("a", 127, 129, None), ("a", 200_000, 400_001, None), ("b", -65, -1, None), ("b", 63, 64, None)]
    held = {(c, p) for c, a, b, _ in rows for p in range(a, b)}
    words = {(r["chr"], r["word"]): r["bits"] for r in bed.position_bits(spark.createDataFrame(rows, BED)).collect()}
    assert {(c, w * 64 + i) for (c, w), bits in words.items() for i in range(64) if bits >> i & 1} == held


@pytest.mark.parametrize("seed", range(2))
def test_held_and_named(spark, seed):
    rows, (sites, df) = _intervals(seed), _sites(spark, seed)
    frame = spark.createDataFrame(rows, BED)
    found = lambda c, s: _first([r for r in rows if r[0] == c and r[1] < s <= r[2]])
    inside = [r[:2] for r in sites if found(*r[:2])]
    key = lambda r: (str(r[0]), str(r[1]))
    got = [tuple(r) for r in bed.include(df, frame).select("chr", "site").collect()]
    assert sorted(got, key=key) == sorted(inside, key=key)
    out = [tuple(r) for r in bed.exclude(df, frame).select("chr", "site").collect()]
    assert len(out) == len(sites) + 2 - len(inside) and not set(out) & set(inside)
    named = bed.annotate(df, frame)
    assert named.columns == [*df.columns, "bed_name"] and named.count() == len(sites) + 2
    assert all(r["bed_name"] == (found(r["chr"], r["site"]) or (None,) * 4)[3] for r in named.collect() if r["site"] is not None)


def test_no_product_inside_a_bin(spark):
    """A thousand intervals over each site: a site meets one range, not a thousand."""
    many = spark.range(1000).selectExpr("'a' as chr", "-id as start", "10 + id as end", "cast(id as string) as name")
    assert [tuple(r) for r in bed.cover(many, "name").collect()] == [("a", -999, 1009, "999")]
    assert bed._words(bed.cover(many)).where("word = 0").count() == 1
    rows = bed.annotate(spark.createDataFrame([("a", 5)], "chr string, site long"), many).collect()
    assert [r["bed_name"] for r in rows] == ["999"]


@pytest.mark.parametrize("size", [5, 64, 1 << 16])
def test_nearest_intervals(spark, size):
    rows, (sites, df) = _intervals(11, 60), _sites(spark, 4)
    got = nearby.nearest_intervals(df, spark.createDataFrame(rows, BED), size)
    assert got.columns == [*df.columns, "up_distance", "up_name", "down_distance", "down_name"]
    full = [r for r in rows if r[2] > r[1]]
    text = lambda n: (n is not None, n or "")
    want = []
    for c, s, *_ in sites:
        up = min((r for r in full if r[0] == c and r[2] < s), key=lambda r: (-r[2], -r[1], text(r[3])), default=None)
        down = min((r for r in full if r[0] == c and r[1] >= s), key=lambda r: (r[1], r[2], text(r[3])), default=None)
        want.append((c, s, up and s - up[2], up and up[3], down and down[1] + 1 - s, down and down[3]))
    found = [(r["chr"], r["site"], r["up_distance"], r["up_name"], r["down_distance"], r["down_name"]) for r in got.where("chr is not null and site is not null").collect()]
    assert sorted(map(str, found)) == sorted(map(str, want)) and got.count() == len(sites) + 2


def test_nearest_without_intervals_or_sites(spark):
    none = spark.createDataFrame([], BED)
    _, df = _sites(spark, 1)
    assert nearby.nearest_intervals(df, none).where("up_name is null and down_distance is null").count() == df.count()
    assert nearby.nearest_intervals(df.limit(0), none).count() == 0


@pytest.mark.parametrize(("size", "gap"), [(4, 1), (4, 3), (16, 40), (1 << 16, 2)])
def test_error_runs(spark, size, gap):
    rng = random.Random(size + gap)
    rows = [(rng.choice("ab"), rng.randrange(300), rng.choice([0.2, 0.5, 0.9, None])) for _ in range(500)]
    rows += [("long", i, 0.7) for i in range(1000)] + [("a", None, 0.9), (None, 3, 0.9)]
    intervals = _intervals(5, 40)
    got = nearby.error_runs(spark.createDataFrame(rows, "chr string, site long, mismatch_rate double").repartition(5), spark.createDataFrame(intervals, BED), gap=gap, size=size)
    wrong = {}
    for c, s, r in rows:
        if r is not None and r >= 0.5 and c and s is not None:
            wrong[c, s] = max(r, wrong.get((c, s), 0))
    runs = []
    for c, s in sorted(wrong):
        if runs and runs[-1][-1][0] == c and s - runs[-1][-1][1] <= gap:
            runs[-1].append((c, s))
        else:
            runs.append([(c, s)])
    held = lambda c, s: _first([r for r in intervals if r[0] == c and r[1] < s <= r[2]])
    want = []
    for run in runs:
        names = [held(*p) for p in run if held(*p)]
        want.append((run[0][0], run[0][1] - 1, run[-1][1], len(run), len(names), names[0][3] if names else None, max(wrong[p] for p in run)))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


# ------------------------------------------------------------------ quantiles


POINTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {
        "ratios": rng.integers(0, 50, 3000) / 50,
        "signs": rng.standard_normal(2500),
        "wide": np.concatenate([10.0 ** rng.uniform(-320, 308, 1000), -(10.0 ** rng.uniform(-320, 308, 1000)), [0.0, -0.0, 1.7e308, -1.7e308]]),
        "near": 1 + np.arange(5000) * 2.0**-52,
        "one": np.array([4.25]),
        "same": np.full(700, 0.1),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v), float(-v)) for k, x in groups.items() for v in x]
    rows += [(None, 5.0, 6.0), (None, None, 8.0), ("none", None, 1.0), ("none", float("nan"), None), ("ratios", float("nan"), None)]
    got = {r["g"]: r for r in selection.quantiles(spark.createDataFrame(rows, "g string, v double, w double").repartition(6), ["v", "w"], POINTS, ["g"]).collect()}
    for k, x in groups.items():
        for name, sign in (("v", 1), ("w", -1)):
            at = np.array(POINTS) * (len(x) - 1)
            s, low = np.sort(sign * x), np.floor(at).astype(int)
            want = s[low] * (1 - (at - low)) + s[np.ceil(at).astype(int)] * (at - low)
            assert got[k][name] == pytest.approx(want.tolist(), rel=1e-15, abs=0), (k, name)
    assert got["ratios"]["n"] == 3001 and got[None]["v"] == [5.0] * 7 and got[None]["w"][0] == 6.0
    assert got["none"]["v"] is None and got["none"]["w"] == [1.0] * 7 and got["none"]["n"] == 2


def test_quantiles_of_all_rows_and_of_none(spark):
    rows = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in binning.box(rows, ["v"]).collect()] == [([0.0, 25.0, 50.0, 75.0, 100.0],)]
    assert binning.box(rows.limit(0).withColumn("g", F.lit(1)), ["v"], ["g"]).count() == 0


def test_many_values_in_one_group(spark, tmp_path):
    """Ten million different values: few passes, each over a fraction of the rows of the one before."""
    n = 10_000_000
    spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 6_364_136_223, F.lit(n)) / 7 + 1).alias("value")).write.parquet(str(tmp_path / "values"))
    values, passes = spark.read.parquet(str(tmp_path / "values")), []
    ranks = spark.createDataFrame([("g", 0), ("g", n // 2), ("g", n - 1)], "g string, rank long")
    got = {r["rank"]: r["value"] for r in selection.select_ranks(values, ranks, ["g"], passes).collect()}
    assert got == {k: k / 7 + 1 for k in (0, n // 2, n - 1)}
    assert len(passes) <= 5 and passes[1] <= n / 1000
