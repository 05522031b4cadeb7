"""What grows with the input: no row is decoded over and over, and no task gets a whole part."""

import re

import pytest
from pyspark.sql import functions as F

from porewise.operators import binning, neighbours, poi, stats, stretches, summary
from porewise.plans import queries as core
from porewise.plans import stream_queries, text_queries
from porewise.sources import text


@pytest.mark.parametrize("name", ["extract_features", "extract_thresholds", "extract_unknown"])
def test_conditions_do_not_decode_again(spark, small, name):
    plan = core.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4


def test_reference_in_stretches(spark, small):
    rows = text_queries._reference(spark, small).where("chr = 'chr1'")
    assert "offset" in rows.columns
    got = rows.agg(F.sum(F.length("seq")).alias("bases"), F.max("length").alias("length")).first()
    assert got["bases"] == got["length"]


def test_parts_of_a_stream_come_in_many_files(spark):
    rows = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 2).alias("part"))
    seen = stream_queries._arriving(rows, "parts", "part", 2, lambda s: s.select("id", F.input_file_name().alias("file")))
    assert sorted(r["id"] for r in seen.collect()) == list(range(400))
    assert seen.select("file").distinct().count() == 8


def test_cube_tells_slots_apart_after_the_join(spark, small):
    plan = core.QUERIES["position_cube"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(sample|replicate)", plan)


def test_totals_over_blocks_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(stretches, "BLOCK", 3)
    places = [0, 1, 2, 5, 6, 11, 12, 13, 30]
    rows = spark.createDataFrame([(c, n, n * 7 % 10) for c in "ab" for n in places], f"chr string, {stretches.NAME} long, v int")
    got = stretches.totals(rows, most=(F.max("v"), F.max, 1), least=(F.min("v"), F.min, -1)).collect()
    value = lambda of, ns: of((n * 7 % 10 for n in ns), default=None)
    want = [(c, n, value(max, [m for m in places if m < n]), value(min, [m for m in places if m > n])) for c in "ab" for n in places]
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_bins_number_rows_at_their_ends_only(spark, monkeypatch):
    """A stretch within one bin counts by its sums: of 30,000 rows in two groups, those of six stretches are numbered."""
    rows = spark.range(30_000).selectExpr("concat('c', id % 3) as chr", "id * 7 % 30011 as site", "id % 2 as g", "case when id % 5 > 0 then id % 11 / 3 end as v")
    seen, means = [], binning.means
    monkeypatch.setattr(binning, "means", lambda stretches, border, *how: seen.append(border) or means(stretches, border, *how))
    monkeypatch.setattr(binning, "placed", lambda df, placed=binning.placed: placed(df, 512))
    got = {(r["g"], r["bin"]): r["v"] for r in binning.bin_means(rows, ["v"], 4, ["g"]).collect()}
    want = rows.selectExpr("g", "v", "ntile(4) over (partition by g order by chr, site) - 1 as bin").groupBy("g", "bin").agg(F.avg("v")).collect()
    assert got == pytest.approx({(g, b): v for g, b, v in want})
    assert 0 < seen[0].agg(F.sum("n")).first()[0] <= 6 * 512


def test_stretches_lie_together(spark, small):
    """Sums of stretches need no shuffle of rows; rows without a place are in no bin."""
    features = core.ad.features(spark, small)
    placed = binning.placed(features.select("chr", "site"), 64).withColumn("part", F.spark_partition_id())
    assert placed.groupBy("chr", "stretch").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    rows = spark.createDataFrame([(None, 1, 1.0), ("c", None, 2.0), ("c", 3, 3.0)], "chr string, site long, v double")
    assert [tuple(r) for r in binning.bin_means(rows, ["v"], 5).collect()] == [(0, 3.0)]


def test_summary_shuffles_lines_once(spark, small, monkeypatch):
    """Lines are brought together by stretch before they are added up, so the features of a stretch need no shuffle of their own."""
    plans, write = {}, summary.materialize
    monkeypatch.setattr(summary, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    core.QUERIES["summary_sizes"](spark, small)
    assert plans["summary-rows"].count("Exchange hashpartitioning") == 1
    plain, lying = core.ad.features(spark, small), core.ad.features(spark, small, stretch=64)
    assert lying.drop("stretch").columns == plain.columns and lying.drop("stretch").exceptAll(plain).count() == plain.exceptAll(lying.drop("stretch")).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would be put together
    try:
        parts = lying.withColumn("part", F.spark_partition_id()).groupBy("chr", "stretch").agg(F.countDistinct("part").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(parts) > 100 and all(r["n"] == 1 for r in parts)


def test_rows_of_whole_stretches_are_not_sent_to_groupings(spark, monkeypatch):
    """Where no bin ends in a stretch, its rows stay where they are: of 20,001 rows, those of one stretch go to the groupings."""
    rates = ", ".join(f"id % 7 / 8 as {r}" for r in summary.error_rates())
    rows = spark.range(20_001).selectExpr("'c' as chr", "id as site", "id % 50 as n_reads", "id % 40 / 2 as q_mean", "'A' as ref_base", "'C' as majority_base", "'AAACU' as motif", *rates.split(", "))
    sent, of = [], summary._of_groupings
    monkeypatch.setattr(summary, "_of_groupings", lambda df, *columns: sent.append(df) or of(df, *columns))
    monkeypatch.setattr(binning, "placed", lambda df, placed=binning.placed: placed(df, 256))
    found = summary.summarise(rows, 2)
    want = [(b, pytest.approx(sum(i % 50 for i in ids) / len(ids)), pytest.approx(sum(i % 40 / 2 for i in ids) / len(ids))) for b, ids in enumerate((range(10_001), range(10_001, 20_001)))]
    assert sorted(map(tuple, found["general"].collect())) == want and found["by_motif"].count() == found["by_mismatch"].count() == 2
    assert sent[1].count() == 256


def test_points_of_interest_need_few_columns(spark, small, monkeypatch):
    """No table of the analysis has a row for each site and metric, or columns that no dataset uses."""
    written, write = {}, poi.materialize
    for module in (poi, stats):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.setdefault(name, write(df, name)) if name not in written else write(df, name))
    core.QUERIES["poi_analyse"](spark, small)
    assert not {"n_a", "motif", "n_reads"} & set(written["poi-annotated"].columns) and "poi-rates" not in written
    assert written["value-counts"].groupBy("metric", "grp", "value").count().where("count > 1").count() == 0


def test_moments_of_counted_values(spark):
    rows = spark.range(500).selectExpr("'m' as metric", "cast(id % 2 as int) as grp", "1e6 + pow(id % 23, 3) as value")
    want = rows.groupBy("grp").agg(F.count("value"), F.avg("value"), F.var_samp("value"), F.skewness("value"), F.kurtosis("value")).collect()
    got = stats.moments(stats.value_counts(rows)).select("grp", "n", "mean", "variance", "skewness", "kurtosis").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {r[0]: pytest.approx(tuple(r[1:])) for r in want}
    (same,) = stats.moments(stats.value_counts(rows.selectExpr("metric", "grp", "0.1D as value").where("grp = 0").limit(7).unionAll(rows.selectExpr("metric", "0", "0.1D").limit(3)))).collect()
    assert (same["n"], same["mean"], same["variance"], same["skewness"], same["kurtosis"]) == (10, 0.1, 0.0, None, None)


@pytest.mark.parametrize("k", [0, 1, 2, 31, 32])
def test_neighbours_as_bits(spark, k):
    """Positions in error as bits of a window say the same as sets of them, over borders of stretches and with repeated sites."""
    sites = [(i * i + i // 3) % 400 - 40 for i in range(260)]
    rows = [(s, 0.5 if s % 3 else 0.1) for s in sites]
    got = neighbours.with_neighbour_errors(spark.createDataFrame(rows, "site long, mismatch_rate double").selectExpr("'c' as chr", "*"), k, stretch=70).collect()
    near = lambda s: sorted({t - s for t, m in rows if m >= 0.5 and 0 < abs(t - s) <= k})
    assert len(got) == len(rows) and all(r["neighbour_error_pos"] == near(r["site"]) for r in got)


def test_numbering_leaves_lines_where_they_are(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    spark.range(50).selectExpr("cast(id as string) as value").repartition(5).write.text(path)
    plan = text.number_lines(text.read_feature_lines(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_features_through_compressed_text(spark, small, tmp_path):
    path = f"file://{tmp_path}/features"
    rows = core.ad.features(spark, small).withColumns({"q_std": F.lit(1.5), "neighbour_error_pos": F.array(F.lit(-1), F.lit(2))})
    text.write_features(rows, path, compression="gzip")
    parts = sorted(p.name for p in (tmp_path / "features").glob("part-*"))
    assert parts and all(p.endswith(".txt.gz") for p in parts)
    found = text.read_features(spark, path).drop("replicate")
    assert found.exceptAll(rows.select(*[F.col(c).cast(found.schema[c].dataType) for c in found.columns])).count() == 0 and found.count() == rows.count()
