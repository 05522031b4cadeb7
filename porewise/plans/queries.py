"""Queries over whole tables for the operators, and SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import pileup as p
from ..operators import bed, binning, extractor, filtering, nearby, neighbours, poi, possummary, sketches, stats, summary, topk, twosample
from ..sources.storage import materialize
from . import adapters as ad
from .registry import QUERIES, SQL  # noqa: F401 - all queries, for callers
from .registry import query as _query

RATES = ("mismatch_rate", "deletion_rate", "insertion_rate", "refskip_rate")
CATEGORY, COUNTERPART, BINS = "1-URGENT", "C", 500


# ------------------------------------------------------------------ extraction


_PLAIN = "chr site n_reads ref_base majority_base n_a n_c n_g n_u n_del n_ins n_ref_skip".split()
_RATES = "a_rate c_rate g_rate u_rate deletion_rate insertion_rate refskip_rate mismatch_rate mismatch_rate_alt".split()


@_query(f"select {', '.join(_PLAIN)}, {', '.join(f'round({c}, 9) as {c}' for c in _RATES)} from f")
def feature_table(spark, sf_dir):
    return ad.features(spark, sf_dir).select(*_PLAIN, *(F.round(c, 9).alias(c) for c in _RATES))


@_query(
    r"""select chr, count(*) as n_rows, sum(ac) as n_a, sum(tc) as n_u, sum(dots) as n_match, sum(dels) as n_del, sum(skips) as n_ref_skip, sum(ins) as n_ins from (
      select chr, len(core) - len(replace(core, 'a', '')) as ac, len(core) - len(replace(core, 't', '')) as tc,
             len(core) - len(replace(core, '.', '')) + len(core) - len(replace(core, ',', '')) as dots, len(x) - len(replace(x, '*', '')) as dels,
             len(core) - len(replace(core, '>', '')) as skips, len(regexp_extract_all(x, '\+[0-9]+[acgtn]+')) as ins from (
        select chr, x, array_to_string(list_transform(string_split(regexp_replace(x, '([+-][0-9])', chr(1) || '\1', 'g'), chr(1)), lambda c:
               case when regexp_matches(c, '^[+-][0-9]+') then substr(c, 2 + len(regexp_extract(c, '^[+-]([0-9]+)', 1)) + regexp_extract(c, '^[+-]([0-9]+)', 1)::int) else c end), '') as core
        from (select concat('chr', cast(l_linenumber as varchar(4))) as chr, regexp_replace(lower("""
    + ad.BASES_TEXT
    + r"""), '\^.', '', 'g') as x from lineitem))) group by chr"""
)
def pileup_decode(spark, sf_dir):
    rows = ad.pileup(spark, sf_dir).withColumn("ref_base", F.lit("N"))
    match = F.length("core") - F.length(F.translate("core", ".,", ""))
    rows = rows.withColumn("x", p.without_starts(F.col("bases"))).withColumn("core", p.without_indels(F.col("x")))
    rows = rows.withColumn("match", match).withColumns(p.base_counts(F.col("x"), F.col("core"), F.col("ref_base")))
    sums = {"n_a": "n_a", "n_u": "n_u", "n_match": "match", "n_del": "n_del", "n_ref_skip": "n_ref_skip", "n_ins": "n_ins"}
    return rows.groupBy("chr").agg(F.count("*").alias("n_rows"), *(F.sum(c).alias(n) for n, c in sums.items()))


@_query(
    """select chr, count(*) as n_rows, round(avg(m), 9) as q_mean, round(avg(s), 9) as q_std from (
      select concat('chr', cast(l_linenumber as varchar(4))) as chr, (a * 40.0 + b * 20.0)::double / (a + b) as m,
             sqrt(((a + b) * (a * 1600 + b * 400) - (a * 40 + b * 20) * (a * 40 + b * 20))::double) / (a + b) as s
      from (select l_linenumber, l_quantity::bigint as a, l_linenumber::bigint as b from lineitem)) group by chr"""
)
def pileup_quality(spark, sf_dir):
    """The skips of these rows lie behind the last quality, so all qualities are kept."""
    rows = extractor.decode(ad.pileup(spark, sf_dir))
    return rows.groupBy("chr").agg(F.count("*").alias("n_rows"), F.round(F.avg("q_mean"), 9).alias("q_mean"), F.round(F.avg("q_std"), 9).alias("q_std"))


@_query(
    """select chr, site, coalesce(array_to_string(list_sort(list_filter(w, lambda d: d <> 0)), ','), '') as neighbour_error_pos from (
      select chr, site, list(case when mismatch_rate >= 0.5 then site end) over (partition by chr order by site range between 2 preceding and 2 following) as l from f)
      cross join lateral (select list_transform(list_filter(l, lambda z: z is not null), lambda z: z - site) as w)"""
)
def neighbour_errors(spark, sf_dir):
    found = neighbours.with_neighbour_errors(ad.features(spark, sf_dir))
    return found.select("chr", "site", F.array_join(F.col("neighbour_error_pos").cast("array<string>"), ",").alias("neighbour_error_pos"))


@_query(SQL["neighbour_errors"].split("from orders) ", 1)[1])
def neighbour_errors_window(spark, sf_dir):
    """The same with stretches so short that most rows are near a border."""
    found = neighbours.with_neighbour_errors(ad.features(spark, sf_dir), stretch=8)
    return found.select("chr", "site", F.array_join(F.col("neighbour_error_pos").cast("array<string>"), ",").alias("neighbour_error_pos"))


# ------------------------------------------------------------------ filters

_FILTERS = {
    "filter_n_reads": ({"n_reads": "100"}, "n_reads >= 100"),
    "filter_mismatch_rate": ({"mismatch_rate": ">0.25"}, "mismatch_rate > 0.25"),
    "filter_mismatch_rate_alt": ({"mismatch_rate_alt": "<=0.5"}, "mismatch_rate_alt <= 0.5"),
    "filter_deletion_rate": ({"deletion_rate": "0.05"}, "deletion_rate >= 0.05"),
    "filter_insertion_rate": ({"insertion_rate": "<0.02"}, "insertion_rate < 0.02"),
    "filter_refskip_rate": ({"refskip_rate": "==0"}, "refskip_rate = 0"),
    "filter_q_score": ({"q_score": ">=30"}, "q_mean >= 30"),
    "filter_chromosome": ({"chrom": "chr3"}, "chr = 'chr3'"),
    "filter_site_range": ({"site": "100-900"}, "site between 100 and 900"),
    "filter_site_list": ({"site": "1,3,9,700"}, "site in (1, 3, 9, 700)"),
    "filter_bases": ({"base": "A,U"}, "ref_base in ('A', 'U')"),
    "filter_mismatched": ({"mismatched": True}, "majority_base <> ref_base"),
    "filter_mismatch_types": ({"mismatch_types": "A-G,C-U"}, "(ref_base = 'A' and majority_base = 'G') or (ref_base = 'C' and majority_base = 'U')"),
    "filter_motif": ({"motif": "acgun"}, "motif = 'ACGUN'"),
    "filter_all": ({"chrom": "chr1", "n_reads": ">20", "mismatched": True, "mismatch_rate": "0.4", "base": "A,C,G"}, "chr = 'chr1' and n_reads > 20 and majority_base <> ref_base and mismatch_rate >= 0.4 and ref_base in ('A', 'C', 'G')"),
}


def _filter(name: str, settings: dict, where: str) -> None:
    def run(spark, sf_dir):
        return filtering.filter_features(ad.features(spark, sf_dir), **settings).select("chr", "site", "n_reads", "ref_base", "majority_base")

    run.__name__ = name
    _query(f"select chr, site, n_reads, ref_base, majority_base from f where {where}")(run)


for _name, (_settings, _where) in _FILTERS.items():
    _filter(_name, _settings, _where)


@_query("select chr, site, n_reads from f where exists (select 1 from bed b where b.chr = f.chr and b.start < f.site and f.site <= b.\"end\")")
def filter_bed(spark, sf_dir):
    return filtering.filter_features(ad.features(spark, sf_dir), filter_bed=ad.intervals(spark, sf_dir)).select("chr", "site", "n_reads")


@_query("select chr, site, n_reads from f where not exists (select 1 from bed b where b.chr = f.chr and b.start < f.site and f.site <= b.\"end\")")
def exclude_bed(spark, sf_dir):
    return filtering.filter_features(ad.features(spark, sf_dir), exclude_bed=ad.intervals(spark, sf_dir)).select("chr", "site", "n_reads")


# ------------------------------------------------------------------ intervals


@_query("select chr, site - 1 as start, site as \"end\" from f")
def bed_from_features(spark, sf_dir):
    return bed.to_bed(ad.features(spark, sf_dir))


_NAMED = """n as (select f.chr, f.site, arg_min(b.name, struct_pack(s := b.start, e := b."end", n := b.name)) as bed_name
  from f join bed b on b.chr = f.chr and b.start < f.site and f.site <= b."end" group by f.chr, f.site),
 a as (select f.*, n.bed_name from f left join n on f.chr = n.chr and f.site = n.site)"""


@_query(f"x as (select 1), {_NAMED} select chr, site, bed_name from a")
def bed_annotate(spark, sf_dir):
    return bed.annotate(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir)).select("chr", "site", "bed_name")


@_query("select f.chr, f.site, b.name as bed_col_1, b.o_custkey::varchar as bed_col_2 from f left join bed b on f.chr = b.chr and f.site = b.start + 1")
def bed_add_info(spark, sf_dir):
    return bed.add_info(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir), 2).select("chr", "site", "bed_col_1", "bed_col_2")


_HALVES = "a as (select distinct chr, start, \"end\" from bed where o_custkey % 5 < 3), b as (select distinct chr, start, \"end\" from bed where o_custkey % 5 > 1)"


def _halves(spark, sf_dir):
    rows = ad.intervals(spark, sf_dir)
    return rows.where("o_custkey % 5 < 3"), rows.where("o_custkey % 5 > 1")


@_query(f"x as (select 1), {_HALVES} select chr, start, \"end\", case when a.chr is null then 'B' when b.chr is null then 'A' else 'A+B' end as name from a full join b using (chr, start, \"end\")")
def bed_intersect(spark, sf_dir):
    return bed.intersect(*_halves(spark, sf_dir), "A", "B")


_POINTS = "a as (select chr, unnest(range(start, \"end\")) as start, name, o_orderkey as line from bed where o_custkey % 5 < 3), b as (select chr, unnest(range(start, \"end\")) as start, name, o_orderkey as line from bed where o_custkey % 5 > 1)"


@_query(f"x as (select 1), {_POINTS} select chr, start, start + 1 as \"end\", string_agg(name, ',' order by file, line, name) as name from (select *, 0 as file from a union all select *, 1 from b) group by chr, start")
def bed_merge(spark, sf_dir):
    return bed.merge(list(_halves(spark, sf_dir)))


@_query(f"x as (select 1), {_POINTS} select chr, start, start + 1 as \"end\", arg_max(name, line) as name from a where not exists (select 1 from b where a.chr = b.chr and a.start = b.start) group by chr, start")
def bed_difference(spark, sf_dir):
    return bed.difference(*_halves(spark, sf_dir))


_NEAREST = """x as (select 1), u as (select chr, "end" as e, arg_min(name, struct_pack(s := -start, n := name)) as name from bed group by chr, "end"),
  d as (select chr, start + 1 as s, arg_min(name, struct_pack(e := "end", n := name)) as name from bed group by chr, start)
  select f.chr, f.site, f.site - u.e as up_distance, u.name as up_name, d.s - f.site as down_distance, d.name as down_name
  from f asof left join u on f.chr = u.chr and f.site > u.e asof left join d on f.chr = d.chr and f.site < d.s"""
_DISTANCES = ("chr", "site", "up_distance", "up_name", "down_distance", "down_name")


@_query(_NEAREST)
def nearest_intervals(spark, sf_dir):
    """Both neighbours among the intervals of every site."""
    return nearby.nearest_intervals(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir)).select(*_DISTANCES)


@_query(_NEAREST.replace(" from bed ", " from (select * from bed where o_custkey % 1000 = 5) "))
def nearest_intervals_sparse(spark, sf_dir):
    """Few intervals and short stretches, so most neighbours are carried over borders."""
    return nearby.nearest_intervals(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir).where("o_custkey % 1000 = 5"), size=64).select(*_DISTANCES)


def _runs_sql(threshold: float, gap: int) -> str:
    return f"""x as (select 1), {_NAMED}, w as (select a.chr, a.site, mismatch_rate, a.bed_name, n.site as held from a left join n on a.chr = n.chr and a.site = n.site where mismatch_rate >= {threshold}),
      g as (select *, case when site - lag(site) over (partition by chr order by site) <= {gap} then 0 else 1 end as begins from w),
      r as (select *, sum(begins) over (partition by chr order by site) as run from g)
      select chr, min(site) - 1 as start, max(site) as "end", count(*) as sites, count(held) as covered, arg_min(bed_name, site) filter (held is not null) as bed_name, round(max(mismatch_rate), 9) as worst from r group by chr, run"""


@_query(_runs_sql(0.5, 1))
def error_runs(spark, sf_dir):
    """Runs of neighbouring positions in error and what intervals hold of them."""
    return nearby.error_runs(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir)).withColumn("worst", F.round("worst", 9))


@_query(_runs_sql(0.4, 10))
def error_runs_wide(spark, sf_dir):
    """Sites up to 10 apart are one run, and stretches are shorter than many runs."""
    return nearby.error_runs(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir), 0.4, 10, size=4).withColumn("worst", F.round("worst", 9))


# ------------------------------------------------------------------ two samples


def _samples(spark, sf_dir):
    return ([ad.features(spark, sf_dir, s, r) for r in (0, 1)] for s in (0, 1))


_REPLICATES = ", ".join(f"r{s}{r} as {ad.features_sql(f'l_suppkey % 4 = {2 * s + r}')}" for s in (0, 1) for r in (0, 1))
_SYSTEMATIC = ", ".join(
    f"{name}{s} as (select chr, site from r{s}0 where {test} intersect select chr, site from r{s}1 where {test})"
    for s in (0, 1)
    for name, test in (("cov", "n_reads - n_ref_skip >= 20"), ("err", "n_reads - n_ref_skip >= 20 and mismatch_rate_alt >= 0.5"))
)
_TWO = f"""x as (select 1), {_REPLICATES}, {_SYSTEMATIC}, shared as (select * from err0 intersect select * from err1),
 found as (select *, 'A_B' as name from shared union all
  select *, 'A_excl' from (select * from err0 intersect (select * from cov1 except select * from shared)) union all
  select *, 'B_excl' from (select * from err1 intersect (select * from cov0 except select * from shared)))"""


@_query(f"{_TWO} select chr, site - 1 as start, site as \"end\", name from found")
def two_sample_positions(spark, sf_dir):
    return twosample.as_bed(twosample.positions(*_samples(spark, sf_dir), "A", "B", coverage_threshold=20))


@_query(f"{_TWO} select name, chr, count(*) as n from found group by name, chr union all select name, null, count(*) from found group by name")
def two_sample_counts(spark, sf_dir):
    return twosample.count_table(twosample.positions(*_samples(spark, sf_dir), "A", "B", coverage_threshold=20))


_CUBE = f"""x as (select 1), {_REPLICATES}, p as (select distinct chr, "end" as position from bed where name = '{CATEGORY}'),
 d as (select *, position + "offset" as site from (select chr, position, unnest(range(-2, 3)) as "offset" from p), (values ('A', 0), ('A', 1), ('B', 0), ('B', 1)) s(sample, replicate)),
 r as (select *, 'A' as sample, 0 as replicate from r00 union all select *, 'A', 1 from r01 union all select *, 'B', 0 from r10 union all select *, 'B', 1 from r11)"""


@_query(
    f"""{_CUBE} select d.chr, d.position, d.sample, d.replicate, d."offset", r.n_reads, r.n_ins, r.majority_base, round(deletion_rate, 9) as deletion_rate, round(insertion_rate, 9) as insertion_rate, round(refskip_rate, 9) as refskip_rate,
      round(r.n_a * 100.0::double / nullif(r.n_a + r.n_c + r.n_g + r.n_u, 0), 2) as a_percent,
      round(case r.ref_base when 'A' then a_rate when 'C' then c_rate when 'G' then g_rate when 'U' then u_rate end, 9) as match_rate
      from d left join r on d.chr = r.chr and d.site = r.site and d.sample = r.sample and d.replicate = r.replicate"""
)
def position_cube(spark, sf_dir):
    rows = possummary.cube(ad.intervals(spark, sf_dir).where(F.col("name") == CATEGORY), *_samples(spark, sf_dir), "A", "B")
    rows = possummary.errors(possummary.composition(rows))
    return rows.select("chr", "position", "sample", "replicate", "offset", "n_reads", "n_ins", "majority_base", *(F.round(c, 9).alias(c) for c in ("deletion_rate", "insertion_rate", "refskip_rate")), "a_percent", F.round("match_rate", 9).alias("match_rate"))


# ------------------------------------------------------------------ summaries


@_query("select count(*) as positions, count(distinct chr) as chromosomes from f")
def summary_totals(spark, sf_dir):
    return summary.totals(ad.features(spark, sf_dir))


@_query("select chr, count(*) as positions from f group by chr")
def summary_chromosomes(spark, sf_dir):
    return summary.chromosome_counts(ad.features(spark, sf_dir))


_CLASS = "case when ref_base = majority_base then 'match' when majority_base = '-' then 'deletion' else 'mismatch' end"


@_query(f"select {_CLASS} as class, count(*) as positions from f group by 1")
def summary_classes(spark, sf_dir):
    return summary.class_counts(ad.features(spark, sf_dir))


def _bins_sql(values: tuple[str, ...], group: str | None = None, rows: str = "f", more: str = "") -> str:
    means = ", ".join(f"round(avg({v}), 6) as {v}" for v in values)
    by = f"{group}, " if group else ""
    part = f"partition by {group}" if group else ""
    return f"select {by}bin, {means}{more} from (select *, ntile({BINS}) over ({part} order by chr, site) - 1 as bin from {rows}) group by {by}bin"


def _rounded(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({v: F.round(v, 6) for v in values})


@_query(_bins_sql(("n_reads", "q_mean")))
def summary_general(spark, sf_dir):
    return _rounded(summary.general(ad.features(spark, sf_dir), BINS), ("n_reads", "q_mean"))


@_query(_bins_sql(("n_reads", "q_mean"), "chr"))
def summary_by_chromosome(spark, sf_dir):
    return _rounded(summary.by_chromosome(ad.features(spark, sf_dir), BINS), ("n_reads", "q_mean"))


@_query(_bins_sql(RATES, "class", f"(select *, {_CLASS} as class from f)"))
def summary_by_class(spark, sf_dir):
    return _rounded(summary.by_class(ad.features(spark, sf_dir), BINS), RATES)


_GRID = "g as (select * from (values ('A'), ('C'), ('G'), ('U'), ('-')) r(ref_base), (values ('A'), ('C'), ('G'), ('U'), ('-')) m(majority_base))"
_CELLS = "c as (select g.ref_base, g.majority_base, count(t.chr) as n from g left join t on g.ref_base = t.ref_base and g.majority_base = t.majority_base group by all)"
_PERCENT = "select ref_base, majority_base, n, case when n > 0 and ref_base <> majority_base then round(n::double * 100 / nullif((select sum(n) from c where ref_base <> majority_base), 0), 2) end as percent from c"


@_query(f"x as (select 1), {_GRID}, t as (select * from f), {_CELLS} {_PERCENT}")
def summary_confusion(spark, sf_dir):
    return summary.confusion(ad.features(spark, sf_dir))


@_query(f"x as (select 1), {_GRID}, t as (select * from f), {_CELLS} select concat(ref_base, ' - ', majority_base) as mismatch, n from c where ref_base <> majority_base and ref_base <> '-'")
def summary_mismatch_counts(spark, sf_dir):
    return summary.mismatch_counts(ad.features(spark, sf_dir))


@_query(_bins_sql(RATES, "mismatch", "(select *, concat(ref_base, ' - ', majority_base) as mismatch from f where ref_base <> majority_base)"))
def summary_by_mismatch(spark, sf_dir):
    return _rounded(summary.by_mismatch(ad.features(spark, sf_dir), BINS), RATES)


@_query(_bins_sql(RATES, "motif3", "(select *, substring(motif, 2, 3) as motif3 from f where substring(motif, 3, 1) in ('A', 'C', 'G', 'U'))", ", substring(motif3, 2, 1) as centre"))
def summary_by_motif(spark, sf_dir):
    return _rounded(summary.by_motif(ad.features(spark, sf_dir), BINS), RATES)


@_query("select chr, " + ", ".join(f"round(quantile_cont(mismatch_rate, {q}), 9) as q{i}" for i, q in enumerate((0, 0.25, 0.5, 0.75, 1))) + " from f group by chr")
def box_statistics(spark, sf_dir):
    rows = binning.box(ad.features(spark, sf_dir), ["mismatch_rate"], ["chr"])
    return rows.select("chr", *(F.round(F.col("mismatch_rate")[i], 9).alias(f"q{i}") for i in range(5)))


# ------------------------------------------------------------------ positions of interest


def _annotated(spark, sf_dir):
    return bed.annotate(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir))


_GROUPED = f"""{_NAMED}, grouped as (select *, case when ref_base = majority_base then 0 else 2 end as grp from a where bed_name = '{CATEGORY}'
  union all select *, case when ref_base = majority_base then 1 else 3 end from a where ref_base = '{COUNTERPART}')"""


@_query(f"x as (select 1), {_NAMED}, {_GRID}, t as (select * from a where bed_name = '{CATEGORY}'), {_CELLS} {_PERCENT}")
def poi_confusion(spark, sf_dir):
    return summary.confusion(_annotated(spark, sf_dir).where(F.col("bed_name") == CATEGORY), rows_of_gaps=True)


@_query(
    f"""x as (select 1), {_GROUPED}, m as (select grp, count(*) as n, median(a_rate) as a, median(c_rate) as c, median(g_rate) as g, median(u_rate) as u from grouped group by grp)
      select grp, n, {', '.join(f'round({b}, 9) as {b}_rate, round({b} / nullif(a + c + g + u, 0), 9) as scaled_{b}_rate' for b in 'acgu')} from m"""
)
def poi_composition(spark, sf_dir):
    rows = poi.composition(poi.groups(_annotated(spark, sf_dir), CATEGORY, COUNTERPART))
    return rows.select("grp", "n", *(F.round(c, 9).alias(c) for c in rows.columns[2:]))


@_query(
    f"""x as (select 1), {_GROUPED} select grp, metric, count(*) as n, round(avg(value), 9) as mean, round(sum(value), 5) as total from (
      {' union all '.join(f"select grp, '{m}' as metric, {m} as value from grouped" for m in poi.METRICS)}) group by grp, metric"""
)
def poi_error_rates(spark, sf_dir):
    rates = poi.error_rates(poi.groups(_annotated(spark, sf_dir), CATEGORY, COUNTERPART))
    return rates.groupBy("grp", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.sum("value"), 5).alias("total"))


@_query(
    f"""x as (select 1), {_NAMED}, own as (select * from a where bed_name = '{CATEGORY}'),
      near as (select o.chr, o.site, e.site - o.site as "offset" from own o left join f e on e.chr = o.chr and e.site between o.site - 2 and o.site + 2 and e.site <> o.site and e.mismatch_rate >= 0.5)
      select "offset"::int as "offset", case when "offset" is not null then p.site is not null end as is_poi, count(*) as n
      from near left join (select distinct chr, site from own) p on p.chr = near.chr and p.site = near.site + near."offset" group by 1, 2"""
)
def poi_neighbours(spark, sf_dir):
    found = neighbours.with_neighbour_errors(_annotated(spark, sf_dir))
    return poi.neighbour_counts(found.where(F.col("bed_name") == CATEGORY))


_VALUES = f"""v as ({' union all '.join(f"select grp, '{m}' as metric, {m} as value from grouped" for m in poi.METRICS)}),
      pairs as (select * from (values (0, 0, 1), (1, 2, 3), (2, 0, 2), (3, 1, 3)) p(pair, a, b)),
      r as (select metric, pair, a, grp, value, rank() over (partition by metric, pair order by value) + (count(*) over (partition by metric, pair, value) - 1) / 2.0 as rk from v join pairs on grp in (a, b))"""


@_query(
    f"""x as (select 1), {_GROUPED}, {_VALUES}, s as (select metric, pair, sum(case when grp = a then rk end)::double as rank_sum from r group by metric, pair),
      t as (select metric, pair, sum(n * n * n - n) as ties from (select metric, pair, value, count(*)::double as n from r group by all) group by metric, pair)
      select metric, pair, rank_sum, ties from s join t using (metric, pair)"""
)
def poi_rank_sums(spark, sf_dir):
    rates = poi.error_rates(poi.groups(_annotated(spark, sf_dir), CATEGORY, COUNTERPART))
    return stats.rank_sums(materialize(rates, "poi-rates"), [(0, 1), (2, 3), (0, 2), (1, 3)])


#: The complementary error function by Simpson's rule for small and by Craig's integral for large arguments.
_ERFC = """case when {x} <= 0 then 1.0
    when {x} < 2 then 1 - 2 * {x} / sqrt(pi()) * list_sum(list_transform(range(201), lambda i: (case when i in (0, 200) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-({x}) * ({x}) * (i / 200.0) ** 2))) / 600
    else list_sum(list_transform(range(200), lambda i: exp(-({x}) * ({x}) / pow(sin((i + 0.5) * pi() / 400), 2)))) / 200 end"""
_SKEW = "(g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))))"
_B2 = "(3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))"


@_query(
    f"""x as (select 1), {_GROUPED}, {_VALUES},
      c as (select *, avg(value) over (partition by metric, grp) as mu from v),
      m as (select metric, grp, count(*)::double as n, avg(value) as mean, var_samp(value) as s2, avg((value - mu) ** 2) as m2, avg((value - mu) ** 3) as m3, avg((value - mu) ** 4) as m4 from c group by metric, grp),
      g as (select *, m3 / m2 ** 1.5 as g1, m4 / m2 ** 2 as kurt from m where n >= 8 and m2 > 0),
      w as (select *, sqrt(2 * ({_B2} - 1)) - 1 as w2, case when {_SKEW} = 0 then 1 else {_SKEW} end as y,
              (kurt - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) as kx,
              6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as kb from g),
      z as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) as zs, 6 + 8 / kb * (2 / kb + sqrt(1 + 4 / (kb * kb))) as ka from w),
      k as (select metric, grp, exp(-(zs ** 2 + ((1 - 2 / (9 * ka) - sign(1 + kx * sqrt(2 / (ka - 4))) * pow((1 - 2 / ka) / abs(1 + kx * sqrt(2 / (ka - 4))), 1 / 3.0)) / sqrt(2 / (9 * ka))) ** 2) / 2) >= 0.05 as normal from z),
      rs as (select metric, pair, sum(case when grp = a then rk end) as s from r group by metric, pair),
      ti as (select metric, pair, sum(n * n * n - n) as t from (select metric, pair, value, count(*)::double as n from r group by all) group by metric, pair),
      j as (select x.metric, a, b, x.n as n1, y.n as n2, s - x.n * (x.n + 1) / 2 as u1, t, coalesce(kx.normal and ky.normal, false) as normal, x.s2 as v1, y.s2 as v2
            from (select distinct metric from v) q cross join pairs left join m x on x.metric = q.metric and x.grp = a left join m y on y.metric = q.metric and y.grp = b
            left join rs on rs.metric = q.metric and rs.pair = pairs.pair left join ti on ti.metric = q.metric and ti.pair = pairs.pair
            left join k kx on kx.metric = q.metric and kx.grp = a left join k ky on ky.metric = q.metric and ky.grp = b),
      e as (select *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) / sqrt(2) as ex from j)
      select metric, a::int as "first", b::int as "second", case when n1 >= 8 and n2 >= 8 and not normal then round({_ERFC.format(x='ex')}, 9) end as p,
        case when coalesce(n1 >= 8 and n2 >= 8, false) then case when normal then 'normal' else 'MWU' end else 'ERROR' end as test from e where metric is not null"""
)
def poi_tests(spark, sf_dir):
    """The SQL states the choice of the test and the rank test's p; all samples of these tables fail the test of normality."""
    rates = materialize(poi.error_rates(poi.groups(_annotated(spark, sf_dir), CATEGORY, COUNTERPART)), "poi-rates")
    return stats.compare_groups(rates, True).withColumn("p", F.round("p", 9))


# ------------------------------------------------------------------ first rows, samples and sketches


@_query("select chr, site, n_reads, row_number() over w as rank from f window w as (partition by chr order by mismatch_rate desc, n_reads desc, site) qualify row_number() over w <= 20")
def top_sites(spark, sf_dir):
    """The worst sites of each chromosome; of equal ones those with more reads, then the smaller site."""
    order = [F.desc("mismatch_rate"), F.desc("n_reads"), F.asc("site")]
    return topk.top_k(ad.features(spark, sf_dir), 20, order, ["chr"]).select("chr", "site", "n_reads", "rank")


@_query(
    """x as (select 1), p as (select motif, chr, site, -ln((('0x' || substr(md5(concat('7:', chr, ':', site::varchar)), 1, 13))::bigint + 1) / 4503599627370496.0::double) / n_reads as place from f where n_reads > 0)
      select motif, chr, site, round(place, 9) as place, row_number() over w as rank from p window w as (partition by motif order by place, chr, site) qualify row_number() over w <= 10"""
)
def sampled_sites(spark, sf_dir):
    """Ten sites of each motif, drawn in proportion to their reads."""
    found = topk.sample_k(ad.features(spark, sf_dir), 10, ["chr", "site"], ["motif"], "n_reads")
    return found.select("motif", "chr", "site", F.round("place", 9).alias("place"), "rank")


_REGIONS = "r as (select o_orderpriority as region, concat('chr', o_custkey % 7 + 1) as chr, min(o_orderkey) as start, (min(o_orderkey) + max(o_orderkey)) // 2 as \"end\" from orders group by 1, 2)"


@_query(
    f"""x as (select 1), {_REGIONS}, s as (select distinct region, chr, unnest(range((start + 1) // 1000, "end" // 1000 + 1)) as stretch from r)
      select region, count(*) as rows, true as quantiles_within, true as motifs_within from s join f on f.chr = s.chr and f.site // 1000 = s.stretch group by region"""
)
def region_sketches(spark, sf_dir):
    """Regions of several chromosomes from stored sketches: exact rows, and whether estimates keep the stated errors."""
    features = ad.features(spark, sf_dir)
    stored = materialize(sketches.sketch(features, ["mismatch_rate"], size=1000), "sketches")
    regions = ad.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("region"), F.expr("concat('chr', o_custkey % 7 + 1)").alias("chr")).agg(F.min("o_orderkey").alias("start"), F.expr("(min(o_orderkey) + max(o_orderkey)) div 2").alias("end"))
    told = materialize(sketches.region_summary(stored, regions, (0.1, 0.5, 0.9), ["mismatch_rate"]), "sketched")
    # the rows themselves, to see where the estimates lie among them
    at = F.explode(F.sequence(F.floor((F.col("start") + 1) / 1000), F.floor(F.col("end") / 1000))).alias("stretch")
    real = features.withColumn("stretch", F.floor(F.col("site") / 1000)).join(regions.select("region", "chr", at).distinct(), ["chr", "stretch"])
    real = real.select("region", "motif", F.col("mismatch_rate").alias("value")).join(F.broadcast(told.select("region", "mismatch_rate")), "region")
    below = [F.avg((F.col("value") < F.col("mismatch_rate")[i]).cast("double")) <= q + sketches.RANK_ERROR for i, q in enumerate((0.1, 0.5, 0.9))]
    upto = [F.avg((F.col("value") <= F.col("mismatch_rate")[i]).cast("double")) >= q - sketches.RANK_ERROR for i, q in enumerate((0.1, 0.5, 0.9))]
    seen = real.groupBy("region").agg(*(b.alias(f"b{i}") for i, b in enumerate([*below, *upto])), F.countDistinct("motif").alias("motifs"))
    ok = F.col("b0") & F.col("b1") & F.col("b2") & F.col("b3") & F.col("b4") & F.col("b5")
    near = F.abs(F.col("motif") - F.col("motifs")) <= F.greatest(F.lit(1), F.ceil(F.col("motifs") * sketches.COUNT_ERROR))
    return told.join(seen, "region").select("region", "rows", ok.alias("quantiles_within"), near.alias("motifs_within"))


@_query("select chr, site, chr as name from f where mismatch_rate >= 0.5")
def flagship(spark, sf_dir):
    """Positions in error, labelled; rows of the two-step minimum: feature table, then filter."""
    rows = filtering.filter_features(ad.features(spark, sf_dir), mismatch_rate="0.5")
    return rows.select("chr", "site", F.col("chr").alias("name")).orderBy(*labels.chromosome_order(), "site")
