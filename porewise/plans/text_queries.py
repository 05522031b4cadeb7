"""Queries that run from text files to features and back, and reports as wholes, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import region
from ..functions.labels import chromosome_order, decode_neighbours, encode_neighbours
from ..operators import binning, extractor, filtering, neighbours, poi, summary, twosample
from ..schema import COLUMNS
from ..sources import blocks, text
from ..sources.storage import new_folder
from . import adapters as ad
from .queries import _CELLS, _CLASS, _GRID, _GROUPED, _NAMED, _PERCENT, _TWO, BINS, CATEGORY, COUNTERPART, RATES, _bins_sql, _samples
from .registry import query

# ------------------------------------------------------------------ the extractor

#: Pileup text with read starts and ends, skips before other marks, indels and both cases, as an expression of both engines.
_BASES = (
    "concat('^]', repeat('.', cast(l_quantity as int)), case when l_returnflag = 'R' then '>><' else '' end, repeat('a', cast(round(l_discount * 100) as int)), '+2AG', "
    "repeat(',', l_linenumber), '-3ttt', repeat('*', cast(round(l_tax * 100) as int)), case when l_linestatus = 'O' then 'T$<c' else '+12acgtnacgtnacG' end, '^*.$')"
)
_REFERENCE = "ACGTN"


#: One line item stands for each site: the largest by this key, which tells all that the text is made of.
_KEY = (
    "cast(l_quantity as bigint) * 1000000 + cast(round(l_discount * 100) as bigint) * 10000 + cast(round(l_tax * 100) as bigint) * 100 "
    "+ case when l_returnflag = 'R' then 10 else 0 end + case when l_linestatus = 'O' then 1 else 0 end"
)
_QUALITIES = "concat(repeat('I', cast(l_quantity as int)), repeat('5', cast(l_linenumber as int)), repeat('#', cast(round(l_tax * 100) as int)), 'A+')"


def _of_key(integer_division: str) -> str:
    """The fields of the key again, with the engine's sign of integer division."""
    part = lambda low, size: f"((k {integer_division} {low}) % {size})"
    return f"{part(10**6, 10**6)} as l_quantity, {part(10**4, 100)} / 100.0 as l_discount, {part(100, 100)} / 100.0 as l_tax, case when {part(10, 10)} = 1 then 'R' else 'A' end as l_returnflag, case when {part(1, 10)} = 1 then 'O' else 'F' end as l_linestatus"


def _pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each site."""
    lines = ad.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.expr(f"max({_KEY})").alias("k"))
    lines = lines.selectExpr("l_orderkey", "l_linenumber", *_of_key("div").split(", "))
    return lines.select(
        F.expr("concat('chr', cast(l_linenumber as string))").alias("chr"),
        F.col("l_orderkey").alias("site"),
        F.expr(ad.REF_BASE).alias("ref_base"),
        (F.expr("cast(l_quantity as int)") + F.col("l_linenumber")).alias("n_reads"),
        F.expr(_BASES).alias("bases"),
        F.expr(_QUALITIES).alias("qualities"),
    )


#: Repeats in a stretch of the reference.
_TIMES = 1 << 14


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeating sequence for each chromosome, a little longer than its last site, in stretches as ``read_fasta`` gives them."""
    lines = ad.table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.expr(f"max(l_orderkey) div {len(_REFERENCE)} + 1").alias("times"))
    parts = lines.select("*", F.expr(f"explode(sequence(0L, times - 1, {_TIMES}L))").alias("first"))
    seq = F.expr(f"repeat('{_REFERENCE}', cast(least(times - first, {_TIMES}L) as int))")
    return parts.select(F.expr("concat('chr', cast(l_linenumber as string))").alias("chr"), (F.col("first") * len(_REFERENCE)).alias("offset"), seq.alias("seq"), (F.col("times") * len(_REFERENCE)).alias("length"))


_RATE = lambda n, total: f"(case when {total} = 0 then 0.0 else {n}::double / {total} end)"
_MISMATCH = lambda total: "(0.0 + " + " + ".join(f"(case when ref_base = '{b}' then 0.0 else {_RATE(f'n_{b.lower()}', total)} end)" for b in "ACGU") + ")"


def _extract_sql(early: str, late: str, k: int = 2, threshold: float = 0.5) -> str:
    """The feature table step by step, from the same pileup text."""
    count = lambda t, c: f"len({t}) - len(replace({t}, '{c}', ''))"
    counts = ", ".join(f"case when ref_base = '{b}' then match else {count('core', 't' if b == 'U' else b.lower())} end as n_{b.lower()}" for b in "ACGU")
    base = lambda d: f"case when site + {d} between 1 and length then substr('ACGUN', ((site + {d} - 1) % 5 + 1)::int, 1) else 'N' end"
    rates = ", ".join(f"{_RATE(n, 'n_reads')} as {r}" for r, n in [("a_rate", "n_a"), ("c_rate", "n_c"), ("g_rate", "n_g"), ("u_rate", "n_u"), ("deletion_rate", "n_del"), ("insertion_rate", "n_ins"), ("refskip_rate", "n_ref_skip")])
    rounded = {"a_rate", "c_rate", "g_rate", "u_rate", "deletion_rate", "insertion_rate", "refskip_rate", "mismatch_rate", "mismatch_rate_alt", "q_mean", "q_std"}
    out = ", ".join(f"round({c}, 9) as {c}" if c in rounded else c for c in COLUMNS if c != "neighbour_error_pos")
    return f"""x as (select 1),
     p as (select concat('chr', cast(l_linenumber as varchar(4))) as chr, l_orderkey as site, {ad.REF_BASE} as ref_base, (cast(l_quantity as int) + l_linenumber)::int as n_reads, {_BASES} as bases, {_QUALITIES} as q
           from (select l_orderkey, l_linenumber, {_of_key('//')} from (select l_orderkey, l_linenumber, max({_KEY}) as k from lineitem group by all))),
     l as (select chr, (max(site) // 5 + 1) * 5 as length from p group by chr),
     d as (select *, regexp_replace(lower(bases), '\\^.', '', 'g') as x from p join l using (chr) where {early}),
     c as (select *, array_to_string(list_transform(string_split(regexp_replace(x, '([+-][0-9])', chr(1) || '\\1', 'g'), chr(1)), lambda c:
             case when regexp_matches(c, '^[+-][0-9]+') then substr(c, 2 + len(regexp_extract(c, '^[+-]([0-9]+)', 1)) + regexp_extract(c, '^[+-]([0-9]+)', 1)::int) else c end), '') as core from d),
     m as (select *, {count('core', '.')} + {count('core', ',')} as match, replace(core, '*', '') as marks from c),
     s as (select *, list_transform(list_filter(range(1, len(q) + 1), lambda i: substr(marks, i, 1) not in ('<', '>')), lambda i: ascii(substr(q, i, 1)) - 33) as scores from m),
     n as (select *, {counts}, {count('x', '*')} as n_del, len(regexp_extract_all(x, '\\+[0-9]+[acgtn]+')) as n_ins, {count('core', '<')} + {count('core', '>')} as n_ref_skip,
             coalesce(list_avg(scores), -1) as q_mean, coalesce(list_stddev_pop(scores), -1) as q_std, case when site between 1 and length then concat({', '.join(base(i) for i in range(-2, 3))}) else '' end as motif from s),
     r as (select *, {rates}, {_MISMATCH('n_reads')} as mismatch_rate, {_MISMATCH('(n_a + n_c + n_g + n_u)')} as mismatch_rate_alt,
             case when n_a >= n_c and n_a >= n_g and n_a >= n_u and n_a >= n_del then 'A' when n_c >= n_g and n_c >= n_u and n_c >= n_del then 'C' when n_g >= n_u and n_g >= n_del then 'G' when n_u >= n_del then 'U' else '-' end as majority_base from n),
     t as (select * from r where {late}),
     e as (select *, list(case when mismatch_rate >= {threshold} then site end) over (partition by chr order by site range between {k} preceding and {k} following) as near from t)
     select {out}, array_to_string(list_sort(list_filter(list_transform(list_filter(near, lambda z: z is not null), lambda z: z - site), lambda z: z <> 0)), ',') as neighbour_error_pos from e"""


def _shown(features: DataFrame) -> DataFrame:
    """Rates rounded, neighbours as text."""
    rounded = [c for c in COLUMNS if c.endswith("_rate") or c in ("mismatch_rate_alt", "q_mean", "q_std")]
    return features.withColumns({c: F.round(c, 9) for c in rounded}).withColumn("neighbour_error_pos", F.array_join(F.col("neighbour_error_pos").cast("array<string>"), ","))


@query(_extract_sql("n_reads >= 2", "mismatch_rate >= 0"))
def extract_features(spark, sf_dir):
    """The whole extractor, against a repeating reference."""
    rows = _pileup(spark, sf_dir)
    return _shown(extractor.extract(rows, _reference(spark, sf_dir), num_reads=2, mismatch_rate=0.0))


@query(_extract_sql("n_reads >= 20", "q_mean >= 30 and deletion_rate >= 0.02 and mismatch_rate >= 0.1 and mismatch_rate_alt >= 0.15", 3, 0.3))
def extract_thresholds(spark, sf_dir):
    """All thresholds at once, a wider window and a lower bound for neighbours."""
    rows = _pileup(spark, sf_dir)
    return _shown(extractor.extract(rows, _reference(spark, sf_dir), 20, 30, 0.02, 0.1, 0.15, window_size=3, neighbour_thresh=0.3))


@query(_extract_sql("chr not in ('chr2', 'chr7')", "mismatch_rate >= 0.2"))
def extract_unknown(spark, sf_dir):
    """Rows of chromosomes that the reference lacks are left out."""
    return _shown(extractor.extract(_pileup(spark, sf_dir), _reference(spark, sf_dir).where("chr not in ('chr2', 'chr7')"), mismatch_rate=0.2))


@query(_extract_sql("chr = 'chr3' and site between 100 and 1200", "true"))
def extract_region(spark, sf_dir):
    """One region of one chromosome, given as text."""
    rows = _pileup(spark, sf_dir)
    return _shown(extractor.extract(rows, _reference(spark, sf_dir), region=region("chr3:100-1,200", {"chr3": 1_200})))


# ------------------------------------------------------------------ text files


def _written(lines: DataFrame, name: str) -> str:
    """The lines (column ``value``) as a text file in the shared folder."""
    path = new_folder(lines.sparkSession, name)
    lines.write.text(path)
    return path


_LINE_KINDS = "case when l_suppkey % 10 = 0 then 'x' else cast(l_orderkey as {t}) end"


@query(
    f"""select concat('chr', cast(l_linenumber as varchar(4))) as chr, l_orderkey as site, replace({ad.REF_BASE}, 'T', 'U') as ref_base, l_linenumber::int as n_reads, {ad.BASES_TEXT} as bases, concat('"', chr(92), 'I#') as qualities, l_partkey % 3 = 0 as ends_with_qualities
      from lineitem where l_suppkey % 10 <> 0 and l_partkey % 3 <> 1"""
)
def text_pileup(spark, sf_dir):
    """Pileup lines through a file: quotes and backslashes stay, lines without a number or with too few fields go, further fields are ignored."""
    rows = ad.table(spark, sf_dir, "lineitem")
    fields = [F.expr("concat('chr', cast(l_linenumber as string))"), F.expr(_LINE_KINDS.format(t="string")), F.translate(F.expr(ad.REF_BASE), "U", "T"), F.col("l_linenumber").cast("string"), F.expr(ad.BASES_TEXT), F.lit('"\\I#')]
    line = F.when(F.col("l_partkey") % 3 == 1, F.concat_ws("\t", *fields[:3])).when(F.col("l_partkey") % 3 == 2, F.concat_ws("\t", *fields, F.lit("more"))).otherwise(F.concat_ws("\t", *fields))
    return text.read_pileup(spark, _written(rows.select(line.alias("value")), "text-pileup"))


@query("select chr, start, \"end\", case when o_custkey % 4 <> 1 then name end as name, case when o_custkey % 4 > 1 then concat(name, ',', o_custkey) when o_custkey % 4 = 0 then name else '' end as extras, (o_custkey % 2)::int as file from bed")
def text_bed(spark, sf_dir):
    """Interval lines of three, four and more fields through two files; a line with two fields goes."""
    rows = ad.intervals(spark, sf_dir)
    fields = ["chr", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("o_custkey").cast("string")]
    kind = F.col("o_custkey") % 4
    line = F.when(kind == 1, F.concat_ws("\t", *fields[:3])).when(kind == 0, F.concat_ws("\t", *fields[:4])).otherwise(F.concat_ws("\t", *fields))
    short = F.concat_ws("\t", "chr", F.col("start").cast("string"))
    paths = []
    for i in (0, 1):
        own = rows.where(F.col("o_custkey") % 2 == i)
        paths.append(_written(own.select(line.alias("value")).union(own.select(short)), "text-bed"))
    return text.read_bed(spark, paths).select("chr", "start", "end", "name", F.array_join("extras", ",").alias("extras"), "file")


_PLAIN = [c for c in COLUMNS if c not in ("q_std", "neighbour_error_pos") and not c.endswith(("_rate", "_alt"))]


@query(
    f"""x as (select 1), w as (select *, list(case when mismatch_rate >= 0.5 then site end) over (partition by chr order by site range between 2 preceding and 2 following) as l from f),
      e as (select *, list_sort(list_filter(list_transform(list_filter(l, lambda z: z is not null), lambda z: z - site), lambda z: z <> 0)) as near from w)
      select {', '.join(_PLAIN)}, round(mismatch_rate, 9) as mismatch_rate, round(deletion_rate, 9) as deletion_rate, 1.5 as q_std, coalesce(array_to_string(near, ','), '') as neighbours, case when len(near) > 0 then concat(array_to_string(near, ','), ',') else '' end as code from e"""
)
def text_features(spark, sf_dir):
    """A feature table with neighbours through its text form."""
    rows = neighbours.with_neighbour_errors(ad.features(spark, sf_dir)).withColumn("q_std", F.lit(1.5))
    path = new_folder(spark, "text-features")
    text.write_features(rows, path, compression="gzip")
    near = F.coalesce("neighbour_error_pos", F.array().cast("array<int>"))
    found = text.read_features(spark, path)
    return found.select(*_PLAIN, *(F.round(c, 9).alias(c) for c in ("mismatch_rate", "deletion_rate")), "q_std", F.array_join(near.cast("array<string>"), ",").alias("neighbours"), encode_neighbours(near).alias("code"))


_SITES = f"""select concat('chr', cast(l_linenumber as varchar(4))) as chr, l_orderkey as site, {ad.REF_BASE} as ref_base, (cast(l_quantity as int) + l_linenumber)::int as n_reads, {_BASES} as bases, {_QUALITIES} as qualities
  from (select l_orderkey, l_linenumber, {_of_key('//')} from (select l_orderkey, l_linenumber, max({_KEY}) as k from lineitem group by all))"""


def _in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "pileup-blocks")
    blocks.write_blocks(_pileup(spark, sf_dir), path)
    return blocks.read_blocks(spark, path, split_bytes=1 << 20)


@query(_SITES)
def block_pileup(spark, sf_dir):
    """Pileup lines through block-compressed files."""
    return _in_blocks(spark, sf_dir)


@query(f"x as (select 1) select * from ({_SITES}) where chr in ('chr3', 'chr5') and site between 100 and 1200")
def block_region(spark, sf_dir):
    """A region of two chromosomes, of which only its blocks are read."""
    return _in_blocks(spark, sf_dir).where("chr in ('chr3', 'chr5') and site between 100 and 1200")


#: A line of a feature table with fields as other programs write them, and two columns beyond those known.
_VERBATIM = (
    "concat_ws(chr(9), chr, cast(site as varchar(20)), cast(n_reads as varchar(20)), ref_base, majority_base, '1', '02', '3', '4', '5', '6', '7', '1e-07', '0.10', '.5', '0', '1E-3', '-0', '0.0', "
    "case when mismatch_rate >= 0.5 then '5.00e-1' else '4.99e-1' end, 'nan', motif, '30', '1.50', '', concat('\"', motif), cast(site % 7 as varchar(20)))"
)


@query(
    f"""x as (select 1), o as (select *, {_VERBATIM} as value, row_number() over (order by md5(concat(chr, ':', site::varchar))) as number_in from f)
      select number_in, row_number() over (order by number_in) as number_out, value from o where mismatch_rate >= 0.5"""
)
def text_order(spark, sf_dir):
    """A table in random order of chromosomes through the filter: whole lines, in the order of the input."""
    rows = ad.features(spark, sf_dir).withColumn("value", F.expr(_VERBATIM.replace("chr(9)", "char(9)")))
    source, out = new_folder(spark, "text-order-in"), new_folder(spark, "text-order-out")
    text.write_lines(rows.withColumn("h", F.unhex(F.md5(F.concat("chr", F.lit(":"), F.col("site").cast("string"))))), source, "\t".join([*COLUMNS, "bed_col_1", "bed_col_2"]), ["h"])
    found = text.read_feature_lines(spark, source).where("not head")
    text.write_lines(filtering.filter_features(found, mismatch_rate=">=0.5"), out, text.read_header(spark, source))
    # line 0 of each file is the header, and no two lines are of the same site
    numbered = lambda path, name, *more: text.number_lines(text.read_feature_lines(spark, path)).where("not head").select(F.substring_index("value", "\t", 2).alias("of"), *more, F.col("number").alias(name))
    return numbered(out, "number_out", "value").join(numbered(source, "number_in"), "of").select("number_in", "number_out", "value")


@query("x as (select 1), t as (select l_orderkey, l_linenumber, l_suppkey % 5 as n from lineitem) select distinct case n when 0 then '' else array_to_string(list_transform(range(n), lambda i: i * 3 - 4), ',') || ',' end as code, n as numbers from t")
def neighbour_codes(spark, sf_dir):
    """Offsets from text to arrays and back."""
    n = (F.col("l_suppkey") % 5).cast("int")
    made = F.when(n > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * 3 - 4).cast("string")), ","), F.lit(","))).otherwise("")
    back = decode_neighbours(F.col("code"))
    rows = ad.table(spark, sf_dir, "lineitem").select(made.alias("code")).distinct()
    return rows.select(encode_neighbours(F.coalesce(back, F.array().cast("array<int>"))).alias("code"), F.coalesce(F.size(back), F.lit(0)).cast("long").alias("numbers"))


_PIECE = 100


@query(
    f"""x as (select 1), s as (select concat('c', c_custkey) as chr, repeat('ACGTN', (c_custkey % 97)::int) as seq from customer)
      select chr, chunk::bigint as chunk, rpad(substr('NN' || seq || 'NN', (chunk * {_PIECE} + 1)::int, {_PIECE + 4}), least({_PIECE}, len(seq) - chunk * {_PIECE})::int + 4, 'N') as piece, len(seq)::bigint as length
      from (select *, unnest(range((len(seq) + {_PIECE} - 1) // {_PIECE})) as chunk from s)"""
)
def text_fasta(spark, sf_dir):
    """Sequences through a file of short lines, as pieces with halos."""
    rows = ad.table(spark, sf_dir, "customer")
    seq = F.expr("repeat('acGTn', cast(c_custkey % 97 as int))")
    lines = F.concat(F.array(F.concat(F.lit(">c"), F.col("c_custkey").cast("string"), F.lit(" more words"))), F.regexp_extract_all(seq, F.lit(".{1,60}"), F.lit(0)))
    path = _written(rows.repartition(1).sortWithinPartitions("c_custkey").select(F.explode(lines).alias("value")), "text-fasta")
    return text.reference_chunks(text.read_fasta(spark, path), _PIECE)


@query("x as (select 1), n as (select distinct case when o_custkey % 3 = 0 then concat('chr', o_custkey % 40) else cast(o_custkey % 40 as varchar) end as chr from orders) select chr, row_number() over (order by try_cast(chr as bigint) nulls last, chr)::int as place from n")
def chromosome_places(spark, sf_dir):
    """Numeric names by number, others after them by name."""
    from pyspark.sql import Window

    name = F.expr("case when o_custkey % 3 = 0 then concat('chr', o_custkey % 40) else cast(o_custkey % 40 as string) end").alias("chr")
    return ad.table(spark, sf_dir, "orders").select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(*chromosome_order())))


# ------------------------------------------------------------------ reports


_LENGTHS = "(select concat('chr', o_custkey % 5 + 1) as chr, max(o_orderkey)::bigint as length from orders group by 1)"


def _lengths(spark, sf_dir) -> DataFrame:
    """A reference without its bases, of five of the chromosomes."""
    rows = ad.table(spark, sf_dir, "orders")
    return rows.groupBy(F.expr("concat('chr', o_custkey % 5 + 1)").alias("chr")).agg(F.max("o_orderkey").cast("long").alias("length"))


@query(f"{_TWO} select chr, length from {_LENGTHS} where chr in (select chr from found)")
def two_sample_map(spark, sf_dir):
    return twosample.genome_map(twosample.positions(*_samples(spark, sf_dir), "A", "B", coverage_threshold=20), _lengths(spark, sf_dir))


_OTHER, _OTHER_COUNTERPART = "5-LOW", "G"


def _counts_sql(category: str, counterpart: str) -> str:
    own = f"(select * from a where bed_name = '{category}')"
    both = f"((select count(*) from {own}) + (select count(*) from a where ref_base = '{counterpart}'))"
    return f"""select '{category}' as category, 'map' as dataset, count(*) as n from {_LENGTHS} where chr in (select chr from {own})
      union all select '{category}', 'confusion', count(*) from {own} where ref_base in ('A', 'C', 'G', 'U', '-')
      union all select '{category}', 'composition', {both}
      union all select '{category}', 'error_rates', 5 * {both}
      union all select '{category}', 'tests', 20
      union all select '{category}', 'neighbours', (select sum(greatest(1, (select count(*) from f e where e.chr = o.chr and e.site between o.site - 2 and o.site + 2 and e.site <> o.site and e.mismatch_rate >= 0.5))) from {own} o)"""


@query(f"x as (select 1), {_NAMED} {_counts_sql(CATEGORY, COUNTERPART)} union all {_counts_sql(_OTHER, _OTHER_COUNTERPART)}")
def poi_analyse(spark, sf_dir):
    """All datasets of two categories from one annotated table: what each counts in sum."""
    features = neighbours.with_neighbour_errors(ad.features(spark, sf_dir))
    found = poi.analyse(features, ad.intervals(spark, sf_dir), _lengths(spark, sf_dir), [CATEGORY, _OTHER], [COUNTERPART, _OTHER_COUNTERPART])
    summed = {"confusion": F.sum("n"), "composition": F.sum("n"), "neighbours": F.sum("n")}
    out = None
    for category, datasets in found.items():
        for name, rows in datasets.items():
            one = rows.agg(summed.get(name, F.count("*")).cast("long").alias("n")).select(F.lit(category).alias("category"), F.lit(name).alias("dataset"), "n")
            out = one if out is None else out.union(one)
    return out


@query(f"x as (select 1), {_GROUPED} select chr, length from {_LENGTHS} where chr in (select chr from grouped where bed_name = '{CATEGORY}')")
def poi_map(spark, sf_dir):
    from ..operators import bed

    annotated = bed.annotate(ad.features(spark, sf_dir), ad.intervals(spark, sf_dir))
    return poi.sequence_map(annotated.where(F.col("bed_name") == CATEGORY), _lengths(spark, sf_dir))


def _sizes_sql() -> str:
    groups = {"general": "select count(*) as n from f", "by_chromosome": "select count(*) as n from f group by chr", "by_class": "select count(*) as n from f group by case when ref_base = majority_base then 0 when majority_base = '-' then 1 else 2 end", "by_mismatch": "select count(*) as n from f where ref_base <> majority_base group by ref_base, majority_base", "by_motif": "select count(*) as n from f where substring(motif, 3, 1) in ('A', 'C', 'G', 'U') group by substring(motif, 2, 3)"}
    rows = " union all ".join(f"select '{name}' as dataset, sum(least(n, {BINS}))::bigint as n from ({sql})" for name, sql in groups.items())
    return f"""select 'totals' as dataset, 1 as n union all select 'chromosome_counts', count(distinct chr) from f
      union all select 'class_counts', count(distinct case when ref_base = majority_base then 0 when majority_base = '-' then 1 else 2 end) from f
      union all select 'confusion', 25 union all select 'mismatch_counts', 16 union all {rows}"""


@query(_sizes_sql())
def summary_sizes(spark, sf_dir):
    """How many rows each dataset of the summary has."""
    out = None
    for name, rows in summary.summarise(ad.features(spark, sf_dir, stretch=binning.STRETCH), BINS).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n")
        out = one if out is None else out.union(one)
    return out


def _dataset_sql(name: str, sql: str, key: str, bin_: str, *values: str) -> str:
    shown = ", ".join(f"{v}::double as v{i}" for i, v in enumerate([*values, *["null"] * (4 - len(values))], 1))
    return f"select '{name}' as dataset, {key} as key, {bin_} as bin, {shown} from ({sql})"


_VALUES = {
    "totals": ("select count(*) as positions, count(distinct chr) as chromosomes from f", "''", "null", "positions", "chromosomes"),
    "chromosome_counts": ("select chr, count(*) as positions from f group by chr", "chr", "null", "positions"),
    "class_counts": (f"select {_CLASS} as class, count(*) as positions from f group by 1", "class", "null", "positions"),
    "general": (_bins_sql(("n_reads", "q_mean")), "''", "bin", "n_reads", "q_mean"),
    "by_chromosome": (_bins_sql(("n_reads", "q_mean"), "chr"), "chr", "bin", "n_reads", "q_mean"),
    "by_class": (_bins_sql(RATES, "class", f"(select *, {_CLASS} as class from f)"), "class", "bin", *RATES),
    "confusion": (_PERCENT, "concat(ref_base, majority_base)", "null", "n", "percent"),
    "mismatch_counts": ("select concat(ref_base, ' - ', majority_base) as mismatch, n from c where ref_base <> majority_base and ref_base <> '-'", "mismatch", "null", "n"),
    "by_mismatch": (_bins_sql(RATES, "mismatch", "(select *, concat(ref_base, ' - ', majority_base) as mismatch from f where ref_base <> majority_base)"), "mismatch", "bin", *RATES),
    "by_motif": (_bins_sql(RATES, "motif3", "(select *, substring(motif, 2, 3) as motif3 from f where substring(motif, 3, 1) in ('A', 'C', 'G', 'U'))"), "motif3", "bin", *RATES),
}
_KEYS = {"chromosome_counts": "chr", "class_counts": "class", "by_chromosome": "chr", "by_class": "class", "mismatch_counts": "mismatch", "by_mismatch": "mismatch", "by_motif": "motif3"}


@query(f"x as (select 1), {_GRID}, t as (select * from f), {_CELLS} " + " union all ".join(_dataset_sql(name, *how) for name, how in _VALUES.items()))
def summary_datasets(spark, sf_dir):
    """All values of the summary, from one scan."""
    found, out = summary.summarise(ad.features(spark, sf_dir, stretch=binning.STRETCH), BINS), None
    for name, (_, _, bin_, *values) in _VALUES.items():
        rows = found[name]
        key = F.concat("ref_base", "majority_base") if name == "confusion" else F.col(_KEYS[name]) if name in _KEYS else F.lit("")
        shown = [F.round(F.col(v).cast("double"), 6) if bin_ == "bin" else F.col(v).cast("double") for v in values] + [F.lit(None).cast("double")] * (4 - len(values))
        one = rows.select(F.lit(name).alias("dataset"), key.alias("key"), (F.col("bin") if bin_ == "bin" else F.lit(None)).cast("long").alias("bin"), *(c.alias(f"v{i}") for i, c in enumerate(shown, 1)))
        out = one if out is None else out.union(one)
    return out
