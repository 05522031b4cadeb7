"""Command line: one command for each module, from text files to folders of text part files.

Run with ``python -m porewise`` or ``spark-submit``. An output with an extension is taken as it
is; without one it is a folder, in which names come from the input. Datasets of reports are
written as one folder each, with tab-separated columns and a header.
"""

from __future__ import annotations

import argparse
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.conditions import not_negative, region, share
from .operators import bed, extractor, filtering, poi, possummary, summary, twosample
from .sources import text


def _number(kind, check):
    def parse(value: str):
        try:
            return check(kind(value))
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from e

    return parse


COUNT, AMOUNT, SHARE = _number(int, not_negative), _number(float, not_negative), _number(float, share)


def _write(datasets: dict[str, DataFrame], folder: str) -> None:
    """Small datasets, each in the order of its columns."""
    for name, rows in datasets.items():
        rows.orderBy(*rows.columns).write.csv(f"{folder}/{name}", sep="\t", header=True, quote="", emptyValue="", nullValue="")


def _features(spark: SparkSession, paths: str) -> DataFrame:
    return text.read_features(spark, paths).drop("replicate")


def _replicates(spark: SparkSession, paths: str) -> list[DataFrame]:
    return [_features(spark, p) for p in paths.split(",")]


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]


def outputs(inputs: list[str], out: str, suffix: str) -> list[str]:
    """One path for each input: those given, if they have an extension, else in the folder ``out``, by the input's name."""
    given = out.split(",")
    if not any(posixpath.splitext(p)[1] for p in given):
        return [f"{out.rstrip('/')}/{stem(p)}{suffix}" for p in inputs]
    if len(given) != len(inputs):
        raise ValueError(f"{len(given)} outputs for {len(inputs)} inputs")
    return given


def run_extractor(spark, a):
    reference, within = text.read_fasta(spark, a.ref), None
    if a.genomic_region:
        name = a.genomic_region.partition(":")[0]
        lengths = {r["chr"]: r["length"] for r in text.sequence_lengths(reference).where(F.col("chr") == name).collect()}
        within = region(a.genomic_region, lengths)
    inputs = a.input.split(",")
    for path, out in zip(inputs, outputs(inputs, a.output, "_extracted.tsv"), strict=True):
        rows = extractor.extract(text.read_pileup(spark, path, ordered=True), reference, a.num_reads, a.mean_quality, a.perc_deletion, a.mismatch_rate, a.mismatch_rate_alt, within, a.window_size, a.neighbour_thresh, keep=text.PLACE)
        text.write_features(rows, out)
        if not a.no_summary:
            _write(summary.summarise(_features(spark, out)), posixpath.splitext(out)[0] + "_summary")


def run_summary(spark, a):
    (out,) = outputs([a.input], a.output, "_summary")
    _write(summary.summarise(_features(spark, a.input), a.n_bins, a.plot_alt), out)


def run_analyzepoi(spark, a):
    split = lambda s: s.split(",") if s else None
    features, intervals = _features(spark, a.input), text.read_bed(spark, a.bed)
    wanted = split(a.bed_categories)
    found = poi.analyse(features, intervals, text.read_fasta(spark, a.ref), wanted, split(a.counterparts), a.use_mismatch_rate_alt)
    names = outputs(wanted, a.output, f"_{stem(a.input)}_summary")
    for out, datasets in zip(names, found.values(), strict=True):
        _write(datasets, out)
    if a.update_tsv:
        text.write_annotated(bed.annotate(text.read_features(spark, a.input, ordered=True), intervals), posixpath.splitext(a.input.rstrip("/"))[0] + "_w_bed_info.tsv")


def run_twosample(spark, a):
    found = twosample.positions(_replicates(spark, a.sample1), _replicates(spark, a.sample2), a.basename1, a.basename2, a.error_feature, a.error_threshold, a.coverage_threshold)
    intervals = twosample.as_bed(found)
    for name in (f"{a.basename1}_{a.basename2}", f"{a.basename1}_excl", f"{a.basename2}_excl"):
        text.write_bed(intervals.where(F.col("name") == name), f"{a.output}/{name}.bed")
    _write({"counts": twosample.count_table(found), "map": twosample.genome_map(found, text.read_fasta(spark, a.ref))}, f"{a.output}/{a.basename1}_{a.basename2}_summary")


def run_possummary(spark, a):
    rows = possummary.cube(text.read_bed(spark, a.bed), _replicates(spark, a.sample1), _replicates(spark, a.sample2), a.basename1, a.basename2, a.n_surrounding)
    _write({"positions": possummary.errors(possummary.composition(rows))}, f"{a.output_dir}/{a.basename1}_{a.basename2}_{stem(a.bed)}_summary")


def run_filter(spark, a):
    sets = {k: text.read_bed(spark, p) for k, p in (("filter_bed", a.filter_bed), ("exclude_bed", a.exclude_bed)) if p}
    how = {k: getattr(a, k) for k in "site n_reads base mismatched mismatch_types mismatch_rate mismatch_rate_alt deletion_rate insertion_rate refskip_rate motif q_score".split()}
    rows = text.read_feature_lines(spark, a.input).where("not head")
    kept = filtering.filter_features(rows, chrom=a.chromosome, **sets, **how)
    text.write_lines(kept, *outputs([a.input], a.output, "_filtered.tsv"), header=text.read_header(spark, a.input))


def run_tsv2bed(spark, a):
    text.write_bed(bed.to_bed(_features(spark, a.input)), a.output)


def run_intersect(spark, a):
    text.write_bed(bed.intersect(text.read_bed(spark, a.file_a), text.read_bed(spark, a.file_b), a.label_a, a.label_b), a.output)


def run_addinfo(spark, a):
    intervals = text.read_bed(spark, a.bed)
    n = intervals.agg(F.max(F.size("extras"))).first()[0] or 0
    rows, added = text.read_feature_lines(spark, a.input).where("not head"), [f"bed_col_{i + 1}" for i in range(n)]
    text.write_lines(text.append_fields(bed.add_info(rows, intervals, n), added), a.output, text.append_header(text.read_header(spark, a.input), added))


def run_merge(spark, a):
    text.write_bed(bed.merge([text.read_bed(spark, p) for p in a.input.split(",")]), a.output)


def run_difference(spark, a):
    text.write_bed(bed.difference(text.read_bed(spark, a.input1), text.read_bed(spark, a.input2)), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("porewise", description=__doc__)
    modules = top.add_subparsers(required=True, metavar="module")

    def command(where, name, run):
        p = where.add_parser(name)
        p.set_defaults(run=run)
        need = lambda *flags: [p.add_argument(*f.split("/"), required=True) for f in flags]
        return p.add_argument, need

    add, need = command(modules, "extractor", run_extractor)
    need("-i/--input", "-o/--output", "-r/--ref")
    add("-n", "--num_reads", type=COUNT, default=1)
    for short, name in (("-m", "mismatch_rate"), ("-ma", "mismatch_rate_alt"), ("-d", "perc_deletion")):
        add(short, f"--{name}", type=SHARE)
    add("-q", "--mean_quality", type=AMOUNT)
    add("-g", "--genomic_region")
    add("-t", "--num_processes", type=COUNT, help="accepted and unused: Spark sets the parallelism")
    add("-nw", "--window_size", type=COUNT, default=2)
    add("-nt", "--neighbour_thresh", type=SHARE, default=0.5)
    add("--no_summary", action="store_true")

    add, need = command(modules, "summary", run_summary)
    need("-i/--input", "-o/--output")
    add("-b", "--n_bins", type=COUNT, default=summary.BINS)
    add("--plot_alt", action="store_true")

    add, need = command(modules, "analyzepoi", run_analyzepoi)
    need("-i/--input", "-o/--output", "-b/--bed", "-r/--ref", "-c/--bed_categories")
    add("-cc", "--counterparts")
    add("--update_tsv", action="store_true")
    add("--use_mismatch_rate_alt", action="store_true")

    def samples(add, need):
        need("-i/--sample1", "-i2/--sample2")
        add("-bn", "--basename1", default="sample1")
        add("-bn2", "--basename2", default="sample2")

    add, need = command(modules, "twosample", run_twosample)
    samples(add, need)
    need("-o/--output", "-r/--ref")
    add("-f", "--error_feature", default="mismatch_rate_alt", choices=twosample.ERROR_FEATURES)
    add("-e", "--error_threshold", type=SHARE, default=0.5)
    add("-c", "--coverage_threshold", type=COUNT, default=40)

    add, need = command(modules, "possummary", run_possummary)
    samples(add, need)
    need("-b/--bed", "-o/--output_dir")
    add("-n", "--n_surrounding", type=COUNT, default=2)

    add, need = command(modules, "filter", run_filter)
    need("-i/--input", "-o/--output")
    add("-m", "--mismatched", action="store_true")
    for flag in "-c/--chromosome -s/--site -n/--n_reads -b/--base -mt/--mismatch_types -p/--mismatch_rate -pa/--mismatch_rate_alt -d/--deletion_rate -pi/--insertion_rate -pr/--refskip_rate -f/--motif -q/--q_score -bi/--filter_bed -be/--exclude_bed".split():
        add(*flag.split("/"))

    operations = modules.add_parser("bedops").add_subparsers(required=True, metavar="operation")
    for name, run, flags in (
        ("tsv2bed", run_tsv2bed, ("-i/--input", "-o/--output")),
        ("intersect", run_intersect, ("-a/--file_a", "-b/--file_b", "-o/--output", "--label_a", "--label_b")),
        ("addinfo", run_addinfo, ("-i/--input", "-o/--output", "-b/--bed")),
        ("merge", run_merge, ("-i/--input", "-o/--output")),
        ("difference", run_difference, ("-i1/--input1", "-i2/--input2", "-o/--output")),
    ):
        command(operations, name, run)[1](*flags)
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("porewise").getOrCreate(), a)


if __name__ == "__main__":
    main()
