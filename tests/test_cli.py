"""Every command, from text files to text files."""

import pytest

from porewise.__main__ import main, outputs, parser

from .test_pileup import LINES


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    (folder / "in.pileup").write_text("".join("\t".join(map(str, r)) + "\n" for r in LINES))
    (folder / "ref.fasta").write_text(">c1\nACGTACGTAC\n>c2\nGGT\n")
    (folder / "a.bed").write_text("c1\t1\t3\tx\nc1\t5\t6\ty\n")
    (folder / "b.bed").write_text("c1\t2\t4\tz\nc2\t0\t1\tv\n")
    main(f"extractor -i {folder}/in.pileup -r {folder}/ref.fasta -o {folder}/out".split())
    return folder


def lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_extractor_and_summary(inputs):
    body = [x for x in lines(inputs / "out/in_extracted.tsv") if not x.startswith("chr\t")]
    assert len(body) == 8 and all(x.count("\t") == 24 for x in body)
    assert (inputs / "out/in_extracted_summary/confusion").exists()
    main(f"summary -i {inputs}/out/in_extracted.tsv -o {inputs}/summary -b 10".split())
    assert len(lines(inputs / "summary/in_extracted_summary/mismatch_counts")) >= 17


def test_region(inputs):
    main(f"extractor -i {inputs}/in.pileup -r {inputs}/ref.fasta -g c1:2-4 --no_summary -o {inputs}/region.tsv".split())
    assert [x.split("\t")[1] for x in lines(inputs / "region.tsv") if x.startswith("c1")] == ["2", "3", "4"]


def test_filter(inputs):
    main(f"filter -i {inputs}/out/in_extracted.tsv -c c1 -p >=0.4 -m -bi {inputs}/a.bed -o {inputs}/filtered".split())
    assert [x.split("\t")[1] for x in lines(inputs / "filtered/in_extracted_filtered.tsv") if x.startswith("c1")] == ["3"]


def test_bed_operations(inputs):
    f = inputs
    main(f"bedops tsv2bed -i {f}/out/in_extracted.tsv -o {f}/t.bed".split())
    main(f"bedops intersect -a {f}/a.bed -b {f}/b.bed -o {f}/i.bed --label_a A --label_b B".split())
    main(f"bedops merge -i {f}/a.bed,{f}/b.bed -o {f}/m.bed".split())
    main(f"bedops difference -i1 {f}/a.bed -i2 {f}/b.bed -o {f}/d.bed".split())
    main(f"bedops addinfo -i {f}/out/in_extracted.tsv -b {f}/a.bed -o {f}/info".split())
    assert "c1\t5\t6" in lines(f / "t.bed")
    assert "c1\t1\t3\tA" in lines(f / "i.bed")
    assert "c1\t2\t3\tx,z" in lines(f / "m.bed")
    assert lines(f / "d.bed") == ["c1\t1\t2\tx", "c1\t5\t6\ty"]
    assert {x.split("\t")[1]: x.split("\t")[-1] for x in lines(f / "info") if x.startswith("c1")} == {"1": "", "2": "x", "3": "", "4": "", "5": "", "6": "y"}


def test_samples_and_positions(inputs):
    f = inputs
    main(f"twosample -i {f}/out/in_extracted.tsv -i2 {f}/out/in_extracted.tsv -bn A -bn2 B -r {f}/ref.fasta -c 2 -o {f}/two".split())
    assert "c2\t0\t1\tA_B" in lines(f / "two/A_B.bed") and not lines(f / "two/A_excl.bed") and (f / "two/A_B_summary/counts").exists()
    main(f"possummary -i {f}/out/in_extracted.tsv -i2 {f}/out/in_extracted.tsv -b {f}/a.bed -n 1 -o {f}/pos".split())
    assert len([x for x in lines(f / "pos/sample1_sample2_a_summary/positions") if x.startswith("c1")]) == 2 * 2 * 3
    main(f"analyzepoi -i {f}/out/in_extracted.tsv -b {f}/a.bed -r {f}/ref.fasta -c x -cc C --update_tsv -o {f}/poi".split())
    assert (f / "poi/x_in_extracted_summary/tests").exists()
    (head, *rest) = (x.split("\t") for x in lines(f / "out/in_extracted_w_bed_info.tsv"))
    assert len(head) == 17 and head[-2:] == ["neighbour_error_pos", "bed_name"]
    body = {(r[0], r[1]): r for r in rest if r[0] != "chr"}
    assert len(body) == 8 and body[("c1", "2")][-1] == "x" and body[("c1", "4")][-2:] == ["-2,", "None"] and body[("c1", "6")][-2] == "None"


def test_motifs_are_in_order(inputs):
    body = [x.split("\t") for x in lines(inputs / "out/in_extracted_summary/by_motif")]
    motifs = [x[0] for x in body if x[0] != "motif3"]
    assert motifs == sorted(motifs) and len(motifs) > 3


def test_names_of_outputs():
    assert outputs(["d/a.pileup", "b.x.txt/"], "out/", "_extracted.tsv") == ["out/a_extracted.tsv", "out/b.x_extracted.tsv"]
    assert outputs(["a", "b"], "x.tsv,y.tsv", "_s") == ["x.tsv", "y.tsv"]
    with pytest.raises(ValueError, match="outputs"):
        outputs(["a", "b"], "x.tsv", "_s")


@pytest.mark.parametrize("bad", ["extractor -i a -o b -r c -m 1.5", "extractor -i a -o b -r c -n -1", "filter -i a", "twosample -i a -i2 b -o c -r d -f q_mean"])
def test_wrong_arguments(bad):
    with pytest.raises(SystemExit):
        parser().parse_args(bad.split())
