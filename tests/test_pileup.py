"""Hand-computed pileup rows, a plain decoder on random rows, and the whole extractor."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from porewise.functions import pileup as p
from porewise.operators import extractor, neighbours
from porewise.schema import COLUMNS
from porewise.sources import text

LINES = [
    ("c1", 1, "A", 4, ".,..", "IIII"),
    ("c1", 2, "C", 4, "^].T$t,", "5555"),
    ("c1", 3, "G", 5, ".+2AG,-1c*aA", "IIII!"),
    ("c1", 4, "T", 4, "..>>", 'II"#'),
    ("c1", 5, "A", 5, ".$,>*c", "ABCDE"),
    ("c1", 6, "N", 3, "..,", "III"),
    ("c2", 1, "G", 3, "aaA", "+++"),
    ("c2", 2, "G", 2, ".-12ACGTACGTACGTt", '\\"'),
    ("cX", 1, "A", 3, "...", "III"),
]
# chr, site: n_reads, ref, majority, a, c, g, u, del, ins, skip, mismatch, mismatch_alt, motif, q_mean, q_std, neighbours
EXPECTED = {
    ("c1", 1): (4, "A", "A", 4, 0, 0, 0, 0, 0, 0, 0.0, 0.0, "NNACG", 40.0, 0.0, [1]),
    ("c1", 2): (4, "C", "C", 0, 2, 0, 2, 0, 0, 0, 0.5, 0.5, "NACGU", 20.0, 0.0, []),
    ("c1", 3): (5, "G", "A", 2, 0, 2, 0, 1, 1, 0, 0.4, 0.5, "ACGUA", 32.0, 16.0, [-1]),
    ("c1", 4): (4, "U", "U", 0, 0, 0, 2, 0, 0, 2, 0.0, 0.0, "CGUAC", 40.0, 0.0, [-2]),
    ("c1", 5): (5, "A", "A", 2, 1, 0, 0, 1, 0, 1, 0.2, 0.333333, "GUACG", 33.75, 1.47902, []),
    ("c1", 6): (3, "N", "A", 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0, "UACGU", 40.0, 0.0, []),
    ("c2", 1): (3, "G", "A", 3, 0, 0, 0, 0, 0, 0, 1.0, 1.0, "NNGGU", 10.0, 0.0, [1]),
    ("c2", 2): (2, "G", "G", 0, 0, 1, 1, 0, 0, 0, 0.5, 0.5, "NGGUN", 30.0, 29.0, [-1]),
}
COMPAT_Q = {("c1", 1): 27.4, ("c1", 2): 11.4, ("c1", 3): 22.833333, ("c1", 4): 19.0, ("c1", 5): 22.4, ("c1", 6): 24.25, ("c2", 1): 1.75, ("c2", 2): 12.333333}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pileup")
    (folder / "in.pileup").write_text("".join("\t".join(map(str, r)) + "\n" for r in LINES) + "c1\t7\tG\n")
    (folder / "ref.fasta").write_text(">c1 first\nACGTa\nCGTAC\n>c2\nAAA\n>c2 again\nGGT\n")
    return folder


def _extract(spark, files, **how):
    return extractor.extract(text.read_pileup(spark, str(files / "in.pileup")), text.read_fasta(spark, str(files / "ref.fasta")), **how)


def test_hand_made_rows(spark, files):
    got = {(r["chr"], r["site"]): r for r in _extract(spark, files).collect()}
    assert set(got) == set(EXPECTED)
    names = "n_reads ref_base majority_base n_a n_c n_g n_u n_del n_ins n_ref_skip mismatch_rate mismatch_rate_alt motif q_mean q_std neighbour_error_pos".split()
    for key, row in EXPECTED.items():
        for name, want in zip(names, row, strict=True):
            have = got[key][name]
            assert have == (pytest.approx(want, abs=1e-5) if isinstance(want, float) else want), (key, name)


def test_newline_counts_as_a_score_in_compat_mode(spark, files):
    for r in _extract(spark, files, compat=True).collect():
        assert r["q_mean"] == pytest.approx(COMPAT_Q[(r["chr"], r["site"])], abs=1e-5)


def test_thresholds_hide_neighbours(spark, files):
    got = _extract(spark, files, num_reads=4, mean_quality=30).collect()
    assert {(r["chr"], r["site"]) for r in got} == {("c1", 1), ("c1", 3), ("c1", 4), ("c1", 5)}
    assert all(r["neighbour_error_pos"] == [] for r in got)


def test_reference_longer_than_a_piece(spark):
    random.seed(1)
    seq = "".join(random.choice("ACGT") for _ in range(40_000))
    reference = spark.createDataFrame([("long", seq, len(seq))], "chr string, seq string, length int")
    sites = [1, 2, 16383, 16384, 16385, 16386, 32768, 32769, 39_999, 40_000, 40_001, 0]
    rows = spark.createDataFrame([("long", s) for s in sites], "chr string, site long")
    padded = "NN" + seq.replace("T", "U") + "NN"
    for r in extractor.with_motif(rows, reference).collect():
        assert r["motif"] == (padded[r["site"] - 1 : r["site"] + 4] if 1 <= r["site"] <= 40_000 else "")


def _plain(ref, bases, quals):
    """The decode recipe step by step."""
    x = re.sub(r"(?s)\^.", "", bases.lower())
    dels, ins = x.count("*"), len(re.findall(r"\+[0-9]+[acgtn]+", x))
    for m in reversed(list(re.finditer(r"[+-](\d+)", x))):
        x = x[: m.start()] + x[m.end() + int(m[1]) :]
    counts = {"A": x.count("a"), "C": x.count("c"), "G": x.count("g"), "U": x.count("t")}
    counts[ref] = x.count(".") + x.count(",")
    skips = x.count("<") + x.count(">")
    marks = x.replace("*", "")
    scores = [ord(q) - 33 for i, q in enumerate(quals) if not (i < len(marks) and marks[i] in "<>")]
    return counts, dels, ins, skips, (statistics.fmean(scores), statistics.pstdev(scores)) if scores else (-1.0, -1.0)


def test_random_rows(spark):
    random.seed(2)
    rows = []
    for i in range(300):
        parts = []
        for _ in range(random.randint(0, 12)):
            parts.append(random.choice([".", ",", "A", "c", "T", "g", "*", "<", ">", ".$", "^I,", "^].", "+3acg", "-2GT", "+11acgtacgtacg"]))
        quals = "".join(chr(random.randint(33, 74)) for _ in range(random.randint(0, 12)))
        rows.append(("c", i, random.choice("ACGU"), len(parts), "".join(parts), quals))
    got = extractor.decode(spark.createDataFrame(rows, "chr string, site long, ref_base string, n_reads int, bases string, qualities string").withColumn("ends_with_qualities", F.lit(False)))
    for r in got.collect():
        _, _, ref, n, bases, quals = rows[r["site"]]
        counts, dels, ins, skips, (mean, std) = _plain(ref, bases, quals)
        assert (r["n_a"], r["n_c"], r["n_g"], r["n_u"]) == tuple(counts[b] for b in "ACGU"), bases
        assert (r["n_del"], r["n_ins"], r["n_ref_skip"]) == (dels, ins, skips), bases
        assert r["q_mean"] == pytest.approx(mean) and r["q_std"] == pytest.approx(std, abs=1e-9)
        assert r["mismatch_rate"] == pytest.approx(sum(counts[b] for b in "ACGU" if b != ref) / n if n else 0)


def test_majority_ties_go_in_order(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 1), (0, 0, 2, 2, 2), (0, 0, 0, 0, 3), (0, 0, 0, 0, 0)], "n_a int, n_c int, n_g int, n_u int, n_del int")
    assert [r[0] for r in rows.select(p.majority_base()).collect()] == ["A", "G", "-", "A"]


@pytest.mark.parametrize("stretch", [4, 7, neighbours.STRETCH])
def test_neighbours_at_any_stretch(spark, stretch):
    random.seed(3)
    rows = [(c, s, random.random()) for c in ("a", "b") for s in sorted(random.sample(range(200), 90))]
    features = spark.createDataFrame([*rows, ("a", rows[0][1], 1.0)], "chr string, site long, mismatch_rate double")  # a repeated site
    error = {(c, s) for c, s, m in [*rows, ("a", rows[0][1], 1.0)] if m >= 0.6}
    got = neighbours.with_neighbour_errors(features, 3, 0.6, stretch).collect()
    assert len(got) == 181
    for r in got:
        assert r["neighbour_error_pos"] == [d for d in range(-3, 4) if d and (r["chr"], r["site"] + d) in error]


def test_extraction_decodes_once(spark):
    """The decoded rows stand once in the plan, and without Python."""
    rows = spark.createDataFrame([("c", 1, "A", 2, "..", "II")], "chr string, site long, ref_base string, n_reads int, bases string, qualities string")
    reference = spark.createDataFrame([("c", "ACGT", 4)], "chr string, seq string, length int")
    plan = extractor.extract(rows, reference)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS __core#") == 1 and "Python" not in plan


def test_large_indels_and_leading_zeros(spark):
    texts = [".+120" + "a" * 120 + "c.", ".-03acgt", "+5ac-2gtt", "+12acgtacgtacgtt", ".+1a+2cc-3ggg*"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(p.without_indels(F.col("x"))).collect()]
    assert got == [".c.", ".t", "t", "t", ".*"]


def _fasta(records, width):
    return "".join(f">{n} more words\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for n, s in records)


@pytest.mark.parametrize("width", [60, 7, 100_000])
def test_fasta_in_pieces(spark, tmp_path, width):
    random.seed(width)
    records = [(n, "".join(random.choice("ACGTacgtN") for _ in range(size))) for n, size in (("c1", 5000), ("c2", 1), ("c1", 4097), ("c3", 0), ("c4", 1024))]
    (tmp_path / "r.fa").write_text("stray\n" + _fasta(records, width))
    kept = dict(records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        reference = text.read_fasta(spark, str(tmp_path / "r.fa"))
        assert {r["chr"]: r["length"] for r in text.sequence_lengths(reference).collect()} == {n: len(s) for n, s in kept.items()}
        pieces = text.reference_chunks(reference, 512, 3).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(pieces) == sum(-(-len(s) // 512) for s in kept.values())
    for r in pieces:
        padded = "NNN" + kept[r["chr"]].upper() + "NNN"
        assert r["piece"] == padded[r["chunk"] * 512 : (r["chunk"] + 1) * 512 + 6]


def test_feature_text_round_trip(spark, files, tmp_path):
    features = _extract(spark, files)
    text.write_features(features, str(tmp_path / "f"))
    back = text.read_features(spark, str(tmp_path / "f"))
    assert back.columns == [*COLUMNS, "replicate"]
    want = {(r["chr"], r["site"]): r for r in features.collect()}
    for r in back.collect():
        for c in COLUMNS:
            have, expected = r[c], want[(r["chr"], r["site"])][c]
            assert (have or []) == expected if c == "neighbour_error_pos" else have == expected


def test_streamed_lines_decode_as_in_batch(spark, files, tmp_path):
    from porewise.streaming.decode import decoded_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text((files / "in.pileup").read_text())
    query = decoded_stream(spark, str(tmp_path / "in"), 3).writeStream.format("memory").queryName("decoded").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = extractor.decode(text.read_pileup(spark, str(files / "in.pileup")).where("n_reads >= 3"))
    names = ["chr", "site", "n_a", "n_c", "n_g", "n_u", "q_mean", "mismatch_rate"]
    assert sorted(spark.table("decoded").select(names).collect()) == sorted(batch.select(names).collect())


def test_empty_input(spark):
    rows = spark.createDataFrame([], "value string")
    reference = spark.createDataFrame([("c1", "ACGT", 4)], "chr string, seq string, length int")
    assert extractor.extract(text.parse_pileup(rows), reference).count() == 0
