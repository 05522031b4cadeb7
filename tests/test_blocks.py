"""Block-compressed pileup: round trips, regions, and files that are not whole."""

import gzip
import random

import pytest

from porewise.sources import blocks

ROW = "chr string, site long, ref_base string, n_reads int, bases string, qualities string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(rng.choice(["chr1", "chr10", "chr2", "x y"]), i, rng.choice("ACGT"), i % 50, rng.choice([".,", '"', "\\\\", "", "^]*" * 30]), "I#" * rng.randint(0, 60)) for i in range(1, 9001)]
    rows.append(("chr2", 20_000, "A", 1, "." * 150_000, ""))  # longer than a block
    folder = tmp_path_factory.mktemp("blocks") / "made"
    blocks.write_blocks(spark.createDataFrame(rows, ROW).repartition(5), f"file://{folder}")
    return rows, folder


def _open(spark, folder, **how):
    return blocks.read_blocks(spark, f"file://{folder}", **how)


def _copy(folder, to):
    to.mkdir()
    for p in folder.iterdir():
        (to / p.name).write_bytes(p.read_bytes())
    return to


def test_round_trip(spark, made):
    rows, folder = made
    for split in (1 << 14, 1 << 30):
        assert sorted(map(tuple, _open(spark, folder, split_bytes=split).collect())) == sorted(rows)
    assert _open(spark, folder, split_bytes=1 << 11).rdd.getNumPartitions() > 4
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted(folder.glob("*.gz")))
    assert text == "".join("\t".join(map(str, r)) + "\n" for r in sorted(rows))


CASES = ["chr = 'chr2' and site > 4000 and site <= 5000", "site = 77", "chr in ('x y', 'none') and site < 300", "chr = 'none'", "chr > 'chr1' and site >= 8990", "n_reads = 3 and chr = 'chr10'", "chr = 'chr1' or site < 10"]


@pytest.mark.parametrize("condition", CASES)
def test_regions(spark, made, condition):
    rows, folder = made
    want = spark.createDataFrame(rows, ROW).where(condition).collect()
    assert sorted(map(tuple, _open(spark, folder).where(condition).collect())) == sorted(map(tuple, want))


def test_only_the_blocks_of_a_region_are_read(spark, made, tmp_path):
    """A region is read though all blocks without it are spoilt, and the others are not."""
    rows, folder = made
    copy = _copy(folder, tmp_path / "spoilt")
    for index in copy.glob("*.index"):
        data = bytearray(index.with_suffix(".gz").read_bytes())
        for line in index.read_text().splitlines():
            at, size, low, high, name = line.split("\t")
            if not (name == "chr10" and int(high) >= 500 and int(low) <= 600):
                data[int(at) + 20 : int(at) + int(size) - 4] = bytes(int(size) - 24)
        index.with_suffix(".gz").write_bytes(data)
    got = _open(spark, copy).where("chr = 'chr10' and site between 500 and 600").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] == "chr10" and 500 <= r[1] <= 600)
    with pytest.raises(Exception, match="part-0000"):
        _open(spark, copy).collect()


def test_files_that_are_not_whole(spark, made, tmp_path):
    _, folder = made
    copy = _copy(folder, tmp_path / "cut")
    first = sorted(copy.glob("*.gz"))[0]
    data = first.read_bytes()
    first.write_bytes(data[:-40])
    with pytest.raises(Exception, match="truncated"):
        _open(spark, copy).count()
    first.write_bytes(data[:100] + data[160:])  # in the middle, with the end in place
    with pytest.raises(Exception, match="part-0000"):
        _open(spark, copy).collect()
    first.unlink()
    with pytest.raises(Exception, match="No such file"):
        _open(spark, copy).count()
    with pytest.raises(Exception, match="made"):
        blocks.write_blocks(spark.createDataFrame([("a", 1, "A", 1, ".", "I")], ROW), f"file://{folder}")


def test_empty(spark, tmp_path):
    blocks.write_blocks(spark.createDataFrame([("a", None, "A", 1, ".", "I")], ROW), f"file://{tmp_path}/none")
    assert _open(spark, tmp_path / "none").count() == 0
    with pytest.raises(ValueError, match="mounted"):
        blocks.local("s3://bucket/x")
