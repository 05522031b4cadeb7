"""Archives written and read back: types, digests, seeking, foreign readers of the frames."""

import base64
import hashlib
import io
import re
from datetime import UTC, datetime

import pyarrow as pa
import pytest
import zstandard

from porewise.llm import queries, warc

ROWS = [(1, "u", "<a>"), (2, "u\r\nx: y", "<a>"), (3, None, None), (4, "v", ""), (5, "w", "é" * 50_000), (6, "w", "WARC/1.1\r\n\r\n"), (7, "z", "<a>"), (None, "n", "<a>"), (None, "n", "alone")]


def _write(spark, tmp_path, rows=ROWS, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "'y' as digest", "'z' as id")
    return warc.write_bundles(pages, f"file://{tmp_path}/bundles", **how)


def test_round_trip(spark, tmp_path):
    manifest = _write(spark, tmp_path, frame_bytes=100, bundle_bytes=1000)
    got = warc.read_bundles(manifest).collect()
    assert len(got) == len(ROWS)
    keeper = {"<a>": 7, "": 4}
    for r in got:
        text = next(t or "" for i, _, t in ROWS if i == r["id"] and (i is not None or (t == "alone") == (r["record_type"] == "response")))
        raw = text.encode()
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["payload_bytes"] == len(raw)
        want = keeper.get(text) if r["id"] != keeper.get(text) else None
        assert (r["record_type"], r["refers_to"]) == (("revisit", want) if want else ("response", None))
        assert r["payload"] == (None if want else raw)


def test_revisits_get_the_payload_of_their_response(spark, tmp_path):
    records = warc.read_bundles(_write(spark, tmp_path))
    got = warc.with_payloads(records)
    assert got.columns == records.columns
    rows = got.collect()
    assert len(rows) == len(ROWS) and sum(r["record_type"] == "revisit" for r in rows) == 4
    for r in rows:
        assert len(r["payload"]) == r["payload_bytes"]
        assert base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
    lost = warc.with_payloads(records.where("record_type = 'revisit'")).collect()
    assert len(lost) == 4 and all(r["payload"] is None for r in lost)


def test_small_payloads_are_not_compared(spark, tmp_path):
    got = warc.read_bundles(_write(spark, tmp_path, min_bytes=4)).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_seeking(spark, tmp_path):
    manifest = _write(spark, tmp_path, [(i, "u", f"page {i} " * 20) for i in range(200)], frame_bytes=500)
    ids = spark.createDataFrame([(7,), (7,), (150,), (999,)], "id long")
    got = warc.fetch(manifest, ids).collect()
    assert sorted((r["id"], r["payload"].decode()) for r in got) == [(i, f"page {i} " * 20) for i in (7, 150)]
    assert manifest.select("frame").distinct().count() > 5


def test_other_readers_see_all_content(spark, tmp_path):
    _write(spark, tmp_path, [(i, "u", "x" * i) for i in range(50)], frame_bytes=300)
    (bundle, *_) = sorted((tmp_path / "bundles").glob("*.zst"))
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle.read_bytes()), read_across_frames=True) as reader:
        content = reader.read()
    with pa.OSFile(str(bundle)) as source:
        frames = warc.BundleReader(source)
        assert b"".join(frames.content(i) for i in range(len(frames.frames))) == content


def _strict(content):
    """Records by the rules of WARC 1.1: header lines, mandatory fields, block lengths, and HTTP messages inside."""
    while content:
        head, content = content.split(b"\r\n\r\n", 1)
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1" and all(re.fullmatch(rb"[A-Za-z-]+: [\x21-\x7e][\x20-\x7e]*", x) for x in lines)
        fields = {k.decode().lower(): v.decode() for k, v in (x.split(b": ", 1) for x in lines)}
        assert len(fields) == len(lines)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", fields["warc-record-id"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
        assert re.match(r"[a-z]+:", fields["warc-target-uri"]) or re.fullmatch(r"[!-~]+", fields["warc-target-uri"])
        assert fields["content-type"] == "application/http;msgtype=response"
        n = int(fields["content-length"])
        block, content = content[:n], content[n:]
        assert content.startswith(b"\r\n\r\n")
        content = content[4:]
        http, payload = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if fields["warc-type"] == "revisit":
            assert not payload and fields["warc-profile"].startswith("http://netpreserve.org/warc/1.1/revisit/") and "warc-refers-to" in fields
        else:
            assert fields["warc-type"] == "response" and len(payload) == length
            assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield fields, length


def test_records_by_a_strict_reader(spark, tmp_path):
    _write(spark, tmp_path, [*ROWS, (-(2**63), "x y", "q"), (2**63 - 1, "\u00e9 <>", "r")], date=datetime(2020, 1, 2, 3, 4, 5, tzinfo=UTC))
    found = []
    for bundle in (tmp_path / "bundles").glob("*.zst"):
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle.read_bytes()), read_across_frames=True) as reader:
            found += _strict(reader.read())
    assert len(found) == len(ROWS) + 2 and {f["warc-date"] for f, _ in found} == {"2020-01-02T03:04:05Z"}
    ids = {f["warc-record-id"]: f for f, _ in found}
    assert all(ids[f["warc-refers-to"]]["warc-payload-digest"] == f["warc-payload-digest"] for f, _ in found if f["warc-type"] == "revisit")


@pytest.mark.parametrize("i", [None, 0, 1, -1, 2**62, -(2**62), 2**63 - 1, -(2**63)])
def test_record_identifiers(i):
    assert warc._number(warc._urn(i)) == i


def test_empty(spark, tmp_path):
    manifest = _write(spark, tmp_path, [])
    assert manifest.count() == 0 and warc.read_bundles(manifest).count() == 0


def test_query(spark, small):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    last = {}
    for i, raw in pages:
        last[raw] = max(i, last.get(raw, i))
    got = {r["page_id"]: r for r in queries.op6_warc_bundles(spark, small).collect()}
    assert len(got) == len(pages)
    for i, raw in pages:
        assert got[i]["refers_to"] == (None if last[raw] == i else last[raw])
        assert got[i]["record_type"] == ("response" if last[raw] == i else "revisit")
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
