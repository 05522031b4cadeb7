"""Round trips of every compression and layout, foreign layouts by hand, damaged files."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from porewise.llm import queries, tiff


def _samples():
    random.seed(1)
    yield b""
    yield b"a"
    yield b"aaaa" * 1000
    yield bytes(range(256)) * 40
    yield random.randbytes(30_000)
    yield b"".join(bytes([random.randrange(3)]) * random.randint(1, 300) for _ in range(200))


@pytest.mark.parametrize("data", list(_samples()))
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def _plain_codes(data, most_entries=4094, clear=True):
    """The codes of a plain coder over a dictionary of words, with their widths."""
    table, word, out = {bytes([i]): i for i in range(256)}, b"", [(256, 9)]
    size = 258
    width = lambda: 9 + sum(size > k for k in (511, 1023, 2047))
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        out.append((table[word], width()))
        if size < 4096:
            table[longer] = size
            size += 1
        if clear and size > most_entries:
            out.append((256, width()))
            table, size = {bytes([i]): i for i in range(256)}, 258
        word = data[i : i + 1]
    if word:
        out.append((table[word], width()))
        size += size < 4096
    return [*out, (257, width())]


def _packed(codes):
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("data", list(_samples()))
def test_lzw_against_a_plain_coder(data):
    plain = _packed(_plain_codes(data))
    assert tiff.lzw_encode(data) == plain
    assert tiff.lzw_decode(plain) == tiff.lzw_decode(plain + b"rest") == data
    early = _packed(_plain_codes(data, most_entries=700))
    assert tiff.lzw_decode(early) == data


@pytest.mark.parametrize("data", [random.Random(9).randbytes(20_000), b"abc" * 3000 + random.Random(8).randbytes(6000) + b"abc" * 3000])
def test_lzw_goes_on_with_a_full_table(data):
    codes = _plain_codes(data, clear=False)
    assert len(codes) > 4200
    assert tiff.lzw_decode(_packed(codes)) == data
    with pytest.raises(ValueError, match="more than"):
        tiff.lzw_decode(_packed(codes), len(data) - 1)
    assert tiff.lzw_decode(_packed(codes), len(data)) == data
    for cut in (1, 2, 3):  # a strip that ends early keeps its whole codes
        assert data.startswith(tiff.lzw_decode(_packed(codes)[:-cut]))


def test_known_codes():
    """The packed example of the format's description, and LZW codes written out by hand."""
    packed = bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", ""))
    assert tiff.packbits_decode(packed).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert list(tiff.lzw_decode(data)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


@pytest.mark.parametrize("size", [576, 576 * 5, 144 * 512 * 2 + 576, 576 * 1000])
def test_payloads(size):
    payload = random.Random(size).randbytes(size // 2) + b"text " * (size // 10)
    payload = payload[:size].ljust(size, b"\xff")
    found = list(tiff.pages(tiff.encode(payload)))
    assert not any(p["error"] for p in found)
    assert b"".join(p["samples"] for p in found) == payload
    assert [p["page"] for p in found] == list(range(len(found)))


def test_all_styles_occur():
    used = {(p["compression"], p["predictor"], p["tiled"]) for n in range(1, 60) for p in tiff.pages(tiff.encode(bytes(576 * n)))}
    assert used == set(tiff.STYLES)


def _file(order, entries, data):
    """One directory after the data; entries are (tag, kind, values)."""
    out, extra = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + bytes(4) + data), bytearray()
    at = len(out)
    where = at + 2 + 12 * len(entries) + 4
    body = struct.pack(order + "H", len(entries))
    for tag, kind, values in entries:
        raw = struct.pack(f"{order}{len(values)}{'.B.HI'[kind]}", *values)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind, len(values), where + len(extra))
            extra += raw
        else:
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, at)
    return bytes(out + body + bytes(4) + extra)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("planar", [1, 2])
def test_colour_in_16_bits(order, planar):
    picture = np.random.default_rng(3).integers(0, 65536, (5, 7, 3), np.uint16)
    planes = [picture] if planar == 1 else [picture[..., c : c + 1] for c in range(3)]
    strips = [zlib.compress(np.diff(p, axis=1, prepend=np.uint16(0)).astype(order + "u2").tobytes()) for p in planes]
    offsets = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    entries = [(256, 3, [7]), (257, 3, [5]), (258, 3, [16] * 3), (259, 3, [8]), (262, 3, [2]), (273, 4, offsets), (277, 3, [3]), (278, 3, [5]), (279, 4, [len(s) for s in strips]), (284, 3, [planar]), (317, 3, [2])]
    (page,) = tiff.pages(_file(order, entries, b"".join(strips)))
    assert page["error"] is None and page["channels"] == 3
    assert np.array_equal(np.frombuffer(page["samples"], np.uint16).reshape(5, 7, 3), picture)


def _grey(width, height, strips, order="<", **fields):
    """A file of one grey page; fields by tag number replace the usual ones."""
    offsets = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    usual = {256: [width], 257: [height], 258: [8], 259: [1], 262: [1], 273: offsets, 277: [1], 278: [height], 279: [len(s) for s in strips]}
    entries = [(tag, 4, v) for tag, v in sorted((usual | {int(k[1:]): v for k, v in fields.items()}).items())]
    return _file(order, entries, b"".join(strips))


def test_missing_strips_are_an_error():
    whole = [bytes([i]) * 16 for i in range(8)]
    (page,) = tiff.pages(_grey(16, 8, whole, t278=[1]))
    assert page["samples"] == b"".join(whole)
    (page,) = tiff.pages(_grey(16, 8, whole[:2], t278=[1]))
    assert page["samples"] is None and "8 strips" in page["error"]


def _codes(*codes):
    bits = "".join(f"{c:09b}" for c in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("codes", [(256, 7, 7, 400, 257), (256, 300, 257), (256, 7, 260, 257)])
def test_impossible_codes_are_an_error(codes):
    with pytest.raises(ValueError, match="LZW code"):
        tiff.lzw_decode(_codes(*codes))
    (page,) = tiff.pages(_grey(3, 1, [_codes(*codes)], t259=[5]))
    assert page["samples"] is None and "LZW code" in page["error"]


def test_pages_after_a_bad_one():
    payload = bytes(range(144)) * (512 * 3)
    data = bytearray(tiff.encode(payload))
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    tag = next(at + 2 + 12 * i for i in range(n) if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == 259)
    data[tag + 8] = 99
    found = list(tiff.pages(bytes(data)))
    assert [bool(p["error"]) for p in found] == [True, False, False]
    assert b"".join(p["samples"] or b"" for p in found) == payload[144 * 512 :]


def test_sizes_are_checked_before_anything_is_allocated():
    for fields in ({"t256": [1 << 31], "t257": [1 << 30]}, {"t257": [0]}, {"t322": [0], "t323": [16], "t324": [8], "t325": [16]}, {"t322": [1 << 31], "t323": [1 << 30], "t324": [8], "t325": [16]}):
        (page,) = tiff.pages(_grey(16, 1, [bytes(16)], **fields))
        assert page["samples"] is None and page["error"].startswith("ValueError")
    bomb = zlib.compress(bytes(50_000_000))
    (page,) = tiff.pages(_grey(16, 1, [bomb], t259=[8]))
    assert page["samples"] == bytes(16)


@pytest.mark.parametrize("order", "<>")
def test_floating_point_predictor(order):
    picture = np.random.default_rng(4).normal(size=(6, 5)).astype(np.float32)
    planes = np.ascontiguousarray(picture.astype(">f4")).view(np.uint8).reshape(6, 5, 4).transpose(0, 2, 1).reshape(6, 20)
    strip = zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes())
    (page,) = tiff.pages(_grey(5, 6, [strip], order, t258=[32], t259=[8], t317=[3], t339=[3]))
    assert page["error"] is None and np.array_equal(np.frombuffer(page["samples"], np.float32).reshape(6, 5), picture)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("fill", [1, 2])
def test_samples_of_few_bits(bits, fill):
    picture = np.random.default_rng(5).integers(0, 1 << bits, (9, 13), np.uint8)
    packed = b""
    for row in picture:
        text = "".join(f"{v:0{bits}b}" for v in row)
        packed += bytes(int(text[i : i + 8].ljust(8, "0")[:: 1 if fill == 1 else -1], 2) for i in range(0, len(text), 8))
    (page,) = tiff.pages(_grey(13, 9, [packed], t258=[bits], t266=[fill]))
    assert page["error"] is None and np.array_equal(np.frombuffer(page["samples"], np.uint8).reshape(9, 13), picture)


def test_damaged_files(spark):
    good = tiff.encode(b"x" * 576)
    files = [(1, good), (2, None), (3, b""), (4, b"no picture"), (5, good[: len(good) // 2]), (6, good)]
    got = tiff.read_tiff(spark.createDataFrame(files, "doc_id long, media binary"), "media", "doc_id").collect()
    assert sorted({r["doc_id"] for r in got}) == [1, 4, 5, 6]
    assert {r["doc_id"] for r in got if r["error"]} == {4, 5}


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op3_tiff_pages(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(tiff.encode(payload)).hexdigest()
    assert len({r["feature"] for r in got}) > 0.5 * len(set(docs.values()))
