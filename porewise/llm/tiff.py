"""Media columns: read TIFF images held in a binary column, one row per page.

The decoder walks the image directories of both byte orders and undoes PackBits, LZW and
deflate, strips and tiles, both fill orders, horizontal differencing and the floating-point
predictor, for samples of 1 to 64 bits, chunky or planar. Samples of fewer than 8 bits come out as a byte
each. A null or empty value yields no page. A page that cannot be decoded (missing strips, codes
that no table has, more than ``MOST_BYTES``) yields a row whose ``error`` says why and whose
samples are null; the pages before and after it stay, as long as its directory can be read. The
encoder writes lossless 8-bit grey pages and exists so that any bytes can be stored as images.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 266, 284, 317, 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LZW_CLEAR, LZW_END = 256, 257
#: Our encoder clears its table after this many entries; a table is full after that many new ones.
LZW_LAST, LZW_FULL = 4094, 4096 - 258
#: A page of more decoded bytes is refused before anything is allocated.
MOST_BYTES = 1 << 29

PAGE = "struct<page: int, width: int, height: int, bits: int, channels: int, compression: int, predictor: int, tiled: boolean, samples: binary, error: string>"


# ------------------------------------------------------------------ compression


def packbits_encode(row: bytes) -> bytes:
    out = bytearray()
    for m in re.finditer(rb"(?s)(.)\1{2,127}|(?:(?!(.)\2\2).){1,128}", row):
        part = m.group()
        out += bytes((257 - len(part), part[0])) if m.group(1) else bytes((len(part) - 1,)) + part
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code; the width grows one code early, as TIFF wants."""
    return np.digitize(np.arange(LZW_END + 1, LZW_END + 1 + n), (512, 1024, 2048)) + 9


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first."""
    codes, table, size = [LZW_CLEAR], {}, LZW_END + 1
    put = codes.append
    code = data[0] if data else None
    for byte in data[1:]:
        key = code << 8 | byte
        if key in table:
            code = table[key]
            continue
        put(code)
        table[key] = size
        size += 1
        if size > LZW_LAST:
            put(LZW_CLEAR)
            table.clear()
            size = LZW_END + 1
        code = byte
    codes += [LZW_END] if code is None else [code, LZW_END]
    x, place = np.array(codes, ">u2"), np.arange(len(codes))
    cleared = np.maximum.accumulate(np.where(x == LZW_CLEAR, place, 0))
    since = place[1:] - cleared[:-1] - 1
    widths = np.concatenate([[9], _widths(LZW_LAST)[since]])
    bits = np.unpackbits(x.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def _lzw_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the word of each code of a table starts, and its length.

    The word that a code adds is that of the code before and the next byte, which lie side by
    side in the output; so each code points at an earlier one, and lengths are numbers of steps.
    """
    up = np.where(codes > LZW_END, codes - (LZW_END + 1), -1)
    length = (up >= 0).astype(np.int64)
    while (up >= 0).any():
        length += np.where(up >= 0, length[up], 0)
        up = np.where(up >= 0, up[up], -1)
    length += 1
    return np.cumsum(length) - length, length


def _lzw_table(codes: np.ndarray, most: int) -> list[bytes]:
    """The bytes of the codes between two clear codes, in parts."""
    if not len(codes):
        return []
    if codes[0] > 255:
        raise ValueError(f"LZW code {codes[0]} at the start of a table")
    wrong = np.flatnonzero(codes > LZW_END + np.arange(len(codes)))
    if len(wrong):
        raise ValueError(f"LZW code {codes[wrong[0]]} in a table of {LZW_END + wrong[0]}")
    head, full = codes[: LZW_FULL + 1], codes[LZW_FULL + 1 :]
    start, length = _lzw_words(head)
    n = int(length.sum())
    if n > most:
        raise ValueError(f"more than the {most} bytes of a strip or tile")
    up = np.where(head > LZW_END, head - (LZW_END + 1), np.arange(len(head)))
    source = np.arange(n, dtype=np.int32) + np.repeat((start[up] - start).astype(np.int32), length)
    while True:  # each byte to the one that it copies, until all have come to single codes
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    single = np.zeros(n, np.uint8)
    single[start] = np.minimum(head, 255)
    out = [single[source].tobytes()]
    for code in full.tolist():  # a full table stays as it is
        at = code - LZW_END - 1
        word = bytes((code,)) if at < 0 else out[0][start[at] : start[at] + length[at] + 1]
        n += len(word)
        if n > most:
            raise ValueError(f"more than the {most} bytes of a strip or tile")
        out.append(word)
    return out


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """All codes of a table are read at once, since their places follow from their number after a clear code."""
    x = np.frombuffer(bytes(data) + bytes(2), np.uint8).astype(np.uint32)
    x = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    out, at, n, more = [], 0, 0, True
    while more:
        asked = LZW_FULL + 2
        while True:
            widths = _widths(asked)
            places = at + np.cumsum(widths) - widths
            whole = places + widths <= 8 * len(x)
            places, widths = places[whole], widths[whole]
            codes = (x[places >> 3] >> (24 - (places & 7) - widths) & ((1 << widths) - 1)).astype(np.int64)
            ends = np.flatnonzero((codes == LZW_CLEAR) | (codes == LZW_END))
            if len(ends) or len(codes) < asked:
                break
            asked *= 2
        if len(ends):
            more, at = codes[ends[0]] == LZW_CLEAR, int(places[ends[0]] + widths[ends[0]])
            codes = codes[: ends[0]]
        else:
            more = False
        parts = _lzw_table(codes, most - n)
        n += sum(map(len, parts))
        out += parts
    return b"".join(out)


def decompress(data: bytes, compression: int, most: int = MOST_BYTES) -> bytes:
    """At most ``most`` bytes; where the data hold more, that is an error or the rest is left."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)  # at most 64 times the data
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {compression}")


# ------------------------------------------------------------------ decoder


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The integer fields of one image directory, and where the next one is."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        where, size = at + 10 + 12 * i, FIELD_BYTES.get(kind, 1) * count
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if kind in (1, 3, 4):
            fields[tag] = list(struct.unpack_from(f"{order}{count}{'.B.HI'[kind]}", data, where))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, following


def _samples(raw: bytes, kind: np.dtype, bits: int, predictor: int, rows: int, w: int, depth: int) -> np.ndarray:
    """The samples of a strip or tile, (rows, w, depth)."""
    if bits < 8:
        row = -(-w * depth * bits // 8)
        packed = np.frombuffer(raw, np.uint8, rows * row).reshape(rows, row)
        single = np.unpackbits(packed, axis=1)[:, : w * depth * bits].reshape(rows, w, depth, bits)
        return single @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    if predictor == 3:  # bytes of equal weight lie together, highest first, and are differences
        size = kind.itemsize
        flat = np.frombuffer(raw, np.uint8, rows * w * depth * size).reshape(rows, -1, depth)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, w * depth)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, w, depth)
    part = np.frombuffer(raw, kind, rows * w * depth).reshape(rows, w, depth)
    return np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else part


def _page(data: bytes, f: dict[int, list[int]], order: str) -> dict:
    one = lambda tag, default=None: f.get(tag, [default])[0]
    width, height, channels, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or predictor not in (1, 2, 3) or predictor > 1 and bits < 8 or len(set(f.get(BITS, [1]))) > 1:
        raise ValueError(f"{f.get(BITS)} bits, predictor {predictor}")
    if not width or not height or not channels:
        raise ValueError("no width, height or channels")
    kind = np.dtype((">" if order == ">" else "<") + f"u{max(1, bits // 8)}")
    planes, depth = (channels, 1) if planar == 2 else (1, channels)
    tiled = TILE_OFFSETS in f
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    if not w or not h:
        raise ValueError("strips or tiles without a size")
    size = kind.itemsize * channels
    if width * height * size > MOST_BYTES or w * h * size > MOST_BYTES:
        raise ValueError(f"{width} x {height} is more than {MOST_BYTES} bytes")
    across, down = -(-width // w), -(-height // h)
    offsets, counts = f[TILE_OFFSETS if tiled else OFFSETS], f[TILE_COUNTS if tiled else COUNTS]
    if not len(offsets) == len(counts) == planes * across * down:
        raise ValueError(f"{len(offsets)} offsets and {len(counts)} lengths for {planes * across * down} strips or tiles")
    picture = np.zeros((planes, height, width, depth), kind.newbyteorder("="))
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * h, rest % across * w
        rows = h if tiled else min(h, height - y)
        raw = data[offset : offset + count]
        if one(FILL_ORDER, 1) == 2:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8)), bitorder="little").tobytes()
        part = _samples(decompress(raw, compression, 2 * w * rows * depth * kind.itemsize + 64), kind, bits, predictor, rows, w, depth)
        picture[plane, y : y + rows, x : x + w] = part[: height - y, : width - x]
    samples = picture[0] if planes == 1 else np.moveaxis(picture[..., 0], 0, 2)
    return {"width": width, "height": height, "bits": bits, "channels": channels, "compression": compression, "predictor": predictor, "tiled": tiled, "samples": samples.tobytes()}


def pages(data: bytes | None) -> Iterator[dict]:
    """All pages of one file, in the order of its directories."""
    if not data:
        return
    number, visited = 0, set()
    blank = dict.fromkeys(("width", "height", "bits", "channels", "compression", "predictor", "tiled", "samples"))
    wrong = lambda e: {"page": number, **blank, "error": f"{type(e).__name__}: {e}"[:200]}
    try:
        order = {b"II*\0": "<", b"MM\0*": ">"}[bytes(data[:4])]
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at and at not in visited:
            visited.add(at)
            fields, at = _directory(data, at, order)
            try:
                page = {"page": number, **_page(data, fields, order), "error": None}
            except Exception as e:  # damaged input is data here: the row says what is wrong
                page = wrong(e)
            yield page
            number += 1
    except Exception as e:  # without this directory, the next one can't be found
        yield wrong(e)


def decode_pages(media: Column) -> Column:
    """An array with all pages of each file; null gives an empty array."""

    @F.pandas_udf(f"array<{PAGE}>")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series([list(pages(f)) for f in files], dtype=object)

    return run(media)


def decode_payload(media: Column) -> Column:
    """The samples of all pages of a file as one binary, with ``feature`` of them; a page in error fails the task.

    Null where a file has no page.
    """

    @F.pandas_udf("payload binary, feature string")
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for file in files:
            found = list(pages(file))
            wrong = [p["error"] for p in found if p["error"]]
            if wrong:
                raise ValueError(wrong[0])
            payload = b"".join(p["samples"] for p in found)
            rows.append((payload, feature(payload, [(p["width"], p["height"]) for p in found])) if found else (None, None))
        return pd.DataFrame(rows, columns=["payload", "feature"])

    return run(media)


def read_tiff(df: DataFrame, media: str, id_col: str) -> DataFrame:
    """One row per page: the identifier and the fields of PAGE."""
    small_batches(df.sparkSession, 500)
    return df.select(F.col(id_col), F.explode(decode_pages(F.col(media))).alias("p")).select(id_col, "p.*")


# ------------------------------------------------------------------ encoder

#: Compression, predictor and tiling that pages take in turn.
STYLES = ((PACKBITS, 1, False), (LZW, 1, False), (DEFLATE, 2, True), (NONE, 1, True), (DEFLATE, 1, False))


def encode(payload: bytes, width: int = 144, page_rows: int = 512, strip_rows: int = 64, tile: int = 48) -> bytes:
    """Grey pages that hold ``payload``, whose length must be a multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0" + bytes(4)), 4
    for number, top in enumerate(range(0, len(rows), page_rows)):
        page = rows[top : top + page_rows]
        compression, predictor, tiled = STYLES[(number + len(rows) // 4) % len(STYLES)]
        if tiled:
            blocks = []
            for y in range(0, len(page), tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            if compression == PACKBITS:
                data = b"".join(packbits_encode(r.tobytes()) for r in block)
            elif compression == LZW:
                data = lzw_encode(block.tobytes())
            else:
                data = zlib.compress(block.tobytes(), 4) if compression == DEFLATE else block.tobytes()
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += bytes(len(out) % 2)
        lists = {}
        for name, values in (("offsets", offsets), ("counts", counts)):
            lists[name] = len(out) if len(values) > 1 else values[0]
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        n = len(offsets)
        entries = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        entries += [(TILE_WIDTH, 3, 1, tile), (TILE_HEIGHT, 3, 1, tile), (TILE_OFFSETS, 4, n, lists["offsets"]), (TILE_COUNTS, 4, n, lists["counts"])] if tiled else [(OFFSETS, 4, n, lists["offsets"]), (ROWS, 4, 1, strip_rows), (COUNTS, 4, n, lists["counts"])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
        link = len(out)
        out += bytes(4)
    return bytes(out)


def feature(payload: bytes, sizes: list[tuple[int, int]]) -> str:
    """Pages, size of the first, mean grey, and a 64-bit average hash of 64 equal stretches."""
    x = np.frombuffer(payload, np.uint8)
    bounds = np.linspace(0, len(x), 65).astype(int)
    means = np.add.reduceat(x.astype(np.int64), bounds[:-1]) / np.diff(bounds)
    bits = int.from_bytes(np.packbits(means > means.mean()).tobytes(), "big")
    return f"{len(sizes)}:{sizes[0][0]}x{sizes[0][1]}:{x.mean():.2f}:{bits:016x}"
