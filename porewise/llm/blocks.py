"""Packed blocks of arrays, which tasks send to shards of the hash space."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from .common import U64

#: To so many shards or groups of shards does a task deal its chunks at once.
FAN_OUT = 4096


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 1 + 10 * raw[0], []
    for i in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * i)
        out.append(np.frombuffer(raw, np.dtype("<" + kind.decode()), n, at))
        at += out[-1].nbytes
    return out


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash space, so that a shard's keys are contiguous."""
    return (((keys >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def group_size(n_shards: int, fan_out: int) -> int:
    """How many neighbouring shards make a group, so that there are at most ``fan_out`` groups; 1 if no groups are needed.

    With groups, blocks stay of a useful size however many shards there are: a chunk is dealt to
    groups, and what a group has gathered is dealt to its shards.
    """
    return -(-n_shards // fan_out)


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds all values."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
