"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialize, new_folder, shared_root  # noqa: F401 - used by the operators

U64 = np.uint64
#: Odd multipliers for mixing 64-bit hashes (any odd constants would do).
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=U64,
)


# ------------------------------------------------------------------ shared storage


def mounted_path(uri: str) -> str:
    """The path by which any worker opens files of a ``file:`` folder."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {uri!r}")
    return parts.path if parts.scheme else uri


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def give_back_memory() -> None:
    """Return what is freed to the system: workers are reused by later tasks, which would otherwise add to what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a whole text column, by one native aggregate."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier's text modulo ``modulus``; a null identifier counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


# ------------------------------------------------------------------ words and hashes


def word_hashes(texts: pa.Array | pa.ChunkedArray, lower: bool = True, *parts: Callable[[str], str]) -> tuple[np.ndarray, ...]:
    """Split at ASCII white space (A-Z lowered first) and hash the words.

    Returns the number of words of each text and the 64-bit hashes of all words in order, then
    those of each part of the words that is asked for. A null text counts as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        flat, owner = flat.filter(full), owner[keep]
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    if not len(flat):
        return counts, *[np.empty(0, U64)] * (1 + len(parts))
    coded = flat.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashed = [np.array([xxhash.xxh3_64_intdigest(part(w) if part else w) for w in words], dtype=U64)[at] for part in (None, *parts)]
    return counts, *hashed


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all bits (an xor-multiply finalizer)."""
    x = x ^ (x >> U64(32))
    x = x * _MULTIPLIERS[3]
    return x ^ (x >> U64(29))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive words that start at each position where they fit."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, U64)
    for j in range(n):
        out = mix(out * _MULTIPLIERS[0] + words[j : j + size] * _MULTIPLIERS[1] + U64(j + 1))
    return out


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch for mapInArrow from numpy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()],
        schema=schema,
    )
