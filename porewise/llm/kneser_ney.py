"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting takes two shuffles of packed blocks. Each task counts the bigrams of bounded chunks
of its texts; blocks go to the shard of the *bigram's* hash, so a frequent context spreads
over all shards. A shard merges its blocks into one sorted hash array with counts, and sends
what it knows of each word (as context and as continuation) on to word shards, where frequent
words arrive already summed. Both kinds of shard are written as plain numpy files in the
shared folder, which workers memory-map to score; no model passes through the driver. A shard that
cannot be opened, and is not known to be empty, fails the task.

Probability of a word w after v, with c, the context's totals and the discounts D of order 2,
and continuation counts k (different words before w) of order 1:

    p(w|v) = max(c(v,w) - D(c), 0) / c(v) + g(v) * q(w)
    q(w)   = max(k(w) - d(k), 0) / types + g * 1/(V+1)

The words of a text are preceded by a start mark and followed by one end token. All texts
count: a null text is an empty one; repeated rows count repeatedly; an empty table yields a
model in which every word has the same probability.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import FAN_OUT, group_size, narrow, pack, shard_of, unpack
from .common import U64, materialize, mix, mounted_path, new_folder, record_batch, small_batches, text_bytes, word_hashes

START, END = U64(0x5354415254), U64(0x454E44)
BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.binary())])
WORD_COLUMNS = ("total", "n1", "n2", "n3", "continuations")


# ------------------------------------------------------------------ counted blocks


def bigram_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * U64(0x9E3779B97F4A7C15) + second)


def with_marks(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of each token (end tokens included), and the text that it belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    second = np.empty(len(owner), U64)
    is_end = np.zeros(len(owner), bool)
    is_end[ends] = True
    second[is_end], second[~is_end] = END, words
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[ends - counts] = START
    return first, second, owner


def _count_blocks(first: np.ndarray, second: np.ndarray, often: np.ndarray | None, n_shards: int, per_group: int) -> pa.RecordBatch:
    """The distinct bigrams of one chunk with counts, one block for each shard, or for each group of so many shards."""
    vocabulary, index = np.unique(np.concatenate([first, second]), return_inverse=True)
    pairs, at, count = np.unique(index[: len(first)] * len(vocabulary) + index[len(first) :], return_inverse=True, return_counts=True)
    if often is not None:
        count = np.bincount(at, often, len(pairs)).astype(np.int64)
    i, j = pairs // len(vocabulary), pairs % len(vocabulary)
    shard = shard_of(bigram_key(vocabulary[i], vocabulary[j]), n_shards) // per_group
    order = np.argsort(shard, kind="stable")
    shards, begins = np.unique(shard[order], return_index=True)
    blocks = []
    for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
        rows = order[a:b]
        own, local = np.unique(np.concatenate([i[rows], j[rows]]), return_inverse=True)
        first_at, second_at = local[: len(rows)], local[len(rows) :]
        blocks.append(pack(vocabulary[own], narrow(np.diff(first_at, prepend=0)), narrow(second_at), narrow(count[rows])))
    return record_batch(BLOCK, shard=shards.astype(np.int32), block=blocks)


def _bigrams_of(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, a, b, count = unpack(block)
    return words[np.cumsum(a.astype(np.int64))], words[b], count.astype(np.uint32)


def _counter(n_shards: int, per_group: int, chunk_words: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            first, second, _ = with_marks(*word_hashes(batch.column(0)))
            for at in range(0, len(first), chunk_words):
                held.append((first[at : at + chunk_words], second[at : at + chunk_words]))
                size += len(held[-1][0])
                if size >= chunk_words:
                    yield _count_blocks(*map(np.concatenate, zip(*held, strict=True)), None, n_shards, per_group)
                    held, size = [], 0
        if size:
            yield _count_blocks(*map(np.concatenate, zip(*held, strict=True)), None, n_shards, per_group)

    return run


def _regroup(n_shards: int, chunk_words: int):
    """Second step of the scatter: the blocks of some groups, taken together up to a chunk's size, to their shards."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for block in batch.column(1):
                held.append(_bigrams_of(block.as_py()))
                size += len(held[-1][0])
                if size >= chunk_words:
                    yield _count_blocks(*map(np.concatenate, zip(*held, strict=True)), n_shards, 1)
                    held, size = [], 0
        if size:
            yield _count_blocks(*map(np.concatenate, zip(*held, strict=True)), n_shards, 1)

    return run


# ------------------------------------------------------------------ shards


def save(path: str, array: np.ndarray) -> None:
    """Write so that a second attempt of the task replaces the file as a whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def _counts_of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


STATS = ("n1", "n2", "n3", "n4", "tokens", "types")
MERGED = "own int, shard int, block binary, " + ", ".join(f"{k} long" for k in STATS)


def _merge_bigrams(folder: str, n_words: int):
    def run(table: pa.Table) -> pa.Table:
        first, second, count = [], [], []
        for block in table.column("block"):
            for held, part in zip((first, second, count), _bigrams_of(block.as_py()), strict=True):
                held.append(part)
        first, second, count = map(np.concatenate, (first, second, count))
        keys = bigram_key(first, second)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, total = keys[starts], np.add.reduceat(count[order].astype(np.int64), starts)
        first, second = first[order[starts]], second[order[starts]]
        shard = table.column("shard")[0].as_py()
        save(f"{folder}/bigrams-{shard}.key.npy", keys)
        save(f"{folder}/bigrams-{shard}.count.npy", total.astype(np.uint32 if total.max() < 1 << 32 else np.int64))
        # what this shard knows of words: as contexts (total, followers seen once, twice, more often) and as followers
        one = np.ones(len(total), np.int64)
        context = _sum_by(first, total, (total == 1) * one, (total == 2) * one, (total > 2) * one)
        follower = _sum_by(second, one)
        words = np.concatenate([context[0], follower[0]])
        zero = np.zeros(len(follower[0]), np.int64)
        known = _sum_by(words, *(np.concatenate([v, zero]) for v in context[1:]), np.concatenate([np.zeros(len(context[0]), np.int64), follower[1]]))
        to = shard_of(known[0], n_words)
        bounds = np.searchsorted(to, np.arange(n_words + 1))
        full = [int(s) for s in np.flatnonzero(np.diff(bounds))]
        blocks = [pack(known[0][bounds[s] : bounds[s + 1]], *(narrow(v[bounds[s] : bounds[s + 1]]) if v.max() < 1 << 32 else v[bounds[s] : bounds[s + 1]] for v in known[1:])) for s in full]
        stats = dict(zip(STATS, [*_counts_of_counts(total), int(total.sum()), len(keys)], strict=True))
        rest = [0] * (len(full) - 1)
        return pa.table({"own": pa.array([shard] * len(full), pa.int32()), "shard": pa.array(full, pa.int32()), "block": pa.array(blocks, pa.binary())} | {k: pa.array([v, *rest], pa.int64()) for k, v in stats.items()})

    return run


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in table.column("block")]
        keys, *values = (np.concatenate([p[k].astype(U64 if k == 0 else np.int64) for p in parts]) for k in range(6))
        keys, *values = _sum_by(keys, *values)
        shard = table.column("shard")[0].as_py()
        save(f"{folder}/words-{shard}.key.npy", keys)
        for name, v in zip(WORD_COLUMNS, values, strict=True):
            save(f"{folder}/words-{shard}.{name}.npy", v.astype(np.uint32 if v.max() < 1 << 32 else np.int64))
        k = values[-1]
        return pa.table({"own": pa.array([shard], pa.int32())} | {n: pa.array([x], pa.int64()) for n, x in zip(STATS, [*_counts_of_counts(k), 0, int((k > 0).sum())], strict=True)})

    return run


@lru_cache(maxsize=24_000)  # a process may usually map 65,530 files
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def _look_up(folder: str, kind: str, n_shards: int, empty: frozenset[int], keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """Values of sorted ``keys`` in the mapped shards; 0 where a key is absent."""
    out = [np.zeros(len(keys), np.int64) for _ in names]
    shards, begins = np.unique(shard_of(keys, n_shards), return_index=True)
    begins = np.append(begins, len(keys))
    for s, a, b in zip(shards.tolist(), begins[:-1], begins[1:], strict=True):
        if s in empty:
            continue
        there = _mapped(f"{folder}/{kind}-{s}.key.npy")
        at = np.minimum(np.searchsorted(there, keys[a:b]), len(there) - 1)
        hit = there[at] == keys[a:b]
        for values, name in zip(out, names, strict=True):
            values[a:b][hit] = _mapped(f"{folder}/{kind}-{s}.{name}.npy")[at[hit]]
    return out


# ------------------------------------------------------------------ model


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the counts of counts.

    Where a count of counts is 0 the formula has no value; half the count is taken instead.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if low else k / 2
        out.append(min(max(d, 0.05), float(k)))
    return tuple(out)


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0.0, *d])[np.minimum(count, 3)]


@dataclass(frozen=True)
class KneserNeyModel:
    """Where the arrays are, and the few numbers that hold for all words."""

    folder: str
    n_shards: int
    n_words: int
    texts: int
    tokens: int
    types: int
    vocabulary: int
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    low_rest: float
    #: Shards of bigrams and of words that hold nothing and have no files.
    empty: tuple[frozenset[int], frozenset[int]]

    def score(self, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, log10 of its add-0.1 unigram and model probability."""
        first, second, owner = with_marks(counts, words)
        vocabulary, index = np.unique(np.concatenate([first, second]), return_inverse=True)
        i, j = index[: len(first)], index[len(first) :]
        total, n1, n2, n3, k = _look_up(self.folder, "words", self.n_words, self.empty[1], vocabulary, WORD_COLUMNS)
        seen = np.where(vocabulary == END, self.texts, np.where(vocabulary == START, 0, total))
        base = np.log10((seen + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        q = _discounted(k, self.low) / max(1, self.types) + self.low_rest / (self.vocabulary + 1)
        rest = np.where(total > 0, (self.high[0] * n1 + self.high[1] * n2 + self.high[2] * n3) / np.maximum(total, 1), 1.0)
        pairs, at = np.unique(i * len(vocabulary) + j, return_inverse=True)
        a, b = pairs // len(vocabulary), pairs % len(vocabulary)
        keys = bigram_key(vocabulary[a], vocabulary[b])
        order = np.argsort(keys)
        count = np.empty(len(keys), np.int64)
        (count[order],) = _look_up(self.folder, "bigrams", self.n_shards, self.empty[0], keys[order], ("count",))
        p = np.log10(_discounted(count, self.high) / np.maximum(total[a], 1) + rest[a] * q[b])
        add = lambda v: np.bincount(owner, weights=v, minlength=len(counts))
        return counts + 1, add(seen[j] > 0).astype(np.int64), add(base[j]), add(p[at])


def train(docs: DataFrame, text: str = "text", shard_words: int = 4_000_000, chunk_words: int = 2_000_000, fan_out: int = FAN_OUT) -> KneserNeyModel:
    """Count all texts of ``docs``; ``shard_words`` bounds what one merging task gathers.

    Where there are more than ``fan_out`` shards, a chunk goes to groups of shards first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n_shards = max(1, -(-text_bytes(docs, text) // (6 * shard_words)))
    n_words = min(n_shards, 1024)
    folder = mounted_path(new_folder(spark, "kneser-ney"))
    texts = docs.count()
    kind, per_group = "shard int, block binary", group_size(n_shards, fan_out)
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counter(n_shards, per_group, chunk_words), kind)
    if per_group > 1:
        counted = counted.repartition(-(-n_shards // per_group), "shard").mapInArrow(_regroup(n_shards, chunk_words), kind)
    merged = materialize(counted.groupBy("shard").applyInArrow(_merge_bigrams(folder, n_words), MERGED), "kneser-ney-words")
    total = lambda df: [int(x or 0) for x in df.agg(*(F.sum(k).alias(k) for k in STATS)).first()]
    *high, tokens, types = total(merged.select(*STATS))
    words = merged.select("shard", "block").groupBy("shard").applyInArrow(_merge_words(folder), "own int, " + ", ".join(f"{k} long" for k in STATS))
    words = materialize(words, "kneser-ney-sums")  # one row for each shard
    *low, _, vocabulary = total(words)
    empty = tuple(frozenset(range(n)) - {r["own"] for r in df.select("own").distinct().collect()} for df, n in ((merged, n_shards), (words, n_words)))
    d = discounts(*low)
    mass = d[0] * low[0] + d[1] * low[1] + d[2] * (vocabulary - low[0] - low[1])
    return KneserNeyModel(folder, n_shards, n_words, texts, tokens, types, vocabulary, discounts(*high), d, mass / types if types else 1.0, empty)


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: KneserNeyModel, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Score every text; ``keep`` names the columns to carry along. Perplexity is 10 ** (-score / n_tokens)."""
    small_batches(docs.sparkSession)
    shape = docs.select(*(c.alias(k) for k, c in keep.items()))
    names = shape.columns

    def run(batches):
        for batch in batches:
            n, known, base, p = model.score(*word_hashes(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (n, known, np.full(len(n), model.tokens, np.int64), base, p))], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {SCORES}")
