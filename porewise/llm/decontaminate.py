"""Benchmark decontamination by pigeonhole edit matching.

The unit is the word (letters and digits, lowered), so that case, spacing and punctuation do
not matter; in scripts without spaces each character is a word. A test item of m words may
differ in k = floor(error_rate * m) words. Cut into k + 1 pieces, an occurrence with at most k
edits holds one piece unchanged. Pieces are found by the hash of their first words, checked in
full, and the surroundings of each hit are verified with Myers' bit-parallel edit distance, over
words. Items of so few words that k is 0 (up to 6 at a rate of 0.15) are one piece: they are found
where they stand exactly. Since prose contains short phrases by chance, such an item makes
``remove_leaks`` drop a document only where it is a whole line of the text.

Items are hashed by the executors and compared in blocks of bounded size, each sent to all
tasks; documents are read once for each block and never shuffled. Items without words, and null
items, match nothing; an item with a null identifier is reported with it. A null or empty text
holds nothing. Repeated rows are each reported; item ties are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, gram_hashes, materialize, small_batches, word_hashes

#: Scripts that are written without spaces between words.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the words' hashes; punctuation and case are dropped."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    if not pc.all(pc.string_is_ascii(low)).as_py():
        low = pc.replace_substring_regex(low, r"[\p{Z}\x{85}]+", " ")
    clean = pc.replace_substring_regex(low, r"[^\p{L}\p{N}\s\v]+", "")
    if not pc.all(pc.string_is_ascii(clean)).as_py():
        clean = pc.replace_substring_regex(clean, UNSPACED, r" \1 ")
    return word_hashes(clean, lower=False)


def words_and_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, then how many lines each text has, and how many words each line."""
    lines = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\n\r]+")
    per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    per_line, words = words_of(pc.list_flatten(lines))
    counts = np.add.reduceat(per_line, np.cumsum(per_text) - per_text) if len(per_text) else per_line
    return counts, words, per_text, per_line


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a stretch of ``text``, and where the first best stretch ends."""
    m, masks = len(pattern), {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, w in enumerate(text.tolist(), 1):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


@dataclass(frozen=True)
class ItemBlock:
    """Some test items: the pieces of the longer ones sorted by the hash of their first ``q`` words, the short ones whole."""

    ids: list[int | None]
    items: list[np.ndarray]
    budgets: list[int]
    q: int
    heads: np.ndarray
    owners: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    #: For each length, the sorted hashes of the short items and their numbers.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def build(rows: list[tuple[int | None, np.ndarray]], error_rate: float) -> ItemBlock:
        items = [w for _, w in rows]
        budgets = [int(error_rate * len(w)) for w in items]
        long_ones = [i for i, k in enumerate(budgets) if k]
        cuts = [np.linspace(0, len(items[i]), budgets[i] + 2).astype(int) for i in long_ones]
        none = [np.empty(0, np.int64)]
        owners = np.repeat(np.array(long_ones, np.int64), [len(c) - 1 for c in cuts])
        starts, sizes = np.concatenate(none + [c[:-1] for c in cuts]), np.concatenate(none + [np.diff(c) for c in cuts])
        q = int(sizes.min(initial=1 << 30))
        heads = np.array([gram_hashes(items[o][s : s + q], q)[0] for o, s in zip(owners, starts, strict=True)], U64)
        order = np.argsort(heads, kind="stable")
        short = {}
        for m in sorted({len(w) for w, k in zip(items, budgets, strict=True) if not k}):
            own = np.array([i for i, w in enumerate(items) if len(w) == m])
            hashes = np.array([gram_hashes(items[i], m)[0] for i in own], U64)
            short[m] = np.sort(hashes), own[np.argsort(hashes, kind="stable")]
        return ItemBlock([i for i, _ in rows], items, budgets, q, heads[order], owners[order], starts[order], sizes[order], short)

    def matches(self, words: np.ndarray, lines: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(number of the item, distance, first word, end word) of the best occurrence of each item in one text.

        With ``lines``, where its lines begin and the last one ends, short items count only as whole lines.
        """
        yield from self._short_matches(words, lines)
        grams = gram_hashes(words, self.q) if len(self.heads) else words[:0]
        if not len(grams):
            return
        low = np.searchsorted(self.heads, grams)
        at = np.flatnonzero(self.heads[np.minimum(low, len(self.heads) - 1)] == grams)
        places: dict[int, list[int]] = {}
        for p in at.tolist():
            i = int(low[p])
            while i < len(self.heads) and self.heads[i] == grams[p]:
                o, s, n = int(self.owners[i]), int(self.starts[i]), int(self.sizes[i])
                if np.array_equal(words[p : p + n], self.items[o][s : s + n]):
                    places.setdefault(o, []).append(p - s)
                i += 1
        for o, begins in places.items():
            k, item, best = self.budgets[o], self.items[o], None
            m = len(item)
            for begin in sorted(set(begins)):
                if begin >= 0 and np.array_equal(words[begin : begin + m], item):
                    best = (0, begin, begin + m)
                    break
                left = max(0, begin - k)
                distance, end = myers(item, words[left : begin + m + k])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, max(0, left + end - m), left + end)
            if best:
                yield o, *best

    def _short_matches(self, words: np.ndarray, lines: np.ndarray | None) -> Iterator[tuple[int, int, int, int]]:
        for m, (hashes, owners) in self.short.items():
            grams = gram_hashes(words, m)
            if not len(grams):
                continue
            low = np.searchsorted(hashes, grams)
            hit = hashes[np.minimum(low, len(hashes) - 1)] == grams
            if lines is not None:
                hit &= np.isin(np.arange(len(grams)), lines[:-1][np.diff(lines) == m])
            at = np.flatnonzero(hit)
            for i, p in zip(*(x.tolist() for x in np.unique(low[at], return_index=True)), strict=True):
                first = int(at[p])
                while i < len(hashes) and hashes[i] == grams[first]:
                    if np.array_equal(words[first : first + m], self.items[owners[i]]):
                        yield int(owners[i]), 0, first, first + m
                    i += 1


def item_blocks(benchmark: DataFrame, id_col: str, text: str, error_rate: float, block_words: int) -> Iterator[ItemBlock]:
    """Blocks of at most ``block_words`` words (a longer item makes a block of its own), drawn one at a time."""

    def hashed(batches):
        for batch in batches:
            counts, words = words_of(batch.column(1))
            packed = pa.array([w.tobytes() for w in np.split(words, np.cumsum(counts)[:-1])] if len(counts) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "words"])

    items = benchmark.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(hashed, "id long, words binary").where("length(words) > 0")
    held, size = [], 0
    for row in items.toLocalIterator():
        words = np.frombuffer(row["words"], U64)
        if held and size + len(words) > block_words:
            yield ItemBlock.build(held, error_rate)
            held, size = [], 0
        held.append((row["id"], words))
        size += len(words)
    if held:
        yield ItemBlock.build(held, error_rate)


FOUND = "`{id}` long, item_id long, distance int, budget int, item_words int, first_word int, end_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.15, block_words: int = 1_000_000) -> DataFrame:
    """One row for each document and test item that it holds with at most the item's budget of edits.

    Blocks of items are searched one after another, so one block at a time is sent to the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias("__text"))
    schema = FOUND.format(id=id_col)

    def against(shared) -> DataFrame:
        def run(batches):
            for batch in batches:
                counts, words = words_of(batch.column(1))
                out, begin = [], 0
                for doc, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                    for i, distance, first, end in shared.value.matches(words[begin : begin + n]):
                        out.append((doc, shared.value.ids[i], distance, shared.value.budgets[i], len(shared.value.items[i]), first, end))
                    begin += n
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
                columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[id_col, "item_id", "distance", "budget", "item_words", "first_word", "end_word"])

        return rows.mapInArrow(run, schema)

    found = []
    for block in item_blocks(benchmark, item_id, item_text, error_rate, block_words):
        shared = spark.sparkContext.broadcast(block)
        found.append(materialize(against(shared), "leaks"))
        shared.unpersist()
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text: str = "text", error_rate: float = 0.15, block_words: int = 1_000_000) -> DataFrame:
    """The documents that hold no test item; one without a budget (of up to 6 words) counts only where it is a whole line.

    The text itself decides row by row, so no join by identifier can drop a clean row. With several blocks
    of items, what a block leaves is written before the next is drawn, so one block at a time is sent to the tasks.
    """
    small_batches(docs.sparkSession)
    clean, before = docs, None
    for block in item_blocks(benchmark, id_col, text, error_rate, block_words):
        if before is not None:
            clean = materialize(clean, "without-leaks")
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(block)
        clean = clean.where(~_leaks(before)(F.col("text").cast("string")))
    return clean


def _leaks(shared):
    def run(texts: pd.Series) -> pd.Series:
        texts, lines = pa.array(texts, pa.string(), from_pandas=True), None
        if shared.value.short:
            counts, words, per_text, per_line = words_and_lines(texts)
            bounds = [np.append(0, np.cumsum(x)) for x in np.split(per_line, np.cumsum(per_text)[:-1])]
            lines = iter(bounds)
        else:
            counts, words = words_of(texts)
        return pd.Series([any(True for _ in shared.value.matches(w, next(lines) if lines else None)) for w in np.split(words, np.cumsum(counts)[:-1])], dtype=bool)

    return F.pandas_udf(run, "boolean")
