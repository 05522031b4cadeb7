"""Toxicity: a convolutional text classifier in numpy, with thresholds for each language.

A word's vector joins two rows of hashed embedding tables, one chosen by the hash of the word
and one by that of its stem (its first STEM letters), so that rare forms of a word share what is
learned of their stem. Words and stems that fewer than MIN_TEXTS training texts hold share the
zero vector of the padding. The first number of a known word's vector begins as its log odds in
the training texts, which the first filter reads; training goes on from there. Filters of one, two and three words slide over the whole text; each
filter's largest response goes into a logistic unit.

Training runs in small batches on a bounded sample of labelled rows. All labelled rows that are
not trained on are scored and set a threshold for each language; scores are shifted so that 0.5
is that threshold. The language is the likeliest by the words of the text itself, from word
counts of training rows that name their language. Only counts of rows by language, label and bin of the
logit reach the driver; they are weighted to the shares that both labels have among all labelled
rows, so that a cut does not depend on how much was trained on, and each language's counts are
joined by PRIOR_ROWS rows' worth of all languages, so that few rows of one decide little.

A null text is an empty one and is scored like any other. Rows with a null label are not
learned from; without any labelled row of both kinds, every score is 0. Without any row that
names its language, there is one threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, give_back_memory, mix, small_batches, word_hashes
from .sampling import fit_in_one_task, labelled_sample

BUCKETS, HALF, FILTERS, WIDTHS, MIN_TEXTS, STEM = 1 << 16, 8, 12, (1, 2, 3), 3, 5
PAD = max(WIDTHS) - 1
#: Rows trained on: so many toxic ones at most, and twice as many others.
LEARN_ROWS = 1200
#: Logits are counted in bins of 1 / BIN, between -LIMIT and LIMIT.
BIN, LIMIT = 64, 32
#: Each language's counts are joined by as many rows of all languages together, which decide where its own are few.
PRIOR_ROWS = 300
UNKNOWN = "und"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered words of letters and digits: how many in each text, the hashes of the words and of their stems."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}\s]+", " ")
    return word_hashes(clean, False, lambda w: w[:STEM])


def _rows(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Table rows; row 0 is for the padding and for hashes that aren't in the sorted ``known``."""
    there = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
    return np.where(there, (mix(hashes) % U64(BUCKETS - 1)).astype(np.int32) + 1, 0)


def _padded(counts: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where texts begin, and which positions start a window; then the table rows of all texts, each followed by padding."""
    room = np.maximum(counts, 1) + PAD
    begin = np.cumsum(room) - room
    at = np.arange(int(room.sum())) - np.repeat(begin, room)
    real = at < np.repeat(counts, room)
    out = [np.zeros(len(at), np.int32) for _ in rows]
    for padded, r in zip(out, rows, strict=True):
        padded[real] = r
    return begin, at < np.repeat(np.maximum(counts, 1), room), *out


@dataclass
class WordLanguages:
    """Log probabilities of hashed words in each language."""

    names: tuple[str, ...]
    weights: np.ndarray

    @staticmethod
    def fit(labels: list[str], texts: list[np.ndarray]) -> WordLanguages:
        names = tuple(sorted(set(labels)))
        counts = np.zeros((len(names), BUCKETS))
        for label, words in zip(labels, texts, strict=True):
            counts[names.index(label)] += np.bincount((words % U64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        return WordLanguages(names, np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32))

    def of(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The likeliest language of each text; one more than there are where a text has no words."""
        best, out = np.full(len(counts), -np.inf), np.full(len(counts), len(self.names))
        some, bucket = counts > 0, (words % U64(BUCKETS)).astype(np.int32)
        begin = (np.cumsum(counts) - counts)[some]
        for i, weights in enumerate(self.weights if len(begin) else ()):
            total = np.full(len(counts), -np.inf)
            total[some] = np.add.reduceat(weights[bucket].astype(np.float64), begin)
            better = total > best
            best[better], out[better] = total[better], i
        return out


@dataclass
class ToxicityModel:
    first: np.ndarray
    second: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    words: np.ndarray
    stems: np.ndarray
    fitted: bool = True
    language: WordLanguages | None = None
    thresholds: np.ndarray | None = None

    @property
    def languages(self) -> tuple[str, ...]:
        return (*(self.language.names if self.language else ()), UNKNOWN)

    def language_of(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Index into ``languages`` of each text."""
        return self.language.of(counts, words) if self.language else np.zeros(len(counts), np.int64)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each position of a padded sequence of word vectors."""
        n = len(x) - PAD
        return [sum(x[j : j + n] @ f[j] for j in range(k)) + b for k, f, b in zip(WIDTHS, self.filters, self.bias, strict=True)]

    def pooled(self, begin: np.ndarray, starts: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The responses, and each text's largest."""
        found = self.responses(x)
        for r in found:
            r[~starts[: len(r)]] = -np.inf
        return found, [np.maximum.reduceat(r, begin, axis=0) for r in found]

    def logits(self, counts: np.ndarray, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        begin, starts, one, two = _padded(counts, _rows(words, self.words), _rows(stems, self.stems))
        _, best = self.pooled(begin, starts, np.concatenate([self.first[one], self.second[two]], 1))
        return np.maximum(np.concatenate(best, 1), 0) @ self.out + np.float32(self.out_bias)

    def all_logits(self, counts: np.ndarray, words: np.ndarray, stems: np.ndarray, words_at_once: int = 1 << 17) -> np.ndarray:
        """Logits of many texts, taken in groups of bounded total length (a longer text makes a group of its own)."""
        ends, out, i = np.cumsum(counts), [np.zeros(0, np.float32)], 0
        while i < len(counts):
            begin = ends[i - 1] if i else 0
            k = max(i + 1, int(np.searchsorted(ends, begin + words_at_once, "right")))
            out.append(self.logits(counts[i:k], words[begin : ends[k - 1]], stems[begin : ends[k - 1]]))
            i = k
        return np.concatenate(out)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores of whole texts."""
        if not self.fitted:
            return np.zeros(len(texts))
        counts, words, stems = words_of(texts)
        z = self.all_logits(counts, words, stems).astype(np.float64)
        if self.thresholds is not None:
            z -= self.thresholds[self.language_of(counts, words)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bins(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z.astype(np.float64), -LIMIT, LIMIT - 1 / BIN) * BIN).astype(np.int64)


def _threshold(counts: np.ndarray) -> float:
    """The logit with the best F1, from (label, bin) weights; of equal cuts, the middle of the widest gap."""
    at = np.flatnonzero(counts.sum(0))[::-1]
    hits, flagged = np.cumsum(counts[1, at]), np.cumsum(counts[:, at].sum(0))
    f1 = 2 * hits / (flagged + hits[-1])
    low, below = at / BIN - LIMIT, (at[1:] + 1) / BIN - LIMIT
    gap = np.append(low[:-1] - below, 4.0)
    best = max(range(len(at)), key=lambda i: (round(float(f1[i]), 9), float(gap[i])))
    return float(low[best] - gap[best] / 2)


def thresholds(counts: np.ndarray) -> np.ndarray:
    """The cut of each language, from counts of rows by (trained on, language, label, bin).

    Rows trained on count only towards the labels' shares, unless a label has no others.
    """
    held = counts[0].astype(np.float64)
    if not held.sum((0, 2)).all():
        held = counts.sum(0).astype(np.float64)
    rows = held.sum((0, 2))
    if not rows.all():
        return np.zeros(counts.shape[1])
    held *= (counts.sum((0, 1, 3)) / rows)[None, :, None]
    everyone = held.sum(0)
    return np.array([_threshold(own + everyone * (PRIOR_ROWS / everyone.sum())) for own in held])


def _held_out(labels: np.ndarray, most: dict[int, int]) -> np.ndarray:
    """Rows that are not trained on: every fifth of either kind, and what exceeds the rows to train on."""
    held = np.ones(len(labels), bool)
    for label, n in most.items():
        own = np.flatnonzero(labels == label)
        held[own[np.arange(len(own)) % 5 != 4][:n]] = False
    return held


def _known(texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What at least MIN_TEXTS training texts hold, and how many standard errors its log odds of a toxic text are above 0."""
    kinds, at = np.unique(np.concatenate([np.empty(0, U64), *map(np.unique, texts)]), return_inverse=True)
    toxic = np.bincount(at, np.repeat(labels, [len(np.unique(t)) for t in texts]), len(kinds)) + 0.5
    clean = np.bincount(at, minlength=len(kinds)) + 1.0 - toxic
    odds = np.log(toxic / (labels.sum() + 1)) - np.log(clean / ((1 - labels).sum() + 1))
    keep = toxic + clean > MIN_TEXTS
    return kinds[keep], (odds / np.sqrt(1 / toxic + 1 / clean))[keep]


def _step(table: np.ndarray, seen: np.ndarray, gradient: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
    """An Adagrad step, of some rows of a table (row 0 stays) or of a whole array."""
    if rows is None:
        seen += gradient * gradient
        table -= rate * gradient / np.sqrt(seen)
        return
    kinds, at = np.unique(rows, return_inverse=True)
    total = np.zeros((len(kinds), gradient.shape[1]), np.float32)
    np.add.at(total, at, gradient)
    kinds, total = kinds[kinds > 0], total[kinds > 0]
    seen[kinds] += total * total
    table[kinds] -= rate * total / np.sqrt(seen[kinds])


def fit(texts: list[np.ndarray], stems: list[np.ndarray], labels: np.ndarray, learn_rows: int = LEARN_ROWS, epochs: int = 8, seed: int = 5, rate: float = 0.1, at_once: int = 4) -> ToxicityModel:
    """Train by Adagrad on the hash sequences of ``learn_rows`` toxic and twice as many other rows; the cuts are left unset."""
    random = np.random.default_rng(seed)
    held = _held_out(labels, {0: 2 * learn_rows, 1: learn_rows})
    learn = np.flatnonzero(~held)
    words, stems_known = (_known([t[i] for i in learn], labels[learn]) for t in (texts, stems))

    def table(known: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Small random vectors, whose first number tells the odds; the first filter begins by reading it."""
        out = np.vstack([np.zeros((1, HALF)), random.normal(0, 0.01, (BUCKETS - 1, HALF))]).astype(np.float32)
        out[_rows(known, known), 0] = odds / 3
        return out

    m = ToxicityModel(table(*words), table(*stems_known), [random.normal(0, 0.3, (k, 2 * HALF, FILTERS)).astype(np.float32) for k in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(random.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32), 0.0, words[0], stems_known[0])
    m.filters[0][0, [0, HALF], 0], m.out[0] = 1, 1
    y = labels.astype(np.float32)
    if not 0 < y.sum() < len(y):
        m.fitted = False
        return m
    weight = np.where(y == 1, (1 - y[learn]).sum() / max(1, y[learn].sum()), 1.0).astype(np.float32)
    rows = {i: (_rows(texts[i], m.words), _rows(stems[i], m.stems)) for i in learn.tolist()}
    out_bias = np.zeros(1, np.float32)
    seen = [np.full_like(a, 0.3) for a in (m.first, m.second, m.out, out_bias, *m.filters, *m.bias)]
    for epoch in range(epochs):
        order = random.permutation(learn)
        for part in (order[i : i + at_once] for i in range(0, len(order), at_once)):
            counts = np.array([len(rows[i][0]) for i in part])
            one, two = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            if epoch:  # texts are shortened at random places so that filters don't count on rare words
                keep = random.random(len(one)) > 0.2
                counts = np.bincount(np.repeat(np.arange(len(part)), counts)[keep], minlength=len(part))
                one, two = one[keep], two[keep]
            begin, starts, one, two = _padded(counts, one, two)
            x = np.concatenate([m.first[one], m.second[two]], 1)
            found, best = m.pooled(begin, starts, x)
            owner = np.repeat(np.arange(len(part)), np.diff(np.append(begin, len(x))))
            top = np.maximum(np.concatenate(best, 1), 0)
            z = top @ m.out + out_bias[0]
            g = (weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part])).astype(np.float32)
            d_top = g[:, None] * m.out * (top > 0)
            dx, steps = np.zeros_like(x), []
            for k, (width, r, b) in enumerate(zip(WIDTHS, found, best, strict=True)):
                d = d_top[:, k * FILTERS : (k + 1) * FILTERS]
                # the first position of each text with the filter's largest response
                place = np.minimum.reduceat(np.where(r == b[owner[: len(r)]], np.arange(len(r))[:, None], len(x)), begin, axis=0)
                df = np.empty_like(m.filters[k])
                for j in range(width):
                    df[j] = np.einsum("tfd,tf->df", x[place + j], d)
                    np.add.at(dx, (place + j).ravel(), (d[:, :, None] * m.filters[k][j].T[None]).reshape(-1, 2 * HALF))
                steps += [(m.filters[k], seen[4 + k], df), (m.bias[k], seen[4 + len(WIDTHS) + k], d.sum(0))]
            for array, acc, gradient in [*steps, (m.out, seen[2], g @ top), (out_bias, seen[3], g.sum(keepdims=True))]:
                _step(array, acc, gradient, rate)
            used = np.flatnonzero(dx.any(1))
            _step(m.first, seen[0], dx[used, :HALF], rate, one[used])
            _step(m.second, seen[1], dx[used, HALF:], rate, two[used])
    m.out_bias = float(out_bias[0])
    return m


def _hashed(sample: DataFrame) -> DataFrame:
    """(id, label, words, stems) of a sample's rows, packed."""

    def run(batches):
        for batch in batches:
            counts, *flat = words_of(batch.column(2))
            packed = [pa.array([w.tobytes() for w in np.split(f, np.cumsum(counts)[:-1])], pa.binary()) for f in flat]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *packed], names=["id", "label", "words", "stems"])

    kinds = {k: sample.schema[k].dataType.simpleString() for k in ("id", "label")}
    rows = sample.select("id", "label", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, words binary, stems binary")


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The hashes of each text, without a copy."""
    return [np.frombuffer(x.as_buffer(), U64) for x in column]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = 3000, learn_rows: int = LEARN_ROWS, per_language: int = 500) -> ToxicityModel:
    """Fit on a sample of labelled rows, and set the cuts by all labelled rows.

    The sample has at most ``per_label`` rows of either kind; of it, ``learn_rows`` toxic and twice
    as many other rows set the weights. The languages are learned from at most ``per_language`` rows
    of each that ``docs`` names, whether labelled or not. Of repeated labels, the largest counts.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__label"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text")).join(marks, "__id")
    # only identifiers pass the join that ranks them; texts are fetched for the chosen
    small_batches(docs.sparkSession)
    sample = labelled_sample(rows, F.col("__label"), per_label, "__id", "text")

    def fitted(table: pa.Table) -> tuple[ToxicityModel, list]:
        words, stems = (_unpacked(table.column(c)) for c in ("words", "stems"))
        own = table.column("label").to_numpy().astype(np.int64)
        held = _held_out(own, {0: 2 * learn_rows, 1: learn_rows})
        return fit(words, stems, own, learn_rows), [i for i, h in zip(table.column("id").to_pylist(), held, strict=True) if not h]

    id_type = sample.schema["id"].dataType.simpleString()
    rows = _hashed(sample.withColumn("label", F.col("label").cast("int")))
    model, learned = fit_in_one_task(rows, fitted) or (fit([], [], np.zeros(0, np.int64)), [])
    if model.fitted:
        if lang in docs.columns:
            named = _hashed(labelled_sample(docs, F.col(lang).cast("string"), per_language, id_col, text, most_rows=20 * per_language))
            model.language = fit_in_one_task(named, lambda t: WordLanguages.fit(t.column("label").to_pylist(), _unpacked(t.column("words"))))
        learned = docs.sparkSession.createDataFrame([(i,) for i in learned], f"__id {id_type}")
        model.thresholds = thresholds(_counts(docs, marks, learned, model, id_col, text))
    return model


def _counts(docs: DataFrame, marks: DataFrame, learned: DataFrame, model: ToxicityModel, id_col: str, text: str) -> np.ndarray:
    """Counts of all labelled rows by (trained on, language, label, bin of the logit).

    Rows are scored where they lie, so that no text passes the join with the labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def place(batches):
        for batch in batches:
            counts, words, stems = words_of(batch.column(1))
            at = shared.value.language_of(counts, words) * 2 * LIMIT * BIN + _bins(shared.value.all_logits(counts, words, stems)) + LIMIT * BIN
            del counts, words, stems
            give_back_memory()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32))], names=["__id", "at"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text")).where(F.col("__id").isNotNull())
    placed = rows.mapInArrow(place, f"__id {rows.schema['__id'].dataType.simpleString()}, at int")
    known = learned.withColumn("learned", F.lit(1))
    labelled = placed.join(marks, "__id").join(F.broadcast(known), "__id", "left")
    found = labelled.groupBy(F.coalesce("learned", F.lit(0)).alias("learned"), F.col("__label").cast("int").alias("label"), "at").count().collect()
    out = np.zeros((2, len(model.languages), 2, 2 * LIMIT * BIN), np.int64)
    for r in found:
        language, at = divmod(r["at"], 2 * LIMIT * BIN)
        out[r["learned"], language, r["label"], at] = r["count"]
    return out


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text"):
    """A column with the score of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scores = shared.value.score(pa.array(texts, pa.string(), from_pandas=True))
        give_back_memory()
        return pd.Series(scores)

    return run(F.col(text).cast("string"))
