"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One logistic classifier per bit is trained on hashed
byte n-grams; a text goes to the language whose codeword loses least under the classifiers'
margins, each bit weighted by how well its classifier knows that language (loss-weighted
decoding). A text whose two best languages lie close is flagged as ambiguous.

A null text, or one without a letter, is ``und`` with score 0. Training rows with a null
language or identifier are left out, and of rows with one identifier a single one is learned
from; where no labelled row exists, all texts are ``und``. Every language of the training rows
can be predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small_batches
from .sampling import fit_in_one_task, labelled_sample

DIMENSIONS = 1 << 13
#: ASCII bytes that are no letters all count as a space; other bytes stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Damped, normalised counts of hashed byte n-grams (n from 1 to 4) of the whole lowered text."""
    x = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    counts = np.zeros(DIMENSIONS, np.float32)
    gram = np.zeros(len(x), np.uint32)
    for n in range(1, 5):
        if len(x) < n:
            break
        gram = gram[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :]
        slot = ((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        counts += np.bincount(slot, minlength=DIMENSIONS).astype(np.float32)
    counts = np.log1p(counts)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """Rows of +1/-1. Up to 7 languages: all ways to split them in two; more: the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if i == 0 or not b >> (i - 1) & 1 else -1 for b in bits] for i in range(n)], np.float32)
    random, size, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), (-1, None)
    for _ in range(max(1, min(100, 10_000_000 // n**2))):
        code = random.choice(np.array([-1, 1], np.float32), (n, size))
        apart = int(min(((code[i] != code[:i]).sum(1).min() for i in range(1, n))))
        split = np.abs(code.sum(0)) < n
        if split.all() and apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    ambiguity: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, share of belief in it, and whether the runner-up is close."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        margin = features(text) @ self.weights + self.bias
        loss = (self.trust * np.log1p(np.exp(-self.codes * margin))).sum(1)
        belief = np.exp((loss.min() - loss) * 4)
        belief /= belief.sum()
        order = np.argsort(-belief, kind="stable")
        close = len(order) > 1 and float(belief[order[0]] - belief[order[1]]) < self.ambiguity
        return self.languages[order[0]], float(belief[order[0]]), close


def fit(labels: list[str], x: np.ndarray, epochs: int = 30, seed: int = 3, ambiguity: float = 0.2) -> LanguageModel:
    """Train the bit classifiers on rows of features (half precision will do) by Adagrad."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return LanguageModel((), *(np.zeros((0, 0)),) * 4, ambiguity)
    codes = codewords(len(languages))
    number = {k: i for i, k in enumerate(languages)}
    y = np.array([number[k] for k in labels])
    goal = codes[y]
    share = 1 / np.bincount(y, minlength=len(languages))[y]
    share = (share / share.mean()).astype(np.float32)[:, None]
    w, b = np.zeros((DIMENSIONS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
            rows = x[part].astype(np.float32)
            z = goal[part] * (rows @ w + b)
            g = -share[part] * goal[part] / (1 + np.exp(np.clip(z, -30, 30))) / len(part)
            gw, gb = rows.T @ g + 1e-6 * w, g.sum(0)
            seen_w += gw * gw
            seen_b += gb * gb
            w -= 0.3 * gw / np.sqrt(seen_w)
            b -= 0.3 * gb / np.sqrt(seen_b)
    margin = np.concatenate([part.astype(np.float32) @ w + b for part in np.array_split(x, max(1, len(y) // 1024))])
    right = (margin * goal > 0).astype(np.float32)
    trust = np.stack([right[y == i].mean(0) for i in range(len(languages))]) + 1e-3
    return LanguageModel(languages, codes, w, b, trust / trust.sum(1, keepdims=True) * codes.shape[1], ambiguity)


def train(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text: str = "text", per_language: int = 500, most_rows: int = 10_000) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language, and on ``most_rows`` of all (one of each language at least)."""
    sample = labelled_sample(docs, F.col(label).cast("string"), per_language, id_col, text, most_rows=most_rows)

    def packed(batches):
        for batch in batches:
            x = [features(t or "").astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], names=["id", "label", "x"])

    def fitted(table: pa.Table) -> LanguageModel:
        rows = np.stack([np.frombuffer(b, np.float16) for b in table.column("x").to_pylist()])
        return fit(table.column("label").to_pylist(), rows)

    rows = sample.select("id", "label", F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(packed, f"id {rows.schema['id'].dataType.simpleString()}, label string, x binary")
    return fit_in_one_task(rows, fitted) or fit([], np.zeros((0, DIMENSIONS), np.float32))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text"):
    """A struct column (lang, score, ambiguous) for every whole text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(None if pd.isna(t) else t) for t in texts], columns=["lang", "score", "ambiguous"])

    return run(F.col(text).cast(StringType()))
