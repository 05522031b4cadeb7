"""Scores against a plain interpolated modified Kneser-Ney model over dictionaries."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from porewise.llm import kneser_ney

from .helpers import documents, words


class Plain:
    def __init__(self, texts):
        self.pairs, self.unigrams = Counter(), Counter()
        for t in texts:
            w = ["<s>", *words(t), "</s>"]
            self.pairs.update(zip(w, w[1:], strict=False))
            self.unigrams.update(w[1:])
        self.n, self.v = sum(self.unigrams.values()), len(self.unigrams)
        self.before = Counter(b for _, b in self.pairs)
        self.context, self.followers = Counter(), defaultdict(Counter)
        for (a, _), c in self.pairs.items():
            self.context[a] += self.pairs[(a, _)]
            self.followers[a][min(c, 3)] += 1
        self.high, self.low = self._d(self.pairs.values()), self._d(self.before.values())
        self.types = len(self.pairs)

    @staticmethod
    def _d(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        value = lambda k: k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2
        return [0.0] + [min(max(value(k), 0.05), k) for k in (1, 2, 3)]

    def q(self, w):
        k, types = self.before[w], max(1, self.types)
        rest = sum(self.low[min(c, 3)] for c in self.before.values()) / types if self.types else 1.0
        return (k - self.low[min(k, 3)]) / types + rest / (self.v + 1)

    def p(self, a, w):
        c, total = self.pairs[(a, w)], self.context[a]
        if not total:
            return self.q(w)
        rest = sum(self.high[k] * n for k, n in self.followers[a].items()) / total
        return (c - self.high[min(c, 3)]) / total + rest * self.q(w)

    def score(self, t):
        w = ["<s>", *words(t), "</s>"]
        return sum(math.log10(self.p(a, b)) for a, b in zip(w, w[1:], strict=False))

    def base(self, t):
        return sum(math.log10((self.unigrams[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in [*words(t), "</s>"])


def _texts():
    random.seed(1)
    vocabulary = ["the", "The", "a", "cat", "dog", "sat", "on", "mat", "é", "x y", "."]
    out = [" ".join(random.choices(vocabulary, k=random.randint(0, 30))) for _ in range(60)]
    return [*out, None, "", " \t\n", "the the the", "the the the", "never seen words", "a " * 3000]


@pytest.mark.parametrize("shard_words, fan_out", [(4_000_000, 2048), (100, 2048), (20, 6)])
def test_scores(spark, shard_words, fan_out):
    texts = _texts()
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    train = [t for i, t in enumerate(texts) if i % 3]
    model = kneser_ney.train(docs.where("doc_id % 3 <> 0"), shard_words=shard_words, chunk_words=500, fan_out=fan_out)
    plain = Plain(train)
    got = {r["doc_id"]: r for r in kneser_ney.score(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        tokens = [*words(t), "</s>"]
        assert got[i]["n_tokens"] == len(tokens) and got[i]["train_tokens"] == plain.n
        assert got[i]["n_known"] == sum(plain.unigrams[w] > 0 for w in tokens)
        assert got[i]["base_score"] == pytest.approx(plain.base(t))
        assert got[i]["score"] == pytest.approx(plain.score(t))


def test_probabilities_sum_to_one():
    plain = Plain(_texts()[:20])
    for a in ("the", "cat", "unknown"):
        assert sum(plain.p(a, w) for w in [*plain.unigrams, "other"]) == pytest.approx(1)


def test_no_training_text(spark):
    docs = documents(spark, [(1, "a b", "en", "s"), (2, None, None, None)])
    model = kneser_ney.train(docs.where("false"))
    got = kneser_ney.score(docs, model, {"doc_id": F.col("doc_id")}).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in sorted(got)] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert kneser_ney.score(docs.where("false"), model, {"doc_id": F.col("doc_id")}).count() == 0


def test_better_than_unigrams_on_held_out_text(spark, small):
    from porewise.llm.queries import op1_lm_scoring

    got = op1_lm_scoring(spark, small).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_a_lost_shard_is_an_error(spark):
    """Without its files a model must not score as if it had seen nothing; shards that hold nothing have none."""
    from pathlib import Path

    docs = documents(spark, [(i, f"one two three {i % 5}", "en", "s") for i in range(40)])
    model = kneser_ney.train(docs, shard_words=5)
    assert model.n_shards >= 20 and model.empty[0]
    assert not any(Path(f"{model.folder}/bigrams-{i}.key.npy").exists() for i in model.empty[0])
    counts, flat = kneser_ney.word_hashes(kneser_ney.pa.array(["one two three 1 four"]))
    model.score(counts, flat)
    for path in Path(model.folder).glob("bigrams-*.key.npy"):
        path.rename(f"{path}.gone")
    kneser_ney._mapped.cache_clear()
    with pytest.raises(FileNotFoundError):
        model.score(counts, flat)
