"""Language and toxicity: held-out accuracy, odd texts, missing labels."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from porewise.llm import langid, queries, toxicity
from porewise.llm.sampling import labelled_sample

from .helpers import documents

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !?"), (5, "é"), (6, "word " * 200_000), (7, "\U0001f600"), (7, "\U0001f600")]


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_are_apart(n):
    codes = langid.codewords(n)
    distance = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
    assert distance >= (1 if n == 2 else 2 if n == 3 else 4)
    assert all(0 < (codes[:, b] == 1).sum() < n for b in range(codes.shape[1]))


def test_language_of_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    joined = got.join(docs, "doc_id")
    assert got.count() == docs.count()
    right = joined.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    assert joined.where("lang_pred = 'und' and text rlike '[a-zA-Z]'").count() == 0
    assert joined.where("score < 0 or score > 1 or score is null").count() == 0


def test_odd_texts_and_clashing_columns(spark):
    learn = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat sat here and there", "en"), ("der hund lief nach hause", "de"), ("nothing", None), (None, "en")] * 5)])
    model = langid.train(learn)
    assert model.languages == ("de", "en")
    docs = documents(spark, [(i, t, None, None) for i, t in ODD])
    got = docs.select("doc_id", "text", langid.identify(docs, model).alias("p")).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r["p"]["lang"] == "und") == (r["doc_id"] in (1, 2, 3, 4, 7))
    again = docs.select(langid.identify(docs, model).alias("p")).collect()
    assert [r["p"] for r in got] == [r["p"] for r in again]


def _plain_decoder(model, text):
    """Loss of every codeword bit by bit, in plain Python; the nearest codeword and the gap to the next."""
    x = [float(v) for v in langid.features(text)]
    used = [i for i, v in enumerate(x) if v]
    losses = []
    for code, trust in zip(model.codes.tolist(), model.trust.tolist(), strict=True):
        loss = 0.0
        for bit, (sign, weight) in enumerate(zip(code, trust, strict=True)):
            margin = sum(x[i] * float(model.weights[i, bit]) for i in used) + float(model.bias[bit])
            loss += weight * math.log1p(math.exp(-sign * margin))
        losses.append(loss)
    belief = [math.exp(4 * (min(losses) - v)) for v in losses]
    ranked = sorted(((b / sum(belief), -i) for i, b in enumerate(belief)), reverse=True)
    return model.languages[-ranked[0][1]], ranked[0][0], ranked[0][0] - ranked[1][0]


def _plain_features(text):
    """Damped, normalised counts of hashed byte n-grams by whole numbers."""
    folded = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()]
    counts = [0] * langid.DIMENSIONS
    for n in range(1, 5):
        for i in range(len(folded) - n + 1):
            gram = 0
            for b in folded[i : i + n]:
                gram = (gram * 257 + b) % 2**32
            counts[(gram + n) * 0x9E3779B1 % 2**32 >> 19] += 1
    damped = [math.log1p(c) for c in counts]
    size = math.sqrt(sum(v * v for v in damped))
    return [v / max(size, 1e-9) for v in damped]


@pytest.mark.parametrize("n", [2, 5, 9])
def test_languages_are_those_of_a_plain_decoder(n):
    random = np.random.default_rng(n)
    syllables = [["".join(chr(97 + c) for c in random.integers(0, 26, 3)) for _ in range(12)] for _ in range(n)]
    text = lambda k, size: " ".join(syllables[k][i] for i in random.integers(0, 12, size))
    labels = [f"l{i % n}" for i in range(30 * n)]
    model = langid.fit(labels, np.stack([langid.features(text(int(k[1:]), 6)) for k in labels]))
    asked = [text(i % n, 4) for i in range(20)] + [f"{text(i % n, 3)} {text((i + 1) % n, 3)}" for i in range(20)] + ["x", "\U0001f600 a", "É"]
    for t in asked:
        lang, score, gap = _plain_decoder(model, t)
        got = model.predict(t)
        assert got[1] == pytest.approx(score, abs=1e-4)
        assert got[0] == lang or gap < 1e-4
        assert got[2] == (gap < model.ambiguity) or abs(gap - model.ambiguity) < 1e-4
    for t in asked[::5]:
        assert langid.features(t).tolist() == pytest.approx(_plain_features(t), abs=1e-5)


def test_mixed_texts_are_ambiguous():
    """Texts half in one and half in another language are flagged, those of one language are not."""
    english, german = "the cat sat here and there with them", "der hund lief nach hause und schlief"
    model = langid.fit(["en", "de"] * 40, np.stack([langid.features(t) for t in (english, german)] * 40))
    assert model.predict(english)[0::2] == ("en", False) and model.predict(german)[0::2] == ("de", False)
    assert model.predict(f"{english} {german}")[2]
    assert not model.predict(None)[2]


def test_no_labels(spark):
    docs = documents(spark, [(1, "some text", None, "s")])
    model = langid.train(docs)
    assert docs.select(langid.identify(docs, model)["lang"]).first()[0] == "und"
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert docs.select(toxicity.toxicity(docs, toxicity.train(docs, labels))).first()[0] == 0
    assert docs.select(toxicity.toxicity(docs, toxicity.train(docs, labels.where("false")))).first()[0] == 0


def test_sample_is_bounded_and_repeatable(spark):
    rows = documents(spark, [(i % 900, f"t{i}", "ab"[i % 3 > 0], "s") for i in range(3000)])
    take = lambda: labelled_sample(rows, F.col("lang"), 20).orderBy("id").collect()
    first = take()
    assert first == take() and len({r["id"] for r in first}) == len(first) <= 40
    assert len(labelled_sample(rows, F.col("lang"), 20, most_rows=10).collect()) <= 10


def test_sample_keeps_labels_of_few_identifiers(spark):
    """A label with many rows over few identifiers is not lost."""
    rows = spark.range(30_000).selectExpr("id % 3 as doc_id", "'t' as text", "'xx' as lang").union(spark.range(100).selectExpr("id + 10", "'u'", "'yy'"))
    rows = rows.union(spark.createDataFrame([(None, "v", "zz"), (500, "v", None)], "doc_id long, text string, lang string"))
    found = labelled_sample(rows, F.col("lang"), 50).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in found} == {"xx": 3, "yy": 50}


def test_no_language_is_left_out(spark):
    """Of more than 200 labels, each can be predicted."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 6, f"l{i:03d}", "s") for i in range(230)]
    docs = documents(spark, rows, more=False)
    model = langid.train(docs)
    assert len(model.languages) == 230
    told = docs.select("lang", langid.identify(docs, model)["lang"].alias("p")).collect()
    assert sum(r["lang"] == r["p"] for r in told) >= 225


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a text", "en", "s")]).where("false")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert docs.select(langid.identify(docs, langid.train(docs))).collect() == []
    assert docs.select(toxicity.toxicity(docs, toxicity.train(docs, labels))).collect() == []


def test_toxic_held_out_documents(spark):
    got = queries.op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").toPandas()
    assert got["score"].between(0, 1).all()
    positive, negative = got[got["toxic"] == 1]["score"].to_numpy(), got[got["toxic"] == 0]["score"].to_numpy()
    auc = (positive[:, None] > negative[None, :]).mean() + (positive[:, None] == negative[None, :]).mean() / 2
    assert auc >= 0.9
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()


def test_odd_texts_are_scored(spark):
    rows = [(i, ("you awful rotten fool " if i % 3 == 0 else "a pleasant walk by the sea ") + f"w{i % 7}", "en", "s") for i in range(90)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(4, None), (1000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = {r[0]: r[1] for r in docs.select("doc_id", toxicity.toxicity(docs, model)).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 3 == 0) for i in range(90)]) >= 0.95
    odd = documents(spark, [(i, t, None, None) for i, t in ODD])
    found = odd.select("doc_id", toxicity.toxicity(odd, model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in found) and len({r["s"] for r in found if r["doc_id"] == 7}) == 1


def _toy():
    texts = [np.arange(5, dtype=np.uint64) + np.uint64(i % 2) for i in range(40)]
    return toxicity.fit(texts, texts, np.array([i % 2 for i in range(40)]))


def _ordered_pairs(n, seed):
    """Texts that are toxic where one word stands right before another, clean where it stands right after; no single word tells."""
    random, texts, labels = np.random.default_rng(seed), [], []
    for i in range(n):
        filler = random.integers(10, 40, 12).astype(np.uint64)
        at = int(random.integers(0, 11))
        filler[at : at + 2] = (1, 2) if i % 2 else (2, 1)
        texts.append(filler)
        labels.append(i % 2)
    return texts, np.array(labels)


def test_the_convolution_learns_what_single_words_do_not_tell():
    texts, labels = _ordered_pairs(600, 1)
    model = toxicity.fit(texts, texts, labels)
    held_out, want = _ordered_pairs(400, 2)
    flat = np.concatenate(held_out)
    told = model.logits(np.array([len(t) for t in held_out]), flat, flat)
    auc = (told[want == 1][:, None] > told[want == 0][None, :]).mean()
    assert auc >= 0.95


def test_batches_do_not_change_scores():
    model = _toy()
    texts = ["a b c", None, "", "d " * 500, "a b c"]
    one = model.score(pa.array(texts, pa.string()))
    assert one.tolist() == pytest.approx([model.score(pa.array([t], pa.string()))[0] for t in texts], abs=1e-6)


def test_logits_are_those_of_a_plain_forward_pass():
    model, random = _toy(), np.random.default_rng(1)
    counts = np.array([0, 1, 7, 2, 30])
    words, stems = (random.integers(0, 9, counts.sum()).astype(np.uint64) for _ in range(2))
    row = lambda h, known: int(toxicity.mix(np.array([h]))[0] % np.uint64(toxicity.BUCKETS - 1)) + 1 if h in known else 0
    want, at = [], 0
    for n in counts:
        vectors = [np.concatenate([model.first[row(w, model.words)], model.second[row(s, model.stems)]]) for w, s in zip(words[at : at + n], stems[at : at + n], strict=True)]
        vectors += [np.zeros(2 * toxicity.HALF)] * (toxicity.PAD + (n == 0))
        z = model.out_bias
        for k, (width, f, b) in enumerate(zip(toxicity.WIDTHS, model.filters, model.bias, strict=True)):
            for i in range(toxicity.FILTERS):
                best = max(sum(vectors[p + j] @ f[j, :, i] for j in range(width)) + b[i] for p in range(max(1, n)))
                z += max(0.0, best) * model.out[k * toxicity.FILTERS + i]
        want.append(z)
        at += n
    assert model.logits(counts, words, stems).tolist() == pytest.approx(want, abs=1e-4)


def test_each_language_has_its_own_cut(spark):
    """"vile" is mostly harmless in one language and mostly toxic in the other."""
    rows = []
    for i in range(4000):
        lang, toxic = "ab"[i % 2], i % 20 < 2
        words = {"a": "lorem ipsum dolor sit amet", "b": "kaksi kolme nelja viisi kuusi"}[lang]
        often = (i // 20 % 2 == 0) if toxic else (i // 20 % (3 if lang == "a" else 50) == 0)
        rows.append((i, f"{words} {'vile' if often else 'mild'} w{i % 13}", lang, "s", int(toxic)))
    docs = documents(spark, [r[:4] for r in rows], more=False)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, learn_rows=100)
    assert model.languages == ("a", "b", "und")
    cut = dict(zip(model.languages, model.thresholds, strict=True))
    assert cut["a"] != cut["b"]
    counts, words, _ = toxicity.words_of(pa.array(["lorem ipsum dolor sit amet vile w1", None, "kaksi kolme nelja viisi kuusi vile w1", "..."]))
    assert [model.languages[i] for i in model.language_of(counts, words)] == ["a", "und", "b", "und"]


def test_cut_does_not_depend_on_the_caps(spark):
    """Held-out clean rows pass where the capped sample leaves many more toxic rows to calibrate on than there are."""
    rows = [(i, int(i % 10 == 0), i // 10 % 10 if i % 10 == 0 else i % 40) for i in range(17_000)]
    # "bitter" in half of the toxic rows alone; "grey" in most other toxic rows and in a quarter of the clean ones
    word = lambda toxic, k: ("bitter" if k < 5 else "grey" if k < 8 else "plain") if toxic else "grey" if k % 4 == 1 else "plain"
    docs = documents(spark, [(i, f"w{i % 7} {word(t, k)} w{i % 11}", "en", "s") for i, t, k in rows], more=False)
    labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, toxic int")
    held_out = F.col("doc_id") % 5 == 3
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out), per_label=1350)
    told = docs.where(held_out).select("doc_id", (toxicity.toxicity(docs, model) >= 0.5).alias("p")).join(labels, "doc_id").toPandas()
    assert told[told["toxic"] == 0]["p"].mean() <= 0.02
    whole = docs.select("doc_id", (toxicity.toxicity(docs, model) >= 0.5).alias("p")).where("doc_id % 10 = 0 and p").count()
    assert whole >= 0.45 * 1700
