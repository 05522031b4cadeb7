"""Leaks against edit distances of every stretch."""

import random

import numpy as np
import pytest
import regex

from porewise.llm import decontaminate as d

from .helpers import documents


def _words(text):
    return regex.sub(r"[^\p{L}\p{N}\t\n\f\r ]+", "", (text or "").lower()).split()


def _least(pattern, text):
    """Edit distance of the pattern to its best stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def _budget(pattern):
    return int(0.15 * len(pattern))


def _held(pattern, text):
    """Whether a text with this item is dropped."""
    if 0 < len(pattern) and not _budget(pattern):
        return pattern in [_words(line) for line in regex.split(r"[\r\n]+", text or "")]
    return bool(pattern) and _least(pattern, _words(text)) <= _budget(pattern)


def test_myers():
    random.seed(1)
    for _ in range(400):
        pattern, text = ([random.randrange(4) for _ in range(random.randint(1, 90))], [random.randrange(4) for _ in range(random.randint(0, 60))])
        assert d.myers(np.array(pattern, np.uint64), np.array(text, np.uint64))[0] == _least(pattern, text)


@pytest.fixture(scope="module")
def case():
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Straße"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([7, 8, 13, 14, 20, 40])))) for i in range(12)]
    items += [(20, items[0][1]), (21, "too short"), (22, ""), (23, None), (None, items[1][1])]
    docs = [(100, None), (101, ""), (102, "!!! ??"), (103, "w1")]
    for n in range(150):
        words = random.choices(vocabulary, k=random.randint(0, 60))
        if n % 2:
            leak = items[n % 12][1].split()
            for _ in range(random.randint(0, 7)):
                at = random.randrange(len(leak))
                leak[at : at + random.randint(0, 1)] = random.choices(["zz", "w3", "yy q"], k=random.randint(0, 1))
                leak = leak or ["w1"]
            at = random.randint(0, len(words))
            words[at:at] = leak
        docs.append((n, " ".join(w.upper() + "," if random.random() < 0.1 else w for w in words)))
    docs.append((3, docs[7][1]))  # a repeated identifier
    docs += [(200, "it is too short for that"), (201, "w1 w2\nToo short!\nw3"), (202, "too short"), (203, "w1\nit is too short"), (204, "too\nshort")]
    return docs, items


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_find_and_remove(spark, case, block_words):
    rows, items = case
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        for item, text in items:
            pattern = _words(text)
            if pattern and (distance := _least(pattern, _words(t))) <= _budget(pattern):
                want.append((i, item, distance))
    got = d.find_leaks(docs, benchmark, block_words=block_words).collect()
    order = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in got), key=order) == sorted(want, key=order)
    assert len(want) >= 25 and {21, None} <= {item for _, item, _ in want}
    for r in got:
        text = _words(next(t for i, t in rows if i == r["doc_id"] and r["first_word"] < len(_words(t)) >= r["end_word"]))
        assert 0 <= r["first_word"] < r["end_word"] <= len(text)
    texts = {(i, t) for i, t in rows if any(_held(_words(x), t) for _, x in items)}
    clean = d.remove_leaks(docs, benchmark, block_words=block_words)
    assert clean.columns == docs.columns
    key = lambda p: (p[0], p[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=key) == sorted((p for p in rows if p not in texts), key=key)


def test_nothing(spark):
    docs = documents(spark, [(1, "some words", "en", "s")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_leaks(docs, none).count() == 0 and d.remove_leaks(docs, none).count() == 1
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert d.find_leaks(docs.where("false"), one).count() == 0


def test_scripts_spaces_and_long_texts(spark):
    """Characters are words where spaces are not written; any white space separates; a long text is searched whole."""
    item = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u51fa\u53bb\u8d70\u8d70"
    words = "quick brown fox jumps over the lazy dog today"
    benchmark = spark.createDataFrame([(1, item), (2, words), (3, "lone")], "item_id long, text string")
    long_text = "plain words here " * 100_000
    rows = [(1, f"\u554a{item}\u3002\u554a"), (2, words.replace(" ", "\u00a0")), (3, words.replace(" ", "\u3000")), (4, long_text), (5, f"{long_text}{words} {long_text}"), (6, "not lone at all"), (7, "x\r\nLone.\r\ny")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    found = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (2, 2), (3, 2), (5, 2), (6, 3), (7, 3)}
    assert sorted(r["doc_id"] for r in d.remove_leaks(docs, benchmark).collect()) == [4, 6]


def test_an_item_of_seven_words_with_an_edit(spark):
    """Budgets follow from the rate alone: seven words allow one edit, six none, inside a line too."""
    seven, six = "what is the capital city of france", "name the longest river of europe"
    rows = [(1, f"so {seven} then"), (2, f"so {seven.replace('city', 'town')} then"), (3, f"so {seven.replace('city', 'town').replace('is', 'was')} then"), (4, f"{six.replace('longest', 'deepest')}\nx"), (5, f"one {six} two"), (6, f"one\n{six}\ntwo")]
    docs, benchmark = documents(spark, [(i, t, "en", "s") for i, t in rows]), spark.createDataFrame([(1, seven), (2, six)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in d.find_leaks(docs, benchmark).collect()} == {(1, 1, 0), (2, 1, 1), (5, 2, 0), (6, 2, 0)}
    assert sorted(r["doc_id"] for r in d.remove_leaks(docs, benchmark).collect()) == [3, 4, 5]
