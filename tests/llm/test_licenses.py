"""Alignment and scans against plain computations."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from porewise.llm import licenses
from porewise.llm.decontaminate import words_of

from .helpers import documents


def test_longest_increasing():
    random.seed(1)
    for _ in range(200):
        values = [random.randrange(9) for _ in range(random.randint(0, 9))]
        got = licenses._increasing(values)
        best = max(n for n in range(len(values) + 1) for c in combinations(values, n) if all(a < b for a, b in zip(c, c[1:], strict=False)))
        picked = [values[i] for i in got]
        assert len(got) == best and got == sorted(got) and all(a < b for a, b in zip(picked, picked[1:], strict=False))


def test_alignment_is_a_common_subsequence():
    random.seed(2)
    for _ in range(200):
        text, template = ([random.randrange(30) for _ in range(random.randint(0, 40))] for _ in range(2))
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
    words = list(range(50))
    assert len(licenses.align([*words[:20], 99, *words[20:]], words)) == 50
    assert len(licenses.align(words[:10] + words[15:], words)) == 45


def _scan(spark, texts, **how):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    return licenses.scan_licenses(docs, **how).collect()


def test_whole_edited_and_repeated_notices(spark):
    random.seed(3)
    mit = licenses.TEMPLATES["MIT text"]
    prose = " ".join(f"w{random.randrange(500)}" for _ in range(3000))
    edited = mit.replace("substantial ", "").replace("Software", "Program", 1).upper()
    got = _scan(spark, [mit, f"{prose} {edited} {prose}", f"{mit} {prose} {mit}", prose, None, "", " ".join(mit.split()[:20]), mit])
    full = [r for r in got if r["license"] == "MIT text"]
    assert sorted(r["doc_id"] for r in full) == [0, 1, 2, 2, 7]
    for r in full:
        assert r["coverage"] >= (0.95 if r["doc_id"] == 1 else 1.0) and r["end_word"] - r["first_word"] >= 0.9 * r["template_words"]
    assert {r["doc_id"] for r in got}.isdisjoint({3, 4, 5})


def test_scattered_words_are_no_notice(spark):
    words = licenses.TEMPLATES["MIT"].split()
    assert not _scan(spark, [" filler ".join(words), " ".join("x " * 200 + w for w in words)], templates={"MIT": licenses.TEMPLATES["MIT"]})


@pytest.mark.parametrize("seed", range(4))
def test_candidates_are_those_of_every_stretch(seed):
    """Templates that some stretch from one of their words on aligns with, by aligning all of them."""
    rng, hits = random.Random(seed), 0
    for _ in range(100):
        vocabulary = [f"w{i}" for i in range(rng.choice([8, 30, 80]))]
        scanner = licenses.Scanner.build({f"t{k}": " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 15, 25]))) for k in range(3)}, 0.8, 0.6)
        _, (words,) = _hashed([" ".join(_edited(rng, vocabulary, scanner))])
        want = {n for n, t in zip(scanner.names, scanner.words, strict=True) if any(_stretch_matches(scanner, t, words[a : a + int(len(t) / 0.6) + 1]) for a in range(len(words)) if words[a] in t)}
        flat = np.array(words, np.uint64)
        found = list(scanner._candidates(flat, scanner.numbers(flat)))
        assert {r[0] for r in found} == want
        kept = list(scanner.scan(flat, scanner.numbers(flat)))
        spans = sorted((r[4], r[5]) for r in kept)
        assert {*kept} <= {*found} and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and bool(kept) == bool(found)
        hits += len(want)
    assert hits > 50


def _hashed(texts):
    counts, flat = words_of(pa.array(texts, pa.string()))
    return counts, [w.tolist() for w in np.split(flat, np.cumsum(counts)[:-1])]


def _edited(rng, vocabulary, scanner):
    """Prose with one edited template in it (by numbers of the words, since templates are known as hashes)."""
    names = {h: w for w, (h,) in zip(vocabulary, _hashed(vocabulary)[1], strict=True)}
    notice = [names[h] for h in rng.choice(scanner.words)]
    for _ in range(rng.randint(0, max(1, len(notice) // 4))):
        at = rng.randrange(len(notice) + 1)
        notice[at : at + rng.randint(0, 1)] = rng.choices([*vocabulary, "zz"], k=rng.randint(0, 2))
    text = rng.choices(vocabulary + [f"x{i}" for i in range(60)], k=rng.randint(0, 40))
    at = rng.randint(0, len(text))
    return text[:at] + notice + text[at:]


def _stretch_matches(scanner, template, stretch):
    match = licenses.align(stretch, template)
    return bool(match) and len(match) >= -(-80 * len(template) // 100) and len(match) >= 0.6 * (match[-1][0] - match[0][0] + 1) and scanner._agrees(stretch, template, match)


def test_empty_table_repeated_rows_and_long_texts(spark):
    line = licenses.TEMPLATES["MIT"]
    docs = documents(spark, [(1, line, "en", "s"), (1, line, "en", "s"), (2, f"{'plain words ' * 150_000}{line}", "en", "s")])
    assert sorted(r["doc_id"] for r in licenses.scan_licenses(docs).collect()) == [1, 1, 2]
    assert licenses.scan_licenses(docs.where("false")).collect() == []


def test_no_templates(spark):
    assert not _scan(spark, ["text"], templates={}) and not _scan(spark, ["text"], templates={"none": "..."})


def test_every_line_of_the_table_is_found(spark, small):
    """Documents that hold a short notice as it stands, by a plain search."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    plain = lambda t: words_of(pa.array([t], pa.string()))[1].tolist()
    short = {k: plain(v) for k, v in licenses.TEMPLATES.items()}
    want = set()
    for i, t in docs:
        if t and ("icense" in t or "ICENSE" in t or "Permission" in t):
            w = plain(t)
            want |= {(i, k) for k, v in short.items() if any(w[p : p + len(v)] == v for p in range(len(w)))}
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert want <= got


def test_similar_licenses_are_told_apart(spark):
    """Every notice and text comes out as itself and as nothing else, alone and next to others."""
    templates = licenses.all_templates()
    got = {}
    for r in _scan(spark, list(templates.values())):
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert got == {i: [name] for i, name in enumerate(templates)}
    lines = ["CC-BY-4.0", "CC-BY-NC-4.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0 notice", "GPL-3.0 notice"]
    found = _scan(spark, ["\n".join(templates[k] for k in lines), "Licensed under CC BY-NC 2.5."])
    assert [r["license"] for r in sorted(found, key=lambda r: r["first_word"])] == lines


def test_long_templates_lose_nothing(monkeypatch):
    """Templates beyond the bound at likely starts against every start: a shuffled decoy before an edited copy, among prose."""
    found = {}
    for every in (licenses.EVERY_START, 1 << 30):
        monkeypatch.setattr(licenses, "EVERY_START", every)
        rng = random.Random(9)
        vocabulary = [f"w{i}" for i in range(90)]
        for case in range(60):
            template = rng.choices(vocabulary, k=rng.choice([150, 400]))
            scanner = licenses.Scanner.build({"t": " ".join(template)}, 0.8, 0.6)
            decoy, copy = rng.sample(template, len(template)), list(template)
            for _ in range(rng.randint(0, len(copy) // 6)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
            prose = lambda: rng.choices(vocabulary, k=rng.randint(0, 80))  # noqa: E731, B023
            text = [*prose(), *decoy[: rng.randint(0, len(decoy))], *prose(), *copy, *prose()]
            words = licenses.words_of(pa.array([" ".join(text)]))[1]
            found.setdefault(case, []).append([(r[0], r[4] // 50) for r in scanner.scan(words, scanner.numbers(words))])
    assert sum(bool(every) for _, every in found.values()) >= 40
    assert sum(len(likely) for likely, _ in found.values()) >= sum(len(every) for _, every in found.values())
