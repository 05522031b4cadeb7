"""License scans by patience alignment.

Words that occur once in the text and once in the template anchor the alignment; their longest
increasing subsequence is kept, and the gaps between anchors are aligned in the same way. The
share of the template's words that are matched is its coverage.

A long text is not aligned as a whole, since repeated notices would leave no unique words.
A match must be dense: matched words make up at least ``density`` of the words it spans, so it
spans at most 1 / ``density`` times the template's length. Wherever a stretch of that length
holds enough of the template's words to reach the wanted coverage, it is aligned; no other
stretch could reach it.

Similar templates are told apart in two ways. Within the first HEAD words, a match must hold the
same SEPARATING words as the template (versions, NC, Lesser and the like). Of matches that
overlap, the one that explains the text best stays: most matched words, less the words of the
template and of the span that are not matched.

A null or empty text has no match; repeated notices are each reported; a template without
words matches nothing; rows with equal identifiers are reported one by one.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .decontaminate import words_of

#: Wordings of notices and texts of common licenses.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "BSD-2-Clause conditions": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause conditions": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. Neither the
        name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-3.0 notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-3.0": "Licensed under CC BY-NC 3.0.",
    "CC-BY-NC-3.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-3.0": "Licensed under CC BY-NC-ND 3.0.",
    "CC-BY-NC-ND-3.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-3.0": "Licensed under CC BY-NC-SA 3.0.",
    "CC-BY-NC-SA-3.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-3.0": "Licensed under CC BY-ND 3.0.",
    "CC-BY-ND-3.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.",
    "CC-BY-SA-3.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work under the Creative Commons CC0 1.0 Universal Public Domain Dedication.""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 2 of the License,
        or (at your option) any later version.""",
    "GPL-2.0-only notice": """you can redistribute it and/or modify it under the terms of the GNU General Public License
        version 2 as published by the Free Software Foundation.""",
    "GPL-2.0-only notice, other order": """you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; version 2 of the License.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version.""",
    "GPL-3.0-only notice": """you can redistribute it and/or modify it under the terms of the GNU General Public License
        version 3 as published by the Free Software Foundation.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.0 notice": """This library is free software: you can redistribute it and/or modify it under the terms of the
        GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License,
        or (at your option) any later version.""",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 notice": """This library is free software: you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License,
        or (at your option) any later version.""",
    "LGPL-2.1-only notice": """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        version 2.1 as published by the Free Software Foundation.""",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 notice": """This library is free software: you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    "MPL-2.0 notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
#: Whole texts, files of ``texts`` beside this module.
TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-2.0")
#: Words, as ``words_of`` makes them, that tell similar licenses apart, and within how many words of a template they must agree.
SEPARATING = "affero lesser library 1 2 3 20 21 10 30 40 by bync bysa bynd byncsa byncnd attribution attributionnoncommercial attributionsharealike attributionnoderivatives attributionnoderivs attributionnoncommercialsharealike attributionnoncommercialnoderivatives attributionnoncommercialnoderivs"
HEAD = 40
#: For templates of at most so many words, every start that could reach the coverage is tried; for longer ones, the likeliest nearby.
EVERY_START = 128


def all_templates() -> dict[str, str]:
    """Notices and whole texts. The texts are read on the driver only."""
    return TEMPLATES | {f"{name} text": (pkgutil.get_data(__package__, f"texts/{name}") or b"").decode() for name in TEXTS}



def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by piles."""
    tops, piles, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before[i] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched positions (in text, in template), in order."""
    found, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if in_template[w] == 1 and w in where]
        anchors = [anchors[i] for i in _increasing([x for x, _ in anchors])]
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


@dataclass(frozen=True)
class Scanner:
    """The templates as word hashes, and a table that tells which template has which word."""

    names: list[str]
    words: list[list[int]]
    vocabulary: np.ndarray
    has: np.ndarray
    times: np.ndarray
    separating: frozenset[int]
    coverage: float
    density: float

    @staticmethod
    def build(templates: dict[str, str], coverage: float, density: float) -> Scanner:
        counts, flat = words_of(pa.array(list(templates.values()), pa.string()))
        words = [w.tolist() for w in np.split(flat, np.cumsum(counts)[:-1])] if len(templates) else []
        vocabulary = np.unique(flat)
        times = np.zeros((len(vocabulary) + 1, len(words)), np.int32)
        for t, w in enumerate(words):
            np.add.at(times[:, t], np.searchsorted(vocabulary, np.array(w, np.uint64)), 1)
        separating = frozenset(words_of(pa.array([SEPARATING]))[1].tolist())
        return Scanner(list(templates), words, vocabulary, times > 0, times, separating, coverage, density)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Index of each word in the templates' vocabulary; its length for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary))

    def scan(self, words: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[str, float, int, int, int, int]]:
        """(template, coverage, matched words, template words, first word, end word) in one text; the best of those that overlap."""
        found = sorted(self._candidates(words, numbers), key=lambda r: (r[3] + (r[5] - r[4]) - 3 * r[2], -r[1], r[4], r[0]))
        taken: list[tuple[int, int]] = []
        for row in found:
            at = bisect_left(taken, (row[5], 0))
            if at == 0 or taken[at - 1][1] <= row[4]:
                insort(taken, (row[4], row[5]))
                yield row

    def _agrees(self, words: list[int], template: list[int], match: list[tuple[int, int]]) -> bool:
        """Whether the separating words of the template's head, and no others, are in the stretch that it matches."""
        head = [(i, j) for i, j in match if j < HEAD]
        if not head:
            return False
        there = {w for w in words[head[0][0] : head[-1][0] + 1] if w in self.separating}
        return there == {w for w in template[:HEAD] if w in self.separating}

    def _candidates(self, words: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[str, float, int, int, int, int]]:
        """Every template by itself."""
        present = np.unique(numbers)
        lengths = self.times.sum(0)
        # a template's word is matched as often as it has the word, at most
        for t in np.flatnonzero((lengths > 0) & (self.times[present].sum(0) >= -(-int(self.coverage * 100) * lengths // 100))):
            template = self.words[t]
            m = len(template)
            need, reach = -(-int(self.coverage * 100) * m // 100), int(m / self.density) + 1
            upto = np.concatenate([[0], np.cumsum(self.has[numbers, t])])
            if upto[-1] < need:
                continue
            starts = np.arange(len(words))
            held = upto[np.minimum(starts + reach, len(words))] - upto[starts]
            starts = np.flatnonzero((held >= need) & self.has[numbers, t])
            at, tried = 0, set()
            while at < len(starts):
                near = starts[at : np.searchsorted(starts, starts[at] + reach)]
                begin = int(near[np.argmax(held[near])])
                if begin in tried:  # the likeliest start has failed
                    begin = int(starts[at])
                    if m > EVERY_START or begin in tried:
                        at += 1
                        continue
                tried.add(begin)
                stretch = words[begin : begin + reach].tolist()
                match = align(stretch, template)
                span = match[-1][0] - match[0][0] + 1 if match else 1
                if len(match) >= need and len(match) >= self.density * span and self._agrees(stretch, template, match):
                    first, end = begin + match[0][0], begin + match[-1][0] + 1
                    yield self.names[t], len(match) / m, len(match), m, first, end
                    at = int(np.searchsorted(starts, max(end, starts[at] + 1)))


FOUND = "license string, coverage double, matched int, template_words int, first_word int, end_word int"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8, density: float = 0.6) -> DataFrame:
    """One row for each occurrence of a template in a document."""
    small_batches(docs.sparkSession)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner.build(all_templates() if templates is None else templates, coverage, density))
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            counts, words = words_of(batch.column(1))
            numbers = scanner.value.numbers(words)
            owners, found, at = [], [], 0
            for i, n in enumerate(counts.tolist()):
                for row in scanner.value.scan(words[at : at + n], numbers[at : at + n]):
                    owners.append(i)
                    found.append(row)
                at += n
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.float64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "license", "coverage", "matched", "template_words", "first_word", "end_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {FOUND}")
