"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Candidates are stretches of a line dense in words of notices, with one at least that the trained weights tell from ordinary text, and what lies over several lines of a
paragraph (lines up to one without words, comment marks stripped) and holds enough of a template.  A sparse word n-gram
(one and two words) logistic regression, trained on perturbed templates against ordinary paragraphs
of the corpus and scrambled licence words (class ``unknown``), names a family; its
temperature is calibrated on paragraphs kept out of the fit.  A family counts only if its
calibrated probability is at least ``SURE`` and the stretch holds at least ``MATCH`` of the word
pairs of one of that family's templates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_share, map_batches

#: Notices as they stand in public licences and at the head of files under them, a clause each (fixed values).
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This software is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2.",
        "Licensed under the GPLv3.",
    ],
    "LGPL": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "AGPL": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Zlib": [
        "Licensed under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
}
#: Words that tell a family from the plain one (first) that is worded alike: never it without, never the plain one with them.
TELLING = {"LGPL": ("GPL", {"lesser", "lgpl"}), "AGPL": ("GPL", {"affero", "agpl"}), "CC-BY-SA": ("CC-BY", {"sa", "sharealike"}), "CC-BY-NC": ("CC-BY", {"nc", "noncommercial"})}
UNKNOWN = "unknown"
SURE, MATCH = 0.5, 0.6
#: Bounds of the ordinary text that trains the unknown class: about so many documents, those of least hash, whole; of
#: their lines, cut into parts of at most ``PART`` words, those of least hash.
SAMPLE_DOCS, SAMPLE_PARTS, PART = 400, 3000, 60
GAP, LEAST = 2, 3  # other words within a stretch, words of notices in it
#: A word is looked at first if the classifier holds it for this much likelier in some family than in ordinary text (difference of its weights), at
#: the share of ordinary parts in ``RARE`` at most.
EVIDENCE, RARE = 0.5, 0.02

#: Comment marks that are words, at the start of a line.
COMMENTS = {"dnl", "rem", "c"}

_WORD = re.compile(r"[^\W_]+")


def line_words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _pairs(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:]))


def _perturb(rng: np.random.Generator, ws: list[str], filler: list[str]) -> list[str]:
    out = [w for w in ws if rng.random() > 0.06]
    for _ in range(int(rng.integers(0, 3))):
        out.insert(int(rng.integers(0, len(out) + 1)), filler[int(rng.integers(len(filler)))])
    return out


@dataclass
class LicenseModel:
    families: list[str]
    features: dict  # word or pair of words -> column
    signal: frozenset  # words that some family's weight tells from ordinary text; a stretch without any is ordinary
    weights: np.ndarray
    temperature: float

    def __post_init__(self) -> None:
        self.known = frozenset(f for f in self.features if isinstance(f, str))
        self.templates = {k: [_pairs(line_words(t)) for t in ts] for k, ts in TEMPLATES.items()}
        self.all = [(_pairs(ws), 2 * len(ws)) for ts in TEMPLATES.values() for ws in map(line_words, ts)]
        self.holders = defaultdict(list)  # pair of words -> templates that hold it
        for k, (pairs, _) in enumerate(self.all):
            for pair in pairs:
                self.holders[pair].append(k)

    def vector(self, ws: list[str]) -> np.ndarray:
        x = np.zeros(len(self.features) + 2)
        for f in [*ws, *zip(ws, ws[1:])]:
            k = self.features.get(f)
            if k is not None:
                x[k] = 1
        norm = np.sqrt(x.sum())
        x /= norm if norm else 1
        x[-2] = 1 - sum(w in self.known for w in ws) / max(1, len(ws))
        x[-1] = 1
        return x

    def probabilities(self, ws: list[str]) -> np.ndarray:
        z = (self.vector(ws) @ self.weights) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def stretches(self, ws: list[str]) -> Iterator[tuple[int, int]]:
        """Begin and end of the stretches among the words of a line."""
        if self.signal.isdisjoint(ws):
            return
        at = [i for i, w in enumerate(ws) if w in self.known]
        lo = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] - at[i - 1] > GAP + 1:
                if i - lo >= LEAST and not self.signal.isdisjoint(ws[at[lo] : at[i - 1] + 1]):
                    yield at[lo], at[i - 1] + 1
                lo = i

    def classify(self, ws: list[str]) -> tuple[str, float]:
        """Family and probability; ``unknown`` unless sure and confirmed by a template."""
        p = self.probabilities(ws)
        for name, (plain, telling) in TELLING.items():
            p[self.families.index(name if telling.isdisjoint(ws) else plain)] = 0
        p /= p.sum()
        have = _pairs(ws)
        for k in np.argsort(-p, kind="stable"):  # of equally likely families the one that stands first in ``TEMPLATES``
            name = self.families[k]
            if p[k] < SURE or name == UNKNOWN:
                break
            if max(len(t & have) / len(t) for t in self.templates[name]) >= MATCH:
                return name, float(p[k])
        return UNKNOWN, float(p[self.families.index(UNKNOWN)])

    def match(self, ws: list[str], name: str) -> tuple[int, int, int]:
        """How many pairs of a family's best template are in ``ws``, and from where to where they lie."""
        have = _pairs(ws)
        best = max(self.templates[name], key=lambda t: len(t & have) / len(t))
        at = [i for i, pair in enumerate(zip(ws, ws[1:])) if pair in best]
        return len(best & have), at[0], at[-1] + 2

    def wrapped(self, ws: list[str], line: list[int]) -> list[tuple[str, float, int, int]]:
        """Notices over several lines among the words of a paragraph (``line`` of each): family, probability, begin, end."""
        hits: dict[int, list[int]] = defaultdict(list)
        for i, pair in enumerate(zip(ws, ws[1:])):
            for k in self.holders.get(pair, ()):
                hits[k].append(i)
        found = []
        for k, at in hits.items():
            pairs, reach = self.all[k]
            if len(at) < MATCH * len(pairs):
                continue

            def best(i: int) -> tuple[int, int] | None:
                """From hit ``i``: the worth (pairs against length) and the end of what holds enough of the template."""
                seen, top = set(), None
                for h in at[i : bisect_left(at, at[i] + reach)]:
                    seen.add((ws[h], ws[h + 1]))
                    if len(seen) >= MATCH * len(pairs) and (top is None or 2 * len(seen) - (h - at[i]) > top[0]):
                        top = 2 * len(seen) - (h - at[i]), h + 2
                return top

            i = 0
            while i < len(at):
                top = best(i)
                if top is None:
                    i += 1
                    continue
                while i + 1 < len(at) and (more := best(i + 1)) and more[0] >= top[0]:  # what stands before the notice by chance
                    i, top = i + 1, more
                lo, hi = at[i], top[1]
                if line[lo] != line[hi - 1] and not self.signal.isdisjoint(ws[lo:hi]):
                    name, p = self.classify(ws[lo:hi])
                    if name != UNKNOWN:
                        found.append((name, p, lo, hi, top[0]))
                i = bisect_left(at, hi - 1)
        out: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[4], -f[1])):  # the best of those that overlap
            if all(f[3] <= o[2] or o[3] <= f[2] for o in out):
                out.append(f)
        return [f[:4] for f in sorted(out, key=lambda f: f[2])]

    def paragraph(self, lines: list[list[str]]) -> list[tuple[str, float]]:
        if all(self.signal.isdisjoint(ws) for ws in lines):
            return []
        found, base = [], 0
        for ws in lines:
            for s, e in self.stretches(ws):
                for lo in range(s, max(s + 1, e - PART // 2), PART // 2):  # a long stretch is read in overlapping parts
                    name, p = self.classify(part := ws[lo : min(e, lo + PART)])
                    if name != UNKNOWN:
                        pairs, a, b = self.match(part, name)
                        found.append((name, p, base + lo + a, base + lo + b, pairs))
            base += len(ws)
        if len(lines) > 1:
            ws = [w for words in lines for w in words]
            for name, p, lo, hi in self.wrapped(ws, [k for k, words in enumerate(lines) for _ in words]):
                if any(f[0] == name and f[2] < hi and lo < f[3] for f in found):
                    continue
                pairs = self.match(ws[lo:hi], name)[0]
                # a line that holds a part only may look like another family
                found = [f for f in found if not (lo <= f[2] and f[3] <= hi and f[4] < pairs)]
                found.append((name, p, lo, hi, pairs))
        return [f[:2] for f in found]

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        out, held = [], []
        for line in [*(text or "").split("\n"), ""]:
            ws = line_words(line)
            if ws and ws[0] in COMMENTS:
                ws = ws[1:]
            if ws:
                held.append(ws)
            elif held:
                out += self.paragraph(held)
                held = []
        return out


def train(ordinary: list[list[str]], seed: int = 42) -> LicenseModel:
    """``ordinary``: words of parts of lines of the corpus, licence notices among them or not."""
    rng = np.random.default_rng(seed)
    texts = {k: [line_words(t) for t in ts] for k, ts in TEMPLATES.items()}
    every = [ws for ts in texts.values() for ws in ts]
    features: dict = {}
    for ws in every:
        for f in [*ws, *zip(ws, ws[1:])]:
            features.setdefault(f, len(features))
    pairs = [_pairs(ws) for ws in every]
    plain = [ws for ws in ordinary if ws and max(len(t & _pairs(ws)) / len(t) for t in pairs) < 0.3]
    filler = sorted({w for ws in plain[:200] for w in ws}) or ["word"]
    families = [*TEMPLATES, UNKNOWN]
    rows, y = [], []
    for k, ts in enumerate(texts.values()):
        for ws in ts:
            for _ in range(max(20, 120 // len(ts))):
                rows.append(_perturb(rng, ws, filler))
                y.append(k)
    words = sorted({w for ws in every for w in ws})
    for ws in plain:
        rows.append(ws)
        y.append(len(families) - 1)
    for _ in range(400):  # licence words in no notice's order
        rows.append([words[int(i)] for i in rng.integers(len(words), size=int(rng.integers(3, 14)))])
        y.append(len(families) - 1)
    model = LicenseModel(families, features, frozenset(), np.zeros((len(features) + 2, len(families))), 1.0)
    x, y = np.stack([model.vector(r) for r in rows]).astype(np.float32), np.array(y)
    out = rng.random(len(y)) < 0.2
    goal = np.eye(len(families), dtype=np.float32)[y]
    weight = 1 / np.bincount(y, minlength=len(families))[y]
    weight *= len(y) / weight.sum()
    w, m, v = model.weights.astype(np.float32), 0.0, 0.0
    a, g, s = x[~out], goal[~out], weight[~out][:, None].astype(np.float32)
    for t in range(1, 201):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = a.T @ ((p - g) * s) / len(a) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = x[out] @ w

    def loss(temp: float) -> float:
        q = z / temp
        q = q - q.max(axis=1, keepdims=True)
        return float(-(q[np.arange(len(q)), y[out]] - np.log(np.exp(q).sum(axis=1))).mean())

    w = w.astype(np.float64)
    usual = Counter(x for ws in plain for x in set(ws))
    ahead = w[:-2, :-1].max(axis=1) - w[:-2, -1]
    model.signal = frozenset(f for f, k in features.items() if isinstance(f, str) and ahead[k] >= EVIDENCE and usual[f] <= RARE * len(plain))
    model.weights, model.temperature = w, min(np.geomspace(0.25, 8, 41), key=loss)
    return model


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, text) -> (h, words): every line's words, in parts of at most ``PART``."""
    for b in batches:
        h, out = [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for line in text.split("\n"):
                ws = line_words(line)
                for lo in range(0, len(ws), PART):
                    h.append(key)
                    out.append(" ".join(ws[lo : lo + PART]))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.string())], names=["h", "words"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_parts: int = SAMPLE_PARTS) -> LicenseModel:
    """Trains with a bounded sample of the corpus as ordinary text: ``sample_parts`` parts of lines of about ``sample_docs`` whole documents.

    Of repeated rows one is drawn.
    """
    have = docs.where("text is not null")
    h = F.xxhash64("doc_id", "text")
    drawn = have.select(h.alias("h"), "text").where(hash_share(F.col("h"), sample_docs / max(1, have.count()))).dropDuplicates(["h"])
    parts = map_batches(drawn, _parts, "h long, words string")
    rows = parts.orderBy(F.xxhash64("h", "words"), "words").limit(sample_parts).select("words").collect()
    return train([r["words"].split() for r in rows])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (families by name, joined by commas; empty if none), n_notices (clauses found), probability (of the surest).

    Null and empty texts have none; whole texts are read; repeated rows are scanned alike; of two families equally
    likely for a notice the first in ``TEMPLATES`` counts; an empty table gives an empty result; only doc_id and text are read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(src))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            got = [model.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([",".join(sorted({k for k, _ in g})) for g in got], pa.string()),
                    pa.array([len(g) for g in got], pa.int32()),
                    pa.array([max((p for _, p in g), default=0.0) for g in got], pa.float64()),
                ],
                names=["doc_id", "licenses", "n_notices", "probability"],
            )

    return map_batches(src, run, "doc_id long, licenses string, n_notices int, probability double")
