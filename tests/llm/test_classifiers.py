import random
import zlib
from dataclasses import replace as dataclasses_replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, licenses, toxicity
from tessera.llm.common import fold

DOCS = "doc_id long, text string, lang string"


def test_fold(spark):
    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def plain_words(text):
    """Sentences of a text as lists of words (lists of codes), by the definition."""
    import re

    code = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 37
    tokens = []  # letters of each token that has any, and whether a sentence ends before it
    ended = False
    for m in re.finditer(r"(\n)|(\S+)", text.lower()):
        if m[1]:
            ended = True
            continue
        have = "".join(c for c in m[2] if c.isalpha())
        if have:
            tokens.append([have, ended, False])
            ended = False
        ended = ended or m[2][-1] in ".!?"
    i = 0
    while i < len(tokens):  # runs of single letters are one word
        j = i
        while j < len(tokens) and len(tokens[j][0]) == 1:
            j += 1
        if j - i >= toxicity.SPACED:
            tokens[i : j] = [["".join(t[0] for t in tokens[i:j]), tokens[i][1], True]]
        i += 1
    out = [[]]
    for have, before, _ in tokens:
        if before and out[-1]:
            out.append([])
        for k in range(0, len(have), toxicity.PIECE):
            out[-1].append(([toxicity._START] if k == 0 else []) + [code(c) for c in have[k : k + toxicity.PIECE]])
    return out


def kernel(s, t):
    """The subsequence kernel by definition, over the norms of strings of these lengths."""
    import itertools

    def features(x):
        out = {}
        for at in itertools.combinations(range(len(x)), toxicity.P):
            if at[-1] - at[0] < toxicity.SPAN:
                u = tuple(x[i] for i in at)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def norm(n):
        return np.sqrt(sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1)) for at in itertools.combinations(range(n), toxicity.P) if at[-1] - at[0] < toxicity.SPAN) + toxicity.DAMPING)

    a, b = features(s), features(t)
    return sum(v * b.get(u, 0) for u, v in a.items()) / norm(len(s)) / norm(len(t))


@pytest.mark.parametrize("s,t", [("idiot", "idiot"), ("idiot", "idxiot"), ("moron", "oronth"), ("aaaa", "aaa"), ("abc", "abcd"), ("abcdefghijklmno", "aceg")])
def test_kernel(s, t):
    s, t = (bytes([toxicity._START, *(ord(c) - 97 for c in x)]) for x in (s, t))
    assert toxicity.Landmarks([t, s]).against([s])[0, 0] == pytest.approx(kernel(s, t))


def toxic_docs(rng, n, share):
    syllables = ["ta", "re", "on", "li", "mo", "en", "sur", "pa", "ti", "ver"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        bad = i < n * share
        text = [word() + rng.choice(["", "", "", ".", "\n", ","]) for _ in range(rng.randint(5, 60))]
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["zgrubble", "fnork", "kwazzig", "boil yourhead"]))
        out.append((" ".join(text), int(bad)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def toxic_model():
    data = toxic_docs(random.Random(1), 600, 0.2)
    return toxicity.train([toxicity.spelled(t) for t, _ in data], [y for _, y in data])


def test_training_finds_gapped_insults(toxic_model):
    score = lambda t: toxic_model.probabilities([t])[0]
    for t in ("ta zgrubble on", "ta z-g-r-u-b-b-l-e", "re f.n.o.r.k!", "ON KWAZZIG", "z g r u b b l e ta", "ta kwazxzig", "ta zgru bble on", "on boil yourhead"):
        assert score(t) >= 0.5, t
    for t in ("ta re on", "patimoverta surenta", "", "!!! 123", "a b c"):
        assert score(t) < 0.5, t


def test_scores_are_the_direct_kernels(toxic_model):
    """Whole scores: the calibrated highest sum, over the spans of the sentences, of the kernel with each landmark."""
    m = toxic_model
    texts = [t for t, _ in toxic_docs(random.Random(5), 12, 0.5)] + ["", "i d i o t", "A.b c, d e f g.\nh i", "x" * 35 + " zgru. bble", "Été où? ñandú\u3042\u3044 z", "a\x00bcd efg", "one two... three! four"]
    want = []
    for t in texts:
        best = m.bias if not any(plain_words(t)) else -np.inf
        for ws in plain_words(t):
            for span in [*ws, *(a + b for a, b in zip(ws, ws[1:]))]:
                best = max(best, m.bias + sum(a * kernel(bytes(span), z) for a, z in zip(m.alpha, m.landmarks)))
        want.append(m.curve(best))
    assert m.probabilities(texts) == pytest.approx(want, abs=1e-4)
    for t in texts:
        mine = {bytes(x) for ws in plain_words(t) for x in [*ws, *(a + b for a, b in zip(ws, ws[1:]))]}
        assert toxicity.spans(toxicity.spelled(t)) == mine


def test_toxicity_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(100000, None, "en"), (100001, "", "en"), (100002, "x" * 200000, "en"), (None, "no id", None), (100000, None, "en")], DOCS)
    got = toxicity.classify(docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash")), labels).collect()
    assert len(got) == docs.count() + 5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(r.score < 0.5 for r in got if r.doc_id in (100000, 100001))
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    p = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = p["score"].rank().to_numpy(), p["toxic"].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.92 and (p["predicted"] == p["toxic"]).mean() > 0.95


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    p = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    row = p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.avg(F.col("rejected").cast("int")).alias("rej")).first()
    assert row.acc > 0.99 and row.rej < 0.005


def test_language_edges(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(900, None, "en"), (901, "", "fr"), (902, "12 + 3!", "en"), (903, "the of and " * 50000, None), (None, "the and of", "en"), (901, "", "fr")], DOCS)
    both = docs.unionByName(odd).withColumn("_rejected", F.lit(1)).withColumn("score", F.lit("x"))
    got = langid.identify(both).collect()
    assert len(got) == docs.count() + 6
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert r.lang_pred == "und" and r.rejected and r.score == 0
    assert {r.lang_pred for r in got} <= {"en", "fr", "de", "es", "und"}
    assert langid.identify(docs.limit(0)).count() == 0
    alone = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in alone} == {"und"}
    kept = langid.keep_known(docs.unionByName(odd))
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0
    assert kept.count() >= docs.count() - 1
    clash = docs.withColumn("_rejected", F.lit("x")).withColumn("_score", F.lit(True)).withColumn("__lang_pred", F.lit(1))
    assert langid.keep_known(clash).columns == clash.columns and langid.keep_known(clash).count() >= docs.count() - 1


def test_language_rows_by_brute_force(spark, data):
    """Each row of the query: n-grams counted one by one, weighed, and compared with every centroid."""
    import math

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in docs.limit(60).collect():
        a = [c if c >= 128 or chr(c).isalpha() else 32 for c in (r.text or "").lower().encode()]
        a = [32, *[c for i, c in enumerate(a) if i == 0 or c != 32 or a[i - 1] != 32], 32]
        count = {}
        for n in langid.NGRAMS:
            for i in range(len(a) - n + 1):
                h = ((int.from_bytes(bytes(a[i : i + n]), "big") + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> 50
                count[h] = count.get(h, 0) + 1
        v = {h: (1 + math.log(c)) * float(model.idf[h]) for h, c in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosine)), key=lambda k: cosine[k])
        row = got[r.doc_id]
        assert row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not langid.has_letter(r.text):
            assert row.lang_pred == "und" and row.score == 0
        else:
            assert row.lang_pred == model.languages[model.of[best]] and row.score == pytest.approx(max(0.0, cosine[best]), abs=1e-4)
            assert row.rejected == (cosine[best] < model.floor[model.of[best]] * min(1.0, sum(count.values()) / langid.FULL))


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "12 ½ ² _!", "½a", "é", "日", "٣")] == [False, False, False, True, True, True, False]


def test_counts_are_those_of_all_ngrams():
    text = "Abc, déf  GH12x " * 3
    a = [c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()]
    a = [32, *[c for i, c in enumerate(a) if i == 0 or c != 32 or a[i - 1] != 32], 32]
    assert langid.counts(text).sum() == sum(len(a) - n + 1 for n in langid.NGRAMS)
    long = "abc " * 2_000_000  # longer than a chunk
    assert langid.counts(long).sum() == pytest.approx(3 * len(long), abs=20)


def test_licenses(spark):
    lines = {
        "MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "BSD": "### Released under the BSD license ###",
        "": "The license of poets is permission to be obscure, and version two was released under pressure.",
    }
    filler = "\n".join("Or the an of ination therly, and " + w for w in ("thion", "reaur", "license")) + "\n"
    rows = [(i, filler + t + "\n" + filler) for i, t in enumerate(lines.values())] + [(90, None), (91, ""), (92, filler * 5000 + lines["MIT"]), (93, lines["MIT"] + " and " + lines["GPL"]), (None, "x")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines)
    assert got[90] == got[91] == got[None] == "" and got[92] == "MIT"
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_licenses():
    """Headers as they stand in files, hard-wrapped and commented."""
    model = licenses.train([licenses.line_words("Or the an of ination therly, and " + w) for w in ("thion", "reaur", "street", "was it by")])
    gpl = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */"""
    bsd = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""
    apache = """// you may not use this file except in compliance with
// the License. You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0"""
    short = "dnl Licensed under the Apache\r\ndnl License, Version\r\ndnl 2.0"
    names = lambda t: sorted(k for k, _ in model.scan(t))
    assert [names(t) for t in (gpl, bsd, apache, short)] == [["GPL"], ["BSD"], ["Apache-2.0"], ["Apache-2.0"]]
    assert names(gpl.replace("General", "Lesser General").replace("2 of", "2.1 of")) == ["LGPL"]
    assert names(gpl.replace("General", "Affero General").replace("2 of", "3 of")) == ["AGPL"]
    assert names(gpl.replace("General", "Lesser General").replace("2 of", "3 of")) == ["LGPL"]
    assert names(bsd + "\n" + gpl) == ["BSD", "GPL"]
    assert names("the thion\n" + bsd + "\nof the therly\n" + bsd) == ["BSD", "BSD"]
    assert names("This work is licensed under CC BY-\nSA 4.0.") == ["CC-BY-SA"]
    assert names("Released under the MIT License.\nLicensed under CC BY 4.0.") == ["CC-BY", "MIT"]
    assert names(bsd.replace("with or without", "\n\n")) == [] and names("the license of\nan old street\nwas released by it") == []


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution."""
ISC = """// Permission to use, copy, modify, and/or distribute this software for any
// purpose with or without fee is hereby granted, provided that the above
// copyright notice and this permission notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


@pytest.fixture(scope="module")
def license_model():
    rng = random.Random(3)
    usual = "the of and to in is was on that it for as with be by this are or an not at from which but have they you all any may free use copy under made work terms".split()
    return licenses.train([[rng.choice(usual) for _ in range(rng.randint(4, 40))] for _ in range(1500)])


def test_full_texts(license_model):
    names = lambda t: sorted({k for k, _ in license_model.scan(t)})
    assert [names(t) for t in (MIT, BSD, ISC, ZLIB)] == [["MIT"], ["BSD"], ["ISC"], ["Zlib"]]
    assert names(MIT.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")) == ["MIT"]  # a paragraph a line
    assert names("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich accompanies this distribution") == ["EPL"]
    assert names("# Distributed under the Boost Software License, Version 1.0.") == ["BSL-1.0"]
    assert names(MIT + "\n\n" + ZLIB) == ["MIT", "Zlib"]
    assert names("you may use this work free of the terms that are made with it, and it is by any use of copy or work that they have") == []


def test_what_is_looked_at_first_loses_nothing(license_model, spark, data):
    """The scan against one that classifies every stretch and every run of lines."""
    slow = dataclasses_replace(license_model, signal=license_model.known)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [MIT, BSD, ISC, ZLIB]
    texts += ["\n".join(t) for k in licenses.TEMPLATES.values() for t in (k, k[::-1])]
    texts += [f"so it was {t.lower()} of that" for k in licenses.TEMPLATES.values() for t in k]
    assert [license_model.scan(t) for t in texts] == [slow.scan(t) for t in texts]


def test_license_rows_and_ties(spark, license_model):
    rows = [(1, MIT), (1, MIT), (2, "Released under the MIT License.\n\nReleased under the BSD license."), (None, "Licensed under the ISC License.")]
    got = [(r.doc_id, r.licenses, r.n_notices) for r in licenses.scan(spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, n_notices string, probability double")).collect()]
    assert got[0] == got[1] and got[0][1] == "MIT" and got[2][1:] == ("BSD,MIT", 2) and got[3][:2] == (None, "ISC")
    even = dataclasses_replace(license_model, weights=np.zeros_like(license_model.weights))
    assert even.classify(licenses.line_words("Released under the MIT License."))[0] == licenses.UNKNOWN  # nothing is sure


def test_licenses_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = licenses.scan(docs).join(docs, "doc_id")
    for name, line in {"MIT": "Released under the MIT License.", "GPL": "GNU General Public License, version 3", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}.items():
        has, said = F.col("text").contains(line), F.array_contains(F.split("licenses", ","), name)
        row = got.agg(F.count(F.when(has & said, 1)).alias("both"), F.count(F.when(has, 1)).alias("has"), F.count(F.when(said, 1)).alias("said")).first()
        assert row.has > 20 and row.both >= 0.97 * row.has and row.both >= 0.97 * row.said
