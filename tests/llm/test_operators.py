"""Each operator against brute force on a small corpus with every kind of odd row, and on empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.llm import dart_minhash, gru
from foldspark.llm.dart_minhash import band_keys, dart_signatures, drop_near_duplicates, mix64, near_duplicates
from foldspark.llm.decontaminate import contaminated, contamination, decontaminate
from foldspark.llm.language_mixture import languages, mixtures
from foldspark.llm.licenses import license_scan
from foldspark.llm.line_dedup import DISTANCE, _lines, dedup_lines, simhashes
from foldspark.llm.linking import components
from foldspark.llm.lm_scoring import score_documents
from foldspark.llm.mixing import bisect_exponent, mix, mixture, temperature, token_shares
from foldspark.llm.quality_rules import binomial_tail, certify, quality_rules
from foldspark.llm.recompression import remove_repeats
from foldspark.llm.rule_ensemble import keep_good, quality_scores
from foldspark.llm.tables import with_key


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 3 -----------------------------------------------------------------------------------------------------------------


def repeat_words(ws):
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    return len({j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality_rules_base(docs, labels, corpus):
    want = Counter()
    for i, t, *_ in corpus:
        ws = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(ws) < 10 or 100 * repeat_words(ws) > 20 * len(ws)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        want[i, len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), repeat_words(ws), failed] += 1
    out = quality_rules(docs, labels)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.where("base_failed and kept").isEmpty()


def test_binomial_tail(spark):
    cases = [(0, 100, 0.01), (1, 500, 0.01), (3, 2000, 0.01), (0, 1, 0.3), (700, 100_000, 0.01)]
    for k, n, rate in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log(1 - rate)) for j in range(k + 1))
        got = spark.range(1).select(binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), rate)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_respect_the_risk(spark):
    rows = [("a", 1, 0 if i else 40) for i in range(3000)] + [("a", 0, 30)] * 200 + [("b", 1, 0)] * 20 + [("b", 0, 50)] * 20
    cuts = {r.stratum: r.cut_symbols for r in certify(spark.createDataFrame(rows, "stratum string, quality int, symbols int")).collect()}
    assert cuts == {"a": 30}  # one false rejection of 3000 is allowed; twenty good ones prove nothing


# 1 -----------------------------------------------------------------------------------------------------------------


def test_mixture_meets_its_quotas(spark, docs):
    out = mixture(docs, entropy_share=0.9, max_epochs=3.0, block_tokens=500).cache()
    texts = docs.groupBy(F.xxhash64("doc_id", "text", "source").alias("k")).agg(F.first("text").alias("text"), F.first("source").alias("s"))
    size = {r.k: (r.s or "", len(words(r.text))) for r in texts.collect()}
    tokens = Counter()
    for s, n in size.values():
        tokens[s] += n
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    shares = token_shares(docs.select(F.coalesce("source", F.lit("")).alias("source"), F.lit(1).alias("n_words")))
    assert {r.source for r in shares.collect()} >= set(tokens)
    share = {s: n / total for s, n in tokens.items()}

    def weights(e):
        z = sum(p**e for p in share.values())
        return {s: p**e / z for s, p in share.items()}

    def entropy(e):
        return -sum(w * math.log(w) for w in weights(e).values())

    grid = [i / 4096 for i in range(4097)]
    best = max([e for e in grid if entropy(e) >= 0.9 * entropy(0)], default=0)
    limit = min(e for e in grid if max(weights(e)[s] / share[s] for s in share) <= 3)
    quota = {s: w * total for s, w in weights(max(best, limit)).items()}
    taken, seen = Counter(), set()
    for r in out.collect():
        assert (r.k, r.epoch) not in seen and size[r.k] == (r.source, r.n_words)
        seen.add((r.k, r.epoch))
        taken[r.source] += r.n_words
    for s in tokens:
        longest = max(n for x, n in size.values() if x == s)
        assert taken[s] <= quota[s] * 1.01 + 1 and taken[s] >= quota[s] * 0.99 - longest
    # an epoch is started only when all documents of the earlier ones are taken
    for (k, e) in seen:
        assert e == 0 or all((k, x) in seen for x in range(e))
    mixed = mix(docs, block_tokens=500)
    assert mixed.columns == [*docs.columns, "epoch", "block_pos"]


def test_bisection(spark):
    shares = spark.createDataFrame([("a", 900, 0.9), ("b", 90, 0.09), ("c", 10, 0.01)], "source string, tokens bigint, share double")
    e = bisect_exponent(shares, lambda h, r: h >= 0.8, True)
    z = sum(p**e for p in (0.9, 0.09, 0.01))
    assert -sum(p**e / z * math.log(p**e / z) for p in (0.9, 0.09, 0.01)) == pytest.approx(0.8, abs=1e-8)
    assert temperature(shares, 5.0, None, 4.0) == 1.0  # every source would be read five times: no exponent helps
    assert temperature(shares, 1.0, None, 1000.0) == 0.0


# 2 -----------------------------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_line_dedup_against_all_pairs(docs, corpus):
    lines = _lines(with_key(docs)).withColumn("id", F.xxhash64("norm"))
    found = lines.distinct().collect()
    sim = {r.id: r.sim for r in simhashes(lines.select("id", "norm").distinct()).collect()}
    sims = {r.norm: sim[r.id] for r in found}
    texts = sorted(sims)
    links = []
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            near = ((sims[a] ^ sims[b]) & (2**64 - 1)).bit_count() <= DISTANCE
            if near and edit(a, b) <= math.floor(max(len(a), len(b)) * (1 - 0.9)):
                links.append((a, b))
    root = roots(texts, links)
    groups = defaultdict(list)
    for r in found:
        groups[root[r.norm]].append((r.doc_id is None, r.doc_id or 0, r.k, r.i))
    removed = Counter()
    for places in groups.values():
        for missing, doc_id, k, _ in sorted(places)[1:]:
            removed[k] += 1
    keyed = {(r.doc_id, r.text): r.k for r in with_key(docs).collect()}
    want = Counter((i, len(t.split("\n")) if t is not None else 0, removed[keyed[i, t]]) for i, t, *_ in corpus)
    out = dedup_lines(docs)
    assert rows_of(out, "doc_id", "lines_total", "lines_removed") == want
    assert out.columns == [*docs.columns, "lines_total", "lines_removed"]
    assert sum(removed.values()) > 8 and out.where("doc_id = 71 and text is null").count() == 1


@pytest.mark.parametrize("n_words", [3, 5, 10, 20, 40, 80, 200])
def test_lines_of_one_changed_word_are_found(spark, n_words):
    rng = np.random.default_rng(n_words)

    def word(size):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size))

    rows, similar = [], 0
    for i in range(200):
        ws = [word(rng.integers(4, 9)) for _ in range(n_words)]
        at, changed = rng.integers(n_words), list(ws)
        short = len(" ".join(ws)) < 90  # a letter of a short line, a word of a longer one
        changed[at] = ("#" + ws[at][1:]).replace("#", "q" if ws[at][0] != "q" else "z") if short else word(len(ws[at]))
        a, b = " ".join(ws), " ".join(changed)
        similar += sum(x != y for x, y in zip(a, b, strict=True)) <= len(a) // 10
        rows += [(2 * i, a), (2 * i + 1, b)]
    removed = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).agg(F.sum("lines_removed")).first()[0]
    assert similar == 200 and removed >= 198  # 3 words: none before, 200 words: nine in ten


def test_lines_without_spaces_are_found(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(100):
        a = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 60))
        rows += [(2 * i, a), (2 * i + 1, a[:20] + "\u9500" + a[21:40] + a[41:])]
    assert dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).agg(F.sum("lines_removed")).first()[0] == 100


def test_simhash_is_the_majority(spark):
    lines = ["a b c a", "b", "x " * 70_000 + "y"]
    table = spark.createDataFrame(list(enumerate(lines)), "id bigint, norm string")
    words = {r.w: r.h for r in spark.createDataFrame([(w,) for w in "abcxy"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r.id: r.sim for r in simhashes(table).collect()}
    for i, line in enumerate(lines):
        ws = line.split()
        want = sum(1 << b for b in range(64) if 2 * sum((words[w] >> b) & 1 for w in ws) > len(ws))
        assert got[i] & (2**64 - 1) == want


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


# 10 ----------------------------------------------------------------------------------------------------------------


def shingles(text):
    ws = words((text or "").lower())
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def test_near_duplicates_against_all_pairs(docs, corpus):
    units = {(i, t): shingles(t) for i, t, *_ in corpus}
    order = sorted(units, key=lambda u: (u[0] is None, u[0] or 0))
    links = []
    for n, a in enumerate(order):
        for m in range(n + 1, len(order)):
            x, y = units[a], units[order[m]]
            both = sum((x & y).values())
            if both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                links.append((n, m))
    root = roots(range(len(order)), links)
    want = Counter((u[0], order[root[n]][0]) for n, u in enumerate(order))
    want[2, 2] += 1  # the repeated row
    out = near_duplicates(docs)
    assert rows_of(out, "doc_id", "class_id") == want
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    firsts = Counter(order[n][0] for n in root if root[n] == n)
    assert rows_of(kept, "doc_id") == Counter({(i,): c for i, c in firsts.items()})


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (mix64(rng.integers(0, 2**62, n)) for n in (700, 150, 150))
    cell = np.concatenate([shared, a, shared, b])
    owner = np.repeat([0, 1], 850)
    sign = dart_signatures(owner, cell, 2, 2048)
    assert abs((sign[0] == sign[1]).mean() - 0.7) < 0.04
    height = np.where(np.arange(1700) % 850 < 700, 1.0, 0.5)
    sign = dart_signatures(owner, cell, 2, 2048, height)
    assert abs((sign[0] == sign[1]).mean() - 700 / 850) < 0.04
    assert (band_keys(sign, 8)[0] == band_keys(sign[:1], 8)[0]).all()


# 8 -----------------------------------------------------------------------------------------------------------------


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def test_contamination_against_all_windows(spark, docs, corpus):
    texts = {0: corpus[4][1], 1: "four WORDS of text", 2: None, 3: "...", 4: corpus[13][1].split("\n")[-1], 5: corpus[4][1], 6: "of", None: corpus[6][1][:200]}
    items = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "item_id int, text string, k int")
    want = Counter()
    for i, t, *_ in corpus:
        ws, hit, names = tokens(t), set(), []
        for item, x in texts.items():
            it = tokens(x)
            m = min(13, len(it))
            grams = {tuple(it[j : j + m]) for j in range(len(it) - m + 1)} if it else set()
            at = [j for j in range(len(ws) - m + 1) if grams and tuple(ws[j : j + m]) in grams]
            if at:
                names.append("null" if item is None else str(item))
                hit |= {p for j in at for p in range(j, j + m)}
        want[i, len(ws), len(hit), ",".join(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(ws)] += 1
    out = contamination(docs, items).withColumn("ids", F.array_join("item_ids", ",")).withColumn("bad", contaminated())
    assert rows_of(out, "doc_id", "n_words", "n_hit", "ids", "bad") == want
    bad = sum(c for w, c in want.items() if w[-1])
    assert bad > 2 and decontaminate(docs, items).count() == len(corpus) - bad


# 6 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("levels", [0, 2, 3])
def test_repeats_against_all_windows(docs, corpus, levels):
    least = {}
    for i, t, *_ in corpus:
        ws = words(t)
        for j in range(len(ws) - 12):
            g = tuple(ws[j : j + 13])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    want = Counter()
    for i, t, *_ in corpus:
        ws = words(t)
        gone = {p for j in range(len(ws) - 12) if i is not None and least[tuple(ws[j : j + 13])] < i for p in range(j, j + 13)}
        want[i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)] += 1
    assert rows_of(remove_repeats(docs, levels=levels), "doc_id", "n_words", "n_removed", "kept") == want


# 7 -----------------------------------------------------------------------------------------------------------------


def test_rule_ensemble_learns_and_holds_out(spark, docs, labels):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)), 1) for i in range(0, 300, 2)]
    bad = [(i, "!! ".join(f"W{j % 3}" for j in range(60)), 0) for i in range(1, 300, 2)]
    rows = spark.createDataFrame([(i, t, "l") for i, t, _ in good + bad], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id bigint, quality int")
    out = quality_scores(rows, marks).join(marks, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.predicted == r.quality for r in out if r.held_out]) > 0.97
    flipped = marks.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_scores(rows, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in out)  # held-out labels change nothing
    odd = quality_scores(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").isEmpty()
    assert keep_good(docs, labels.where("doc_id < 0")).columns == docs.columns


# 4 -----------------------------------------------------------------------------------------------------------------


def test_languages(docs, corpus):
    out = languages(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in corpus)
    told = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(told[i].lang_pred == ("xx" if i % 2 == 0 else "yy") for i in range(60) if i % 10 != 3)
    assert {told[i].lang_pred for i in (71, 72, 73, 74)} == {"und"} and told[71].score == 0
    assert all(0 <= r.score <= 1 and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)) for r in out)


def test_mixture_of_two_languages():
    rng = np.random.default_rng(0)
    kind = np.concatenate([np.zeros(140, int), np.ones(60, int), np.zeros(50, int)])
    likelihood = rng.normal(-20, 1, (250, 3))
    likelihood[np.arange(250), kind] += 8
    share, size = mixtures(likelihood, np.repeat([0, 1], [200, 50]), 2)
    assert list(size) == [2, 1] and share[0] == pytest.approx([0.7, 0.3, 0], abs=0.02) and list(share[1]) == [1, 0, 0]


# 5 -----------------------------------------------------------------------------------------------------------------


def test_license_rules(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore words.",
        2: grant + source + binary,
        3: source + grant,
        4: "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        5: None,
        6: "",
        7: "the mit license is nice",
    }
    out = license_scan(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()
    assert {r.doc_id: (r.licenses, r.n_unmatched) for r in out} == {
        1: ("MIT", 0), 2: ("BSD-2-Clause", 0), 3: ("", 2), 4: ("Apache-2.0,CC-BY-NC-4.0", 0), 5: ("", 0), 6: ("", 0), 7: ("", 0),
    }


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0": """This work is licensed under a Creative Commons Attribution 4.0
International License.""",
    "CC-BY-SA-4.0": "Licensed under\nCC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC\nBY-NC 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General\nPublic License, version 3.",
    "GPL-2.0-only": "Licensed under the GNU General\nPublic License, version 2.",
}
WRAPPED["BSD-2-Clause"] = WRAPPED["BSD-3-Clause"].partition("\n\n3.")[0]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_wrapped_license_texts(spark, prefix):
    rows = [(name, "Copyright (c) 2020 A\n\n" + "\n".join(prefix + x for x in text.split("\n")) + "\nand more") for name, text in WRAPPED.items()]
    out = license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: (r.licenses, r.n_unmatched) for r in out} == {name: (name, 0) for name in WRAPPED}


# 9 -----------------------------------------------------------------------------------------------------------------


def test_base_scores_and_proper_probabilities(docs, corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, [*words((t or "").translate(low)), None]) for i, t, *_ in corpus]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    c = Counter(w for h, (_, ws) in zip(held, texts, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, h, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for h, (i, ws) in zip(held, texts, strict=True))
    out = score_documents(docs).cache()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    assert got == want
    assert out.where("score >= 0 or score is null").isEmpty()


def test_every_learned_document_trains_the_network(spark, docs, monkeypatch):
    from foldspark.llm import lm_scoring

    read = spark.sparkContext.accumulator(0)

    def counting(vocabulary, net):
        def learn(batches):
            for frame in batches:
                read.add(len(frame))
            yield from ()

        return learn

    monkeypatch.setattr(lm_scoring, "_trainer", counting)
    vocabulary = lm_scoring.Vocabulary(np.arange(3), np.array([5, 4, 3]), 1, 13, 4)
    tokens = lm_scoring._tokens(docs)
    lm_scoring._train(tokens, vocabulary)
    assert read.value == tokens.count()  # each once, over all passes


def test_texts_are_cut_into_words_once(docs, monkeypatch):
    from foldspark.llm import lm_scoring

    cuts = []
    cut = lm_scoring._words
    monkeypatch.setattr(lm_scoring, "_words", lambda: cuts.append(1) or cut())
    score_documents(docs)
    assert len(cuts) == 1  # counting, both passes and scoring read the kept hashes


def test_common_words_are_found_by_their_leads():
    from foldspark.llm.lm_scoring import Vocabulary

    rng = np.random.default_rng(0)
    hashes = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3_000), [-(2**63), 2**63 - 1], np.arange(40)]))
    counts = np.arange(len(hashes)) + 1
    vocabulary = Vocabulary(hashes, counts, 1, int(counts.sum()) + 1, len(hashes) + 1)
    asked = np.concatenate([hashes, rng.integers(-(2**63), 2**63 - 1, 5_000), hashes + 1])
    symbols, weights, common = vocabulary.look_up(asked)
    of = dict(zip(hashes.tolist(), counts.tolist()))
    assert common.tolist() == [h in of for h in asked.tolist()]
    assert np.allclose(weights, [math.log10(of[h] + 0.1) if h in of else 0.0 for h in asked.tolist()], atol=1e-12)
    assert symbols.dtype == np.int32 and ((symbols > 1) <= common).all()


def test_network_gradients_and_sums():
    rng = np.random.default_rng(0)
    cuts = np.array([0, 1, 2, 6, 12])
    net = {k: v.astype(np.float64) for k, v in gru.start(rng.integers(1, 50, 12).astype(float), cuts, 4).items()}
    for k in "KO":
        net[k] = rng.normal(0, 0.3, net[k].shape)
    ids, y, h = rng.integers(0, 12, (5, 3)), rng.integers(0, 12, (5, 3)), rng.normal(0, 0.1, (3, 4))
    grads = gru.gradients(net, cuts, ids, y, h)[0]
    for k in net:
        i = tuple(rng.integers(0, n) for n in net[k].shape)
        old, ends = net[k][i], []
        for step in (1e-3, -1e-3):
            net[k][i] = old + step
            ends.append(gru.gradients(net, cuts, ids, y, h)[2])
        net[k][i] = old
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(grads[k][i], abs=3e-4)
    state = rng.normal(0, 1, (1, 4))
    total = sum(np.exp(gru.log_probability(net, cuts, state, np.array([s]))[0]) for s in range(12))
    assert total == pytest.approx(1)


def test_score_carries_the_state_over_windows():
    rng = np.random.default_rng(2)
    cuts = np.array([0, 1, 2, 8])
    net = gru.start(rng.integers(1, 9, 8).astype(float), cuts, 4)
    net["K"], net["O"] = rng.normal(0, 1, net["K"].shape).astype(np.float32), rng.normal(0, 1, net["O"].shape).astype(np.float32)
    texts = [np.append(rng.integers(1, 8, n), 0) for n in (0, 3, 150, 70)]
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    a, b = gru.score(net, cuts, flat, lengths, 7), gru.score(net, cuts, flat, lengths, 1000)
    alone = [gru.score(net, cuts, t, np.array([len(t)]))[0] for t in texts]
    assert a == pytest.approx(b, rel=1e-5) and a == pytest.approx(alone, rel=1e-5)


# all ---------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, no_docs, docs, labels):
    none = labels.where("doc_id < 0")
    items = spark.createDataFrame([], "item_id int, text string")
    for out in (
        mixture(no_docs), dedup_lines(no_docs), quality_rules(no_docs, none), languages(no_docs), license_scan(no_docs),
        remove_repeats(no_docs), quality_scores(no_docs, none), contamination(no_docs, items), score_documents(no_docs),
        near_duplicates(no_docs),
    ):
        assert out.isEmpty()
    assert contamination(docs, items).where("n_hit > 0 or n_items > 0").isEmpty()
    assert quality_rules(docs, none).where("kept").count() > 50


def test_pipeline(spark, tmp_path, docs, labels, corpus):
    import corpus_pipeline

    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    slim.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus[4][1])], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*slim.columns, "epoch", "block_pos"]
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert 4 not in ids and ids <= {i for i, *_ in corpus}  # 4 is the benchmark's text
    assert all(r.text == "" for r in rows if r.doc_id == 70)  # the lines of an exact copy are gone, the document stays


def test_exact_copies_do_not_survive_line_and_near_dedup(spark, docs):
    import corpus_pipeline

    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    marked = slim.where("doc_id in (5, 72)").unionByName(slim.where("doc_id = 5").withColumn("doc_id", F.lit(80).cast("bigint")))
    marked = marked.unionByName(marked.where("doc_id = 5").select(F.lit(81).cast("bigint").alias("doc_id"), F.concat("text", F.lit("\n---")).alias("text"), "lang", "source", "n_chars"))
    out = corpus_pipeline.near(spark, corpus_pipeline.lines(spark, marked, ""), "")
    assert sorted(r.doc_id for r in out.collect()) == [5, 72]  # 72 had no words to begin with


def test_prefix_pairs_make_every_similar_pair_and_few_others(spark):
    rng = random.Random(11)
    centre = [rng.getrandbits(60) for _ in range(120)]
    sets = {}
    for i in range(160):  # copies about as far from the centre as allowed, some of other sizes, some with edits in common
        kept = rng.sample(centre, 120 - rng.randint(4, 22) - (15 if i % 7 == 0 else 0))
        sets[i] = set(kept) | {rng.getrandbits(60) if rng.random() < 0.7 else 1000 + rng.randint(0, 40) for _ in range(rng.randint(4, 22))}
    sets |= {200 + i: {5 + j for j in range(i + 1)} for i in range(6)} | {300: {1}, 301: {1}, 302: {2}}
    cells = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, cells array<long>")
    left = spark.createDataFrame([(i, i // 2) for i in sets], "id long, label long")
    made = {(min(r.a, r.b), max(r.a, r.b)) for r in dart_minhash.prefix_pairs(cells, left, 0.8).collect()}
    similar = set()
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and i // 2 != j // 2 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                similar.add((i, j))
    assert similar and similar <= made
    assert len(made) < 160 * 159 / 4


def test_scores_do_not_depend_on_the_texts_read_side_by_side(monkeypatch):
    rng = np.random.default_rng(4)
    cuts = np.array([0, 1, 2, 6, 12])
    net = gru.start(rng.integers(1, 50, 12).astype(float), cuts)
    net["O"] = rng.normal(0, 0.5, net["O"].shape).astype(np.float32)
    lengths = rng.integers(1, 200, 50)
    ids = rng.integers(1, 12, lengths.sum())
    ids[np.cumsum(lengths) - 1] = 0
    whole = gru.score(net, cuts, ids, lengths)
    monkeypatch.setattr(gru, "ABREAST", 7)
    assert np.allclose(gru.score(net, cuts, ids, lengths), whole, rtol=1e-5)


def test_log_probabilities_hold_logits_of_some_targets_at_once():
    import tracemalloc

    rng, cuts = np.random.default_rng(3), np.array([0, 1, 2, 40, 120])
    net = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru.start(rng.integers(1, 50, 120).astype(float), cuts).items()}
    states, targets = rng.normal(0, 1, (200_000, 16)).astype(np.float32), rng.integers(0, 120, 200_000)
    tracemalloc.start()
    found = gru.log_probability(net, cuts, states, targets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * states.nbytes  # those of all targets were held: 8 times
    assert found[-5:] == pytest.approx(gru.log_probability(net, cuts, states[-5:], targets[-5:]), abs=1e-4)
