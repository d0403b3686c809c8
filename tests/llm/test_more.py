"""Chunk dedup, factor machine, top products, chat windows, licences, pipeline against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import FOLDER
from tidegrid.llm import chat, chunks, licences, quality, topk
from tidegrid.llm.queries import ORACLES, QUERIES


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def slow_cuts(text):
    out = [0]
    for i in range(1, len(text)):
        h = sum(int(chunks._GEAR[text[i - 1 - j]]) << j for j in range(min(8, i))) % (1 << 16)
        space, before = text[i] in b" \t\n\v\f\r", text[i - 1] in b" \t\n\v\f\r"
        if (not space and before and h < chunks.AT_WORD) or (not space and text[i] & 0xC0 != 0x80 and h < chunks.INSIDE):
            out.append(i)
    return [*out, len(text)]


def test_cuts_equal_plain_loop():
    rng = random.Random(3)
    for text in [words(rng, 60).encode(), ("日本語の文章" * 40).encode(), b"aaaa" * 50, b"x", b" ", "é \n ü".encode()]:
        assert chunks.chunks(text)[0].tolist() == slow_cuts(text)


def slow_windows(text, least=chunks.MIN_WORDS):
    """(begin, end) of chunks: from each bound to the first bound with enough words, or bytes, before it."""
    starts, out = slow_cuts(text), []
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", text)]
    for start in starts[:-1]:
        begin = max(start, spans[0][0])
        later = [b for a, b in spans if b > begin]
        enough = min(later[least - 1] if len(later) >= least else len(text) + 1, begin + least * chunks.BYTES_A_WORD)
        if enough <= len(text):
            bound = next(b for b in starts if b >= enough)
            out.append((begin, begin + len(text[begin:bound].rstrip(b" \t\n\v\f\r"))))
    return out


def test_variable_chunks_equal_plain_loop():
    rng = random.Random(4)
    for text in [words(rng, 150), "  " + words(rng, 40) + " \n\n " + words(rng, 40) + "  ", "日本語の文章を書く" * 60, "a" * 900, words(rng, 12), words(rng, 11)]:
        cut = chunks.chunks(text.encode())
        assert list(zip(cut.begins.tolist(), cut.ends.tolist())) == slow_windows(text.encode())
        assert all(len(text.encode()[a:b].split()) >= 12 or b - a >= 12 * chunks.BYTES_A_WORD for a, b in zip(cut.begins, cut.ends))


def slow_dedup(docs):
    """doc -> spans, one document after another, every chunk against every earlier document."""
    cuts = {d: chunks.chunks(t.encode()) for d, t in docs.items()}
    owner = {}
    for d in sorted(cuts):
        for digest in cuts[d].digests.tolist():
            owner.setdefault(digest, d)
    out = {}
    for d, cut in cuts.items():
        digests, text = cut.digests.tolist(), docs[d].encode()
        known = [x for x in digests if owner[x] < d]
        at = {i for i, x in enumerate(digests) if x in set(known)}
        touch = lambda i, j: 0 <= min(i, j) and max(i, j) < len(digests) and cut.begins[max(i, j)] <= cut.ends[min(i, j)]
        edges = {digests[i] for i in at if not (i - 1 in at and touch(i - 1, i)) or not (i + 1 in at and touch(i, i + 1))}
        contexts = {}
        for x in edges:
            other = cuts[owner[x]]
            contexts[x] = [chunks.around(docs[owner[x]].encode(), other, other.digests.tolist().index(x))]
        again = chunks.repeated_windows(cut, np.array(known, np.int64))
        out[d] = chunks.covered(text, chunks.pieces(text, cut, again, contexts))
    return out


def test_dedup_equals_plain_loop(spark):
    """Passages in many documents, many times in their owner, at starts and ends, in rows and overlapping."""
    rng = random.Random(12)
    passages = [words(rng, n) for n in (13, 30, 55, 70, 200)]
    docs = {}
    for d in range(60):
        parts = [rng.choice([words(rng, rng.randrange(1, 60)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))]
        docs[d] = rng.choice([" ", "\n", "  "]).join(parts)
    docs[7] = " ".join(f"{words(rng, 6)} {passages[3]}" for _ in range(30))
    docs |= {100 + d: f"{words(rng, 9)} {passages[3]} {words(rng, 9)}" for d in range(40)}
    found = chunks.dedup(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(5)).collect()
    want = slow_dedup(docs)
    assert len(found) == len(docs)
    for r in found:
        assert [tuple(s) for s in r.chunks.spans] == want[r.doc_id], r.doc_id


def test_an_owner_answers_once(spark):
    """A passage many times in its owner and in many documents: one context a chunk that is asked for."""
    rng = random.Random(13)
    passage = words(rng, 60)
    docs = [(0, " ".join(f"{words(rng, 5)} {passage}" for _ in range(100)))] + [(d, f"{words(rng, 9)} {passage} {words(rng, 9)}") for d in range(1, 80)]
    asked = sorted(set(chunks.chunks(docs[1][1].encode()).digests.tolist()))
    rows = spark.createDataFrame([(*docs[0], asked)], "doc_id long, text string, _known array<long>")
    answers = chunks.answers_of(rows, 1, chunks.MIN_WORDS).collect()
    assert 1 <= len(answers) == len({r.digest for r in answers}) <= len(asked)


def test_repeated_passages_go(spark, odd, none):
    rng = random.Random(9)
    passages = [words(rng, 70) for _ in range(20)]
    rows = [(100 + k, f"{words(rng, 80)} {passages[k % 20]} {words(rng, 80)}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd, allowMissingColumns=True).withColumn("chunks", F.lit(1))
    out = chunks.dedup(docs)
    assert out.columns == [*docs.columns, "chunks_"]
    found = {r.doc_id: r for r in out.collect() if r.doc_id is not None and r.doc_id >= 100}
    assert out.count() == docs.count()
    caught = 0
    for doc, text in rows:
        r = found[doc]
        spans = [tuple(s) for s in r["chunks_"].spans]
        raw = text.encode()
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
        assert r.text == kept.decode()
        if doc < 120:
            assert r.text == text and not spans  # the first copy, and all else, stays
        else:
            caught += bool(spans) and r["chunks_"].owners == [100 + doc % 20]
            middle = text.index(passages[doc % 20]), text.index(passages[doc % 20]) + 1 + len(passages[doc % 20])
            assert all(middle[0] <= a and b <= middle[1] for a, b in spans)
    assert caught >= 38
    assert chunks.dedup(none).count() == 0


def test_only_contiguous_passages_go(spark):
    rng = random.Random(4)
    text = words(rng, 600)
    starts = chunks.chunks(text.encode())[0].tolist()
    # each short chunk of the last text stands in an earlier one of its own, with the bytes that its bounds depend on
    parts = [text[max(0, a - 8) : b] for a, b in zip(starts, starts[1:])]
    rows = [(k, f"{words(rng, 20)} {p}{words(rng, 20)}") for k, p in enumerate(parts) if len(p.split()) < 9] + [(1000, text)]
    found = {r.doc_id: r for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1000].text == text and not found[1000].chunks.spans


def test_passages_go_whole(spark):
    rng = random.Random(12)
    passages = [words(rng, 51) for _ in range(150)]
    rows = [(k, f"{words(rng, 30)} {passages[k % 150]} {words(rng, 30)}") for k in range(300)]
    twice = words(rng, 60)
    rows.append((900, f"{words(rng, 30)} {twice} {words(rng, 30)} {twice} {words(rng, 30)}"))
    found = {r.doc_id: r.text for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k] == text for k, text in rows[:150])
    whole = [found[k] == text.replace(passages[k - 150] + " ", "") for k, text in rows[150:300]]
    assert sum(whole) >= 149  # a passage without a bound in its first 40 words is missed (1 in 1,000)
    assert found[900] == twice.join(rows[-1][1].split(twice)[:2]) + rows[-1][1].split(twice)[2].lstrip()


@pytest.mark.parametrize("unit", ["words", "characters"])
def test_removed_text_stands_earlier(unit):
    rng = random.Random(6)
    make = (lambda n: words(rng, n)) if unit == "words" else (lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n * 20)))
    passage = make(60)
    text = f"{make(50)} {passage} {make(50)} {passage} {make(50)}".encode()
    cut = chunks.chunks(text)
    again = chunks.repeated_windows(cut, np.empty(0, np.int64))
    assert again.any()
    for a, b in zip(cut.begins[again].tolist(), cut.ends[again].tolist()):
        assert text.find(text[a:b]) + b - a <= a and text[a:b].decode()


def test_factor_machine_identity():
    model = quality.FactorMachine.new()
    index, x = quality.features("some words some more, words!", 28)
    pairs = sum(float(model.factors[i] @ model.factors[j]) * x[a] * x[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    assert abs(model.margin(index, x) - (model.bias + x @ model.linear[index] + pairs)) < 1e-5


def test_classifier(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out()).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows]) >= 0.93
    assert all(0 <= r.score <= 1 for r in quality.score(odd.withColumn("n_chars", F.lit(None).cast("long")), model).collect())
    assert quality.score(none, model).count() == 0 and quality.keep(odd, model).columns == odd.columns
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(5), empty).collect()} == {0.5}


def test_top_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 3])).tolist()) for i in range(450)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (None, [1.0]), (2100, []), (2200, [2.0, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 100 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in scores]
    assert topk.top_k(df.limit(0)).count() == 0


def test_windows_stay_in_budget_and_read_back(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "be <|im_end|> kind")]
    rows += [(c, k + 1, rng.choice(["user", "assistant", None]), words(rng, rng.choice([1, 40, 400, 1500]))) for c in (1, 2) for k in range(30)]
    rows += [(3, 0, "system", "alone"), (4, 0, "assistant", words(rng, 5000)), (5, None, "a\nb", None), (None, 1, "user", "<\\| [INST] <<SYS>> </s> <\\\\|x"), (6, 1, "user", "same"), (6, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(0)).withColumn("window", F.lit("x"))
    windows = chat.format_windows(df)
    read = defaultdict(list)
    for r in chat.read_windows(windows).orderBy("conv_id", "window").collect():
        read[r.conv_id].append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for r in read[conv] for t in r.turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert [t for r in read[conv] for t in r.loss_texts] == [r[3] or "" for r in mine if r[2] == "assistant"]
    shown = windows.collect()
    assert all(w.tokens <= chat.BUDGET or w.n_turns - w.n_repeated == 1 for w in shown)
    assert any(w.n_repeated > 1 for w in shown) and all("be <\\|im_end|> kind" in w.text for w in shown if w.conv_id == 1)
    assert chat.format_windows(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_licences(spark, odd, none, licence_model):
    model = licence_model
    given = [(1, "text\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under the Frobnicate License, version 9."), (4, "the license of the band is on the wall"), (5, "plain words"), (6, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.")]
    rows = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(given, "doc_id long, text string"), model).collect()}
    assert [[(e.paragraph, e.family) for e in rows[k]] for k in range(1, 7)] == [[(1, "mit")], [(0, "apache")], [(0, "unknown")], [(0, "unknown")], [], [(0, "cc"), (1, "gpl")]]
    for e, text in ((rows[1][0], given[0][1].split("\n")[1]), (rows[2][0], given[1][1])):
        assert abs(e.probability - max(model.probabilities(text)[:-1])) < 1e-6
    assert licences.scan(odd.withColumn("licences", F.lit(1)), model).count() == odd.count()
    assert licences.scan(none, model).count() == 0


def test_wrapped_licences(spark, licence_model):
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    apache = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.'
    long = gnu.replace("\n# ", " " * 200 + "\n# ")  # lines of any length are joined
    texts = [gnu, f"/*\n{bsd}\n */\nint x;", apache, f"{gnu}\n#\nplain\n\n{bsd}", long]
    rows = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), licence_model).collect()}
    assert [[(e.paragraph, e.family) for e in rows[k]] for k in range(5)] == [[(0, "gpl")], [(1, "bsd")], [(0, "apache")], [(0, "gpl"), (6, "bsd")], [(0, "gpl")]]


#: Mentions and paraphrases that are no example of the fit, by family; None: a licence, but none of these.
MENTIONS = [
    ("mit", "This project is MIT licensed."), ("mit", "MIT License"), ("mit", "You may use this code under the terms of the MIT license."), ("mit", "License: MIT License (see file)"),
    ("apache", "The sources are available under the Apache License, v2.0."), ("apache", "Apache License 2.0"), ("apache", "This module is distributed under Apache-2.0."),
    ("gpl", "This file is released under the GPLv2."), ("gpl", "You can copy it under GPL v3 or later."), ("gpl", "See the GNU General Public License for more details."), ("gpl", "distributed under the terms of the GNU General Public License"),
    ("agpl", "GNU Affero General Public License v3.0"), ("agpl", "The server part is under the AGPLv3."), ("lgpl", "GNU Lesser General Public License"), ("lgpl", "The library may be linked under LGPL v2.1."),
    ("bsd", "It is BSD licensed."), ("bsd", "New BSD license applies to these files."), ("bsd", "3-Clause BSD"), ("cc0", "CC0 1.0 Universal public domain"), ("cc0", "The data set is dedicated to the public domain with CC0."),
    ("cc", "Text is available under CC BY-SA 4.0."), ("cc", "Photo: Creative Commons Attribution 3.0"), ("mpl", "Mozilla Public License 2.0"), ("mpl", "Dual use is allowed by MPL 2.0."),
    ("epl", "Eclipse Public License - v 2.0"), ("eupl", "EUPL v1.2"), ("isc", "ISC License"), ("unlicense", "The Unlicense"), ("isc", "Code under the ISC licence, see below."),
    ("mit", "The above copyright notice and this permission notice must be included in all copies or substantial portions of the software."),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors be liable for any claim or damages."),
    ("bsd", "Neither the name of the company nor the names of its contributors may be used to endorse or promote products derived from this software without written permission."),
    (None, "Licensed under the Frobnicate License, version 9."), (None, "Copyright 2019 The Authors. All rights reserved."), (None, "This file is licensed under the Boost Software License."), (None, "Released under the zlib license."),
    (None, "Artistic License 2.0"), (None, "All content is copyright of its owners and may not be copied."), (None, "Licensed under terms that you find in the contract."), (None, "SPDX-License-Identifier: WTFPL"), (None, "Python Software Foundation License"),
]
PROSE = ["The mit was close to the public square.", "General public opinion is free of charge.", "They were cc to the apache tribe of the west.", "A copy of the software was sold.", "In general the public may use the park for any purpose."]


def test_licence_mentions_not_seen_in_the_fit(spark, licence_model):
    texts = [t for _, t in MENTIONS] + PROSE
    rows = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), licence_model).collect()}
    found = [[e.family for e in rows[k]] for k in range(len(texts))]
    named = [(want, f[0] if f and f[0] != "unknown" else None, t) for (want, t), f in zip(MENTIONS, found)]
    right = sum(w == g for w, g, _ in named if w)
    wrong = [(w, g, t) for w, g, t in named if g and g != w]
    missed = [(w, t) for w, g, t in named if w and not g]
    print("recall", right, "of", sum(w is not None for w, _, _ in named), "wrong", wrong, "missed", missed, "bound", licence_model.sure, "cues", len(licence_model.cues), "weights", len(licence_model.weights))
    assert right >= 0.85 * sum(w is not None for w, _, _ in named) and len(wrong) <= 1
    assert all(not f or f == ["unknown"] for f in found[len(MENTIONS):])


def slow_scan(model, text):
    """(line, family, probability, share) as the rules say, with Python's own patterns."""
    speaks, cue, signs = (re.compile(p, re.ASCII) for p in (licences.SPEAKS, licences.cue_pattern(model), licences.SIGNS))
    if not cue.search(text or ""):
        return []
    lines = [signs.sub("", line) for line in text.split("\n")]

    def found(line, names):
        words, p = licences.words_of(line), np.array(model.probabilities(line))
        k = int(p[:-1].argmax())
        family, share = licences.FAMILIES[k], licences.template_share(words, licences.FAMILIES[k], names)
        sure = p[k] >= model.sure and share >= licences.SHARED and set(model.own[family]) & set(licences.grams(words))
        return (family if sure else "unknown" if speaks.search(line) else None), p[k], share

    out = [(i, *e) for i, line in enumerate(lines) if cue.search(line) for e in [found(line, False)] if e[0] not in (None, "unknown")]
    held = {e[0]: e[1] for e in out}
    runs, now = [], []
    for i, line in enumerate([*lines, ""]):
        if line and i not in held:
            now.append(i)
        elif now:
            runs.append(now)
            now = []
    for run in runs:
        whole = " ".join(["", *(lines[i] for i in run)])
        if cue.search(whole):
            family, p, share = found(whole, True)
            before = held.get(run[0] - 1)
            terms = {w for x in licences.NOTICES.get(before, []) for w in licences.words_of(x)}
            words = set(licences.words_of(whole))
            if family and not (family == "unknown" and before and len(words & terms) >= licences.SHARED * len(words)):
                out.append((next((i for i in run if cue.search(lines[i])), run[0]), family, p, share))
    return sorted(out)


def test_scan_equals_plain_python(spark, licence_model):
    """Texts of notices, mentions, prose and odd lines in all arrangements, one by one."""
    rng = random.Random(21)
    pieces = [t for _, t in MENTIONS] + PROSE + [n for ns in licences.NOTICES.values() for n in ns] + ["", "", " * ", "# x", "int main() {", "ordinary words of a text", "/* see licenses */"]
    texts = ["\n".join(rng.choice(["", "// ", " * "]) + rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + [""]
    rows = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), licence_model).collect()}
    for k, text in enumerate(texts):
        want, got = slow_scan(licence_model, text), [tuple(e) for e in rows[k]]
        assert [(e[0], e[1]) for e in got] == [(e[0], e[1]) for e in want], text
        np.testing.assert_allclose([e[2:] for e in got], [e[2:] for e in want], atol=1e-6)


def test_scan_looks_at_all_that_meets_the_conditions(spark, licence_model):
    """Notices with some words left out: each that meets the bound, the share and has a word of its family is named."""
    model, want = licence_model, {}
    for notice in (n for ns in licences.NOTICES.values() for n in ns):
        words = notice.split()
        for at, lost in itertools.product(range(len(words)), range(1, 5)):
            text = " ".join(words[:at] + words[at + lost :])
            have, p = licences.words_of(text), np.array(model.probabilities(text))
            family = licences.FAMILIES[int(p[:-1].argmax())]
            if p[:-1].max() >= model.sure and licences.template_share(have, family) >= licences.SHARED and set(model.own[family]) & set(licences.grams(have)):
                want[text] = family
    docs = spark.createDataFrame(list(want.items()), "text string, family string")
    found = {r.text: [e.family for e in r.licences] for r in licences.scan(docs, model).collect()}
    assert len(want) > 1000 and not {t: (f, found[t]) for t, f in want.items() if found[t] != [f]}


def test_licences_beside_the_notices(spark):
    lines = ["Copyright (c) 2020 X. All rights reserved.", "Licenced under the Y licence", "see licenses"]
    # the sample has words of the notices, as any corpus may
    model = licences.fit(["the gpl and the apache are hereby plain words", "all rights of the version see under", *(f"word{k} is here" for k in range(200))])
    rows = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(enumerate([*lines, "SPDX-License-Identifier: Apache-2.0"]), "doc_id long, text string"), model).collect()}
    assert [[e.family for e in rows[k]] for k in range(4)] == [["unknown"]] * 3 + [["apache"]]
    assert any("apache" in g.split() for g in model.weights)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert Counter(map(tuple, QUERIES[name](spark, FOLDER).select(*columns).collect())) == Counter(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, FOLDER)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    folder = "/root/testdata/sf0.01"
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), folder).collect()}
    assert len(good & kept) >= 0.97 * len(good)
