"""Rules and near duplicates against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from tidegrid.llm import minhash, rules
from tidegrid.llm.graph import connected_components
from tidegrid.llm.shingles import shingle_set


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_ledger(spark, odd, none):
    more = spark.createDataFrame([(100, "a b c d e f g h " * 4), (101, "\n".join(["x # y"] * 5)), (102, " ".join(map(str, range(30))) + " 3 4 5 6 7 8 9 10 11 12")], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).withColumn("ledger", F.lit(1))
    rows = rules.ledger(docs).collect()
    assert rows[0].asDict().keys() - set(docs.columns) == {"ledger_"}
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["ledger_"])[:-1] == measured(r.text), r.text
    assert rules.ledger(none).count() == 0


def test_policies_and_ablation(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ledger = rules.ledger(docs).cache()
    bits = [r.ledger.failed for r in ledger.collect()]
    names = [n for n, _ in rules.RULES]
    for policy in rules.POLICIES:
        whole = rules.mask(policy)
        kept = sum(not b & whole for b in bits)
        assert rules.keep(docs, policy).count() == kept
        for r in rules.ablation(ledger, policy).collect():
            bit = 1 << names.index(r.rule)
            assert (r.n_failed, r.n_only, r.n) == (sum(bool(b & bit) for b in bits), sum(b & whole == bit for b in bits), len(bits))
            assert r.kept_without == sum(not b & whole & ~bit for b in bits)
    assert rules.ablation(ledger.limit(0)).first().kept_without == 0


def test_rules_leave_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    clean = docs.join(good, "doc_id", "left_semi")
    assert rules.keep(clean).count() >= 0.97 * clean.count()


def brute(rows, percent=75):
    sets = defaultdict(list)
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        s = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sets[doc].append(s)
    ids = sorted(k for k in sets if k is not None)
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(s & t) >= percent * len(s | t) > 0 for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in ids}


def edited(rng, words, share):
    return [rng.choice("pqrstuvwxyz") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(spark, odd, none, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, rows = random.Random(4), []
    base = [f"w{i}" for i in range(150)]
    rows += [(1000 + k, " ".join(edited(rng, base, 0.03))) for k in range(40)]  # siblings, often under the threshold
    rows += [(2000 + k, " ".join(base) + " tail") for k in range(30)]
    rows += [(3000 + k, " ".join(base[:40] + [f"u{k}_{i}" for i in range(200)])) for k in range(30)]  # a shared passage
    rows += [(4000, "Short Text"), (4001, "short text"), (4002, "short texts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd, allowMissingColumns=True)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if want.get(r.doc_id) == r.doc_id)


def test_estimate(spark):
    a, b = (shingle_set(" ".join(map(str, r)).encode()) for r in (range(500), range(50, 550)))
    m, n = minhash.minima(a), minhash.minima(b)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    equal = int(minhash.equal_minima(minhash.bit_planes(m)[None], minhash.bit_planes(n))[0])
    assert equal == int(((m ^ n) % 16 == 0).sum())
    assert abs(minhash.similarity(equal / 256) - true) < 0.15
    df = spark.createDataFrame([(minhash.bit_planes(m).tolist(), minhash.bit_planes(n).tolist())], "x array<long>, y array<long>")
    assert abs(df.select(minhash.estimate(F.col("x"), F.col("y"))).first()[0] - minhash.similarity(equal / 256)) < 1e-9


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    assert got == want
