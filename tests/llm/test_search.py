"""Ranked search and mixing against plain Python and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from tests.llm.conftest import ODD
from tidegrid.llm import mixing, search
from tidegrid.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def slow_search(items, docs, k):
    counted = [(doc, Counter(ts), len(ts)) for doc, text in docs if (ts := slow_terms(text))]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = {}
    for item, text in items:
        found = []
        for doc, c, size in counted:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(slow_terms(text)) if t in c)
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out[item] = [(doc, -s) for s, doc in sorted(found)[:k]]
    return out


def test_terms():
    for text in [*ODD, "Ab1-cD_éÉ x\x7fy 日本 ０a", " 　q"]:
        assert [t.decode() for t in search.terms(text or "")] == slow_terms(text)


@pytest.mark.parametrize("shard,block,k", [(7, 2, 5), (64, 100, 3), (4096, 4096, 50)])
def test_search_equals_brute_force(spark, odd, shard, block, k):
    rng = random.Random(shard)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 400])))) for i in range(300)]
    docs += [(i + 300, docs[i][1]) for i in range(30)] + [(400, "w5 " * 70000), (None, "w1 w2")] + [(i + 1000, t) for i, t in enumerate(ODD)]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 20)))) for i in range(7)] + [(8, None), (9, "absent"), (10, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "item_id": F.lit(None)})
    found = search.search(spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), df.repartition(3), k, shard=shard, block=block)
    got = defaultdict(list)
    for r in found.orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(got[r.item_id])
    want = slow_search(items, docs, k)
    assert {i: v for i, v in want.items() if v} == dict(got)


def test_blocks_stay_closed():
    """Once good scores are known, lists of low bounds are not decompressed whole."""
    rng = np.random.default_rng(3)
    lengths = [100] * 4096
    common, rare = np.arange(4096), rng.choice(4096, 20, replace=False)
    row = search.shard_row(list(range(4096)), lengths, np.concatenate([common, np.sort(rare)]), np.concatenate([np.full(4096, 1), np.full(20, 2)]))
    names = [c.strip().split()[0] for c in search.SCHEMA.split(",")]
    shard = search.Shard(dict(zip(names, row)), search.Weigher(4096, 409600))
    wanted = [(1, 1), (2, 5000)]
    scores, ids = shard.search(wanted, 0)
    assert len(ids) == 4096 and shard.opened == 33
    again = search.Shard(dict(zip(names, row)), search.Weigher(4096, 409600))
    scores, ids = again.search(wanted, int(np.sort(scores)[-20]))
    assert sorted(ids) == sorted(rare) and again.opened < 33


def test_no_items_or_documents(spark, none):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(items, none).count() == 0 and search.search(items.limit(0), items.withColumnRenamed("item_id", "doc_id")).count() == 0


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op12_search", "op13_mixing"])
def test_queries_equal_sql(spark, tables, name):
    out = QUERIES[name](spark, FOLDER)
    want = tables.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


def slow_mix(docs, seed=13, block=64):
    """doc_id -> (size, source_size, target, taken), block by block."""
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    have = {s: sum(sizes[d] for d, x, _ in docs if x == s) for s in sources}
    total, full = sum(have.values()), set()
    while True:
        left, shared = total - sum(3 * have[s] for s in full), sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and shared and weight[s] * left / shared > 3 * have[s]}
        if not more:
            break
        full |= more
    target = {s: float(3 * have[s]) if s in full else left * weight[s] / max(shared, 1) for s in sources}
    taken = Counter()
    for s in sources:
        n = -(-have[s] // block)
        if not n:
            continue
        digest = lambda text: hashlib.md5(text.encode()).hexdigest()
        mine = sorted((d for d, x, _ in docs if x == s), key=lambda d: (digest(f"{seed}/{d}"), d))
        words = [d for d in mine for _ in range(sizes[d])]
        short, over = divmod(have[s], n)
        bounds = [0]
        for j in range(n):
            bounds.append(bounds[-1] + short + (j < over))
        shift = int(digest(f"{seed}/{s or ''}")[:13], 16) % n
        place = {(j * 2147483647 + shift) % n: j for j in range(n)}
        assert len(place) == n
        for seat in range(min(3 * n, math.floor(target[s] * n / have[s] + 0.5))):
            j = place[seat % n]
            taken.update(words[bounds[j] : bounds[j + 1]])
    return {d: (sizes[d], have[s], target[s], taken[d]) for d, s, _ in docs}


def test_mix_equals_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for i in range(400):
        source = rng.choices(["hot", "b", "", None, "é", "Z", "tiny", "one"], [300, 40, 30, 20, 10, 10, 1, 1])[0]
        size = rng.choice([0, 1, 5, 60, 300, 2000 if source == "hot" else 5])
        docs.append((i, source, None if i == 7 else " \n".join(["w"] * size)))
    docs += [(1000, "empty source", ""), (1001, "empty source", None), (1002, "hot", "x " * 50000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"size": F.lit("x"), "pieces": F.lit(1), "key": F.lit(2), "n": F.lit(3)})
    want = slow_mix(docs)
    for out in (mixing.mix(df), mixing.mix(df.repartition(7), shard=16)):
        rows = out.collect()
        assert len(rows) == len(docs)
        for r in rows:
            taken = sum(p.length for p in r.pieces)
            assert (r.size, r.source_size, r.target, taken) == want[r.doc_id], r.doc_id
            assert taken <= 3 * r.size and all(0 <= p.start and p.start + p.length <= r.size and p.length > 0 for p in r.pieces)
        by = Counter()
        for r in rows:
            by[r.source] += sum(p.length for p in r.pieces)
        for r in rows:
            assert abs(by[r.source] - r.target) <= 64
    # shards hold every source's quota: near its share of the seats
    per = defaultdict(set)
    for r in rows:
        for p in r.pieces:
            per[p.shard].add((r.source, p.seat))
    sizes = [len(per[s]) for s in sorted(per)]
    assert all(n == 16 for n in sizes[:-1]) and len(sizes) > 3
    every = Counter(s for v in per.values() for s, _ in v)
    for shard in sorted(per)[:-1]:
        for source, n in every.items():
            assert abs(sum(s == source for s, _ in per[shard]) - 16 * n / sum(every.values())) <= 2


def test_mix_of_nothing(spark, odd, none):
    frame = odd.withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(none.withColumn("source", F.lit("a"))).count() == 0
    rows = mixing.mix(frame).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {None}
    blank = mixing.mix(frame.withColumn("text", F.lit(" "))).collect()
    assert all(r.size == 0 and r.target == 0 and r.pieces == [] for r in blank)
