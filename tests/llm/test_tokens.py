"""Packing, byte-pair encoding and token files against the tokenizer libraries, whole texts at once."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.conftest import FOLDER
from tests.llm.conftest import ODD
from tidegrid.llm import byte_bpe, packing, token_files
from tidegrid.llm.common import new_folder
from tidegrid.llm.elias_fano import EliasFano
from tidegrid.llm.queries import QUERIES
from tidegrid.llm.units import library_encoder


def whole(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def noise(seed, n):
    rng = random.Random(seed)
    alphabet = "aab  \n\n\t\r.'sl1é́  \x1c<|>日Σ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_units_equal_whole_texts(name, kind):
    encode, want = library_encoder(P.path(name), kind), whole(name)
    texts = [t or "" for t in ODD] + noise(1, 3000)
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want(text), repr(text)


def test_backtracking_equals_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, units = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    runs = [c * n for c in "a =-e." for n in (2, 3, 5, 17, 100, 1001)]
    texts = [t or "" for t in ODD] + noise(3, 3000) + words + runs
    for text, found in zip(texts, units(texts)):
        ids = np.frombuffer(found, "<u4").tolist()
        assert ids == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_encode_decode_tables(spark, odd, none):
    ranks = P.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(odd, ranks, P.PATTERN), ranks, P.PATTERN)
    got = Counter((r.doc_id, bytes(r.decoded)) for r in both.collect())
    assert got == Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert byte_bpe.decode(byte_bpe.encode(none, ranks, P.PATTERN), ranks, P.PATTERN).count() == 0


def test_encode_and_decode_in_one_pass(spark, odd, none):
    """The same rows as one after the other; the query has one Python worker a task, so one memo."""
    ranks = P.path("byte_bpe_50k.tiktoken")
    rows = lambda df: Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in df.collect())
    assert rows(byte_bpe.encode(odd, ranks, P.PATTERN, decoded=True)) == rows(byte_bpe.decode(byte_bpe.encode(odd, ranks, P.PATTERN), ranks, P.PATTERN))
    assert byte_bpe.encode(none, ranks, P.PATTERN, decoded=True).count() == 0
    plan = QUERIES["op3_byte_bpe"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_digests(spark):
    want = whole("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = want(r.text)
        assert rows[r.doc_id][1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_best_fit_equals_scan():
    rng = random.Random(5)
    lengths = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    fit, room = packing.BestFit(100), []
    for length in lengths:
        name, offset = fit.place(length)
        able = [c for c in room if c >= length]
        if able:
            assert room[name] == min(able) and offset == 100 - room[name]
        else:
            assert name == len(room) and offset == 0
            room.append(100)
        room[name] -= length
    assert sum(room) < 100 + 0.02 * 100 * len(room)


def packed_right(rows, docs, window):
    """Every id in one piece, sequences gapless from 0 and within the window."""
    sequences, parts = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[(r.doc_id, r.start, bytes(r.ids))] += 1
        assert len(r.ids) == 4 * r.length > 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    encode, want = whole("word_bpe_49k.json"), Counter()
    for doc, text in docs:
        ids = encode(text) + [2]
        for at in range(0, len(ids), window):
            want[(doc, at, np.asarray(ids[at : at + window], "<u4").tobytes())] += 1
    assert parts == want
    return sequences


@pytest.mark.parametrize("window,group", [(4096, 8192), (16, 5)])
def test_packing(spark, odd, none, window, group):
    path = P.path("word_bpe_49k.json")
    packed_right(packing.pack(odd, path, window=window, group=group).collect(), [(r.doc_id, r.text) for r in odd.collect()], window)
    assert packing.pack(none, path).count() == 0


def test_packing_wastes_little(spark):
    rows = packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet"), P.path("word_bpe_49k.json")).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    sequences = packed_right(rows, docs, 4096)
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert len(lengths) <= -(-sum(lengths) // 4096) + 1
    digests = QUERIES["op1_packing"](spark, FOLDER).collect()
    assert Counter(r.ids_crc32 for r in digests) == Counter(zlib.crc32(r.ids) for r in rows)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [10**12, 10**12 + 1, 10**13]])
def test_elias_fano(values):
    code = EliasFano.build(np.asarray(values, np.uint64))
    assert code.all().tolist() == values
    assert [code[k] for k in range(len(values))] == values


def test_elias_fano_random():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 10**6, 5000))
    values[1000:3000] = values[1000]
    code = EliasFano.build(np.sort(values))
    assert [code[k] for k in range(5000)] == np.sort(values).tolist() == code.all().tolist()
    assert 8 * (code.low.nbytes + code.high.nbytes + code.samples.nbytes) < 5000 * (3 + np.log2(200))


def test_token_files(spark, odd, none):
    encode = whole("byte_bpe_50k.json")
    files = token_files.write_tokens(odd, new_folder(spark, "t"), P.path("byte_bpe_50k.json"))
    rows = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((r.doc_id, np.asarray(encode(r.text) + [2], "<u4").tobytes()) for r in odd.collect())
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    reader = token_files.TokenReader(files[0][0])
    assert [reader[k].tolist() for k in range(len(reader))] == [i.tolist() for _, _, i in reader]
    assert token_files.token_table(none, P.path("byte_bpe_50k.json")).count() == 0


def test_token_file_query(spark):
    encode, at = whole("byte_bpe_50k.json"), 0
    rows = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, FOLDER).collect()}
    for r in sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect()):
        ids = np.asarray(encode(r.text) + [2], "<u4")
        assert rows[r.doc_id][1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_many_ids_decode_as_one_by_one():
    bpe, _ = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = pa.array([[1, 2, 3], None, [], [500], [7, 8]], pa.list_(pa.int32()))
    for part in (ids, ids.slice(1, 3), ids.slice(4), ids.slice(0, 0)):
        assert bpe.decode_many(part).to_pylist() == [None if x is None else bpe.decode(x) for x in part.to_pylist()]
    with pytest.raises(KeyError):
        bpe.decode_many(pa.array([[None]], pa.list_(pa.int32())))
