"""Substring dedup by content-defined chunks.

A gear hash rolls over the last eight bytes; a chunk starts at a word whose preceding bytes hash below a bound (one
word in six), or, in text without spaces, at one character in 256. Bounds depend on nearby bytes only, so an inserted
word moves no other bound, and a passage that stands in two texts is cut alike in both from its first bound on.

A piece between two bounds is often a common phrase, so a chunk runs from a bound to the first bound that has
``min_words`` words before it: of variable length, a least size, and one from every bound (chunks overlap). In the code these
are the windows. An equal one stands contiguously in one other text, and each removed word is in such a chunk or beside it.

1. Each text gives its window digests with their places (digest, document, place): one narrow row each, at most one a
   chunk.
2. For each digest the least document is its owner; digests of one document alone go. This is an aggregate with
   partial sums, so a window in a third of all texts is one row a task.
3. The other documents' digests come back by a join on the digest (adaptive execution splits a frequent one), and
   are gathered by document, which is bounded by the text's own length.
4. For the first and the last window of each run the owner gives the text around it, up to where a longer passage would
   have had another window. An owner is asked once for a window, so what it is asked is bounded by its own text.
5. Each text is cut again. Runs are extended over the equal words on both sides, and what they cover goes, with the
   white space after it. The owner keeps the first copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import fresh, sliced, stage

#: Least words of a chunk, so of what is removed; in text without spaces, this many times the bytes.
MIN_WORDS, BYTES_A_WORD = 12, 20
#: Bounds for the 16-bit hash: one word in six, one character in 256.
AT_WORD, INSIDE = (1 << 16) // 6, 1 << 8

_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

FOUND = T.StructType([
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("owners", T.ArrayType(T.LongType())),
])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Sum of the gear values of the last eight bytes, each shifted by its distance, modulo 2 ** 16."""
    h = _GEAR[data]
    for apart in (1, 2, 4):
        wider = h.copy()
        wider[apart:] += h[:-apart] << np.uint16(apart)
        h = wider
    return h


class Cut(NamedTuple):
    starts: np.ndarray  # of each chunk, and the end of the text
    words: np.ndarray  # start of each word
    begins: np.ndarray  # of each window: a bound with a bound at least ``min_words`` words after it
    ends: np.ndarray
    digests: np.ndarray  # of the windows


def chunks(text: bytes, min_words: int = MIN_WORDS) -> Cut:
    data = np.frombuffer(text, np.uint8)
    none = np.empty(0, np.int64)
    if not len(data):
        return Cut(np.zeros(1, np.int64), none, none, none, none)
    space = _SPACE[data]
    word = ~space
    word[1:] &= space[:-1]
    h = gear_hash(data)[:-1]
    cut = np.flatnonzero((word[1:] & (h < AT_WORD)) | (~space[1:] & (data[1:] & 0xC0 != 0x80) & (h < INSIDE))) + 1
    starts, words = np.concatenate([[0], cut, [len(data)]]), np.flatnonzero(word)
    if not len(words):
        return Cut(starts, words, none, none, none)
    begins = np.maximum(starts[:-1], words[0])
    stops = np.concatenate([np.flatnonzero(~space[:-1] & space[1:]) + 1, [] if space[-1] else [len(data)]]).astype(np.int64)
    last = np.searchsorted(words, begins, "right") - 2 + min_words
    enough = np.where(last < len(stops), stops[np.minimum(last, len(stops) - 1)], len(data) + 1)
    enough = np.minimum(enough, begins + min_words * BYTES_A_WORD)
    begins, enough = begins[enough <= len(data)], enough[enough <= len(data)]
    bounds = starts[np.searchsorted(starts, enough)]  # the first one with that much before it
    # without the white space before the bound
    ends = np.where(space[bounds - 1], stops[np.maximum(np.searchsorted(stops, bounds, "right") - 1, 0)], bounds)
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(text[a:b]) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
    return Cut(starts, words, begins, ends, digests.view(np.int64))


def repeated_windows(cut: Cut, elsewhere: np.ndarray) -> np.ndarray:
    """Which windows stand elsewhere, or earlier in the text without overlap."""
    again = np.isin(cut.digests, elsewhere)
    _, first, which = np.unique(cut.digests, return_index=True, return_inverse=True)
    return again | (cut.begins >= cut.ends[first][which])


def around(text: bytes, cut: Cut, i: int) -> tuple[bytes, bytes]:
    """The text before and after a window, as far as a passage can go that has no other whole window on that side."""
    begin, end = int(cut.begins[i]), int(cut.ends[i])
    start = max(0, int(cut.begins[i - 1]) - 8) if i else 0
    # a bound depends on the eight bytes before it, so a nearer one may be missing in the other text
    j = int(np.searchsorted(cut.begins, begin + 8))
    return text[start:begin], text[end : int(cut.ends[j]) if j < len(cut.ends) else len(text)]


def alike(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def extended(text: bytes, begin: int, end: int, before: bytes, after: bytes) -> tuple[int, int]:
    """The piece with the whole words on both sides that equal those around it; characters of a long unbroken word."""
    low = a = begin - alike(text[max(0, begin - len(before)) : begin][::-1], before[::-1])
    while a < begin and a - low < BYTES_A_WORD and (_SPACE[text[a]] or (a and not _SPACE[text[a - 1]])):
        a += 1
    if a - low == BYTES_A_WORD:
        a = low
        while text[a] & 0xC0 == 0x80:
            a += 1
    high = b = end + alike(text[end : end + len(after)], after)
    if b < len(text):
        while b > end and high - b < BYTES_A_WORD and not (_SPACE[text[b]] and not _SPACE[text[b - 1]]):
            b -= 1
        if high - b == BYTES_A_WORD:
            b = high
            while text[b] & 0xC0 == 0x80:
                b -= 1
    return a, b


def pieces(text: bytes, cut: Cut, again: np.ndarray, contexts: dict[int, list[tuple[bytes, bytes]]]) -> list[tuple[int, int]]:
    """[begin, end) of each repeated window, extended by the contexts of its digest and by the first copy in the text."""
    out = []
    _, first, which = np.unique(cut.digests, return_index=True, return_inverse=True)
    begins, ends, digests, source = cut.begins.tolist(), cut.ends.tolist(), cut.digests.tolist(), first[which].tolist()
    last = len(begins) - 1
    for i in np.flatnonzero(again).tolist():
        a, b = begins[i], ends[i]
        low, high = a, b
        for before, after in contexts.get(digests[i], ()):
            x, y = extended(text, a, b, before, after)
            low, high = min(low, x), max(high, y)
        f = source[i]
        room = a - ends[f]  # the first copy stays whole
        edge = i == 0 or i == last or not again[i - 1] or not again[i + 1] or ends[i - 1] < a or begins[i + 1] > b
        if f < i and room >= 0 and edge:
            before, after = around(text, cut, f)
            x, _ = extended(text, a, b, before[len(before) - min(room, len(before)) :], b"")
            _, y = extended(text, a, b, b"", after[: x - ends[f]])
            low, high = min(low, x), max(high, y)
        out.append((low, high))
    return sorted(out)


def covered(text: bytes, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pieces, in order of their begins, with the white space after each; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        while b < len(text) and _SPACE[text[b]]:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def inside(places: np.ndarray, spans: list[tuple[int, int]]) -> int:
    return sum(int(b - a) for a, b in np.searchsorted(places, spans)) if spans else 0


def digests_of(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """digest, doc, place of each window; places of windows that touch follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [chunks(t or b"", min_words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            owner = np.repeat(batch.column(0).to_numpy(), [len(c.digests) for c in found])
            # one more where a window does not touch the one before
            places = [np.arange(len(c.begins)) + np.concatenate([[0], np.cumsum(c.begins[1:] > c.ends[:-1])])[: len(c.begins)] for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c.digests for c in found])), pa.array(owner), pa.array(np.concatenate(places).astype(np.int64))], names=["digest", "doc", "place"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).filter("doc IS NOT NULL")
    return source.mapInArrow(run, "digest long, doc long, place long")


def edges_of(lists: DataFrame, key: str, known: str) -> DataFrame:
    """doc, digest, owner of the first and the last window of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc, windows in zip(*(c.to_pylist() for c in batch.columns)):
                at = {w["place"] for w in windows}
                rows += {(doc, w["digest"], w["owner"]) for w in windows if w["place"] - 1 not in at or w["place"] + 1 not in at}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc", "digest", "owner"])

    return lists.select(key, known).mapInArrow(run, "doc long, digest long, owner long")


def answers_of(rows: DataFrame, place: int, min_words: int) -> DataFrame:
    """digest, before, after for each window that the last column of ``rows`` asks for and the text has: one a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, asked in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if asked and text:
                    cut = chunks(text, min_words)
                    # the first copy in the text, which is the one that stays
                    known, first = np.unique(cut.digests, return_index=True)
                    for i in first[np.isin(known, np.array(asked, np.int64))].tolist():
                        out.append((int(cut.digests[i]), *around(text, cut, i)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["digest", "before", "after"])

    return rows.mapInArrow(run, "digest long, before binary, after binary")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", name: str = "chunks") -> DataFrame:
    """The rows with repeated passages cut from the text, and a struct column ``name`` (longer if taken): chunks,
    chunks and words that begin in what is removed, removed [start, end) byte spans, and the documents that keep the passages.

    Null text stays null, an empty one empty. Rows without an id lose only what they repeat themselves. Rows that
    repeat an id are one document, so they take nothing from one another. Empty table: no rows.
    """
    name = fresh(docs, name)
    key, known, near = fresh(docs, "_doc"), fresh(docs, "_known"), fresh(docs, "_near")
    digests = digests_of(docs, id_col, text_col, min_words)
    owners = digests.groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last").select("digest", "owner")
    repeated = digests.join(owners, "digest").filter("doc > owner")
    lists = stage(repeated.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("digest", "owner", "place")).alias(known)), "lists")
    place = docs.columns.index(text_col)
    keyed = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumn(key, F.col(id_col).cast("long"))
    edges = edges_of(lists, key, known)
    asks = edges.groupBy(F.col("owner").alias(key)).agg(F.collect_set("digest").alias(known))
    # a left join as below, so the texts are dealt out once for both
    answers = answers_of(keyed.join(asks, key, "left").select(*docs.columns, known), place, min_words).distinct()
    contexts = edges.join(answers, "digest").groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("digest", "before", "after")).alias(near))
    rows = keyed.join(lists, key, "left").join(contexts, key, "left").select(*docs.columns, known, near)
    out = T.StructType([*(rows.schema[c] for c in docs.columns), T.StructField(name, FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, found = [], []
            for text, pairs, sides in zip(batch.column(place).cast(pa.binary()).to_pylist(), *(batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))):
                cut = chunks(text or b"", min_words)
                keepers = {p["digest"]: p["owner"] for p in pairs or []}
                again = repeated_windows(cut, np.fromiter(keepers, np.int64, len(keepers)))
                contexts = {}
                for c in sides or []:
                    contexts.setdefault(c["digest"], []).append((c["before"], c["after"]))
                spans = covered(text or b"", pieces(text or b"", cut, again, contexts))
                if spans:
                    kept = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)])
                    text = b"".join(text[a:b] for a, b in kept)
                texts.append(text)
                found.append({
                    "n_chunks": len(cut.starts) - 1, "n_removed": inside(cut.starts[:-1], spans),
                    "removed_words": inside(cut.words, spans), "spans": spans,
                    "owners": sorted({keepers[d] for d in cut.digests[again].tolist() if d in keepers}),
                })
            kind = pa.struct([("n_chunks", pa.int64()), ("n_removed", pa.int64()), ("removed_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("owners", pa.list_(pa.int64()))])
            columns = [*batch.columns[:-2], pa.array(found, kind)]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, out)
