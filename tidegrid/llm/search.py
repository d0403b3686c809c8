"""Ranked lexical search by Block-Max MaxScore over compressed posting lists.

Documents are read once: a task cuts its rows into shards of at most ``SHARD`` documents and writes each as one index
row with a posting list for every term that some item of the block of items asks for. A list's postings stand in blocks of
``BLOCK``, gaps and counts in one byte each where they fit. A block's maximum is kept as its largest count and the
least lengths among its counts of 1, of 2 and of more: the weight of a posting grows with the count and falls
with the document's length, so these bound every posting of the block whatever the corpus averages turn out to be.

The averages (documents, terms) and document frequencies are sums over all shards. Then every shard is searched for
every item. The lists' bounds, in ascending order, split an item's lists: a document that only the first ones hold
cannot reach the item's k-th best score so far. The other, essential ones are added up. Then the non-essential lists
follow from the largest bound down: a candidate whose sum, block maximum and the bounds still to come stay below that score
goes before its block is decompressed. A task carries the k best of each item from shard to shard; the tasks' heaps are
merged by item, at most k rows of each.

Items come in blocks of bounded size, and a block's terms go to the tasks; everything else stays in the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import sliced, stage

K = 50
#: Documents, and terms, of a shard; postings of a block; items, and characters, of a block of items.
SHARD, SHARD_TERMS, BLOCK, ITEMS, ITEM_CHARS = 4096, 1 << 22, 128, 4096, 1 << 22

#: Bytes of a text as bytes of its terms: ASCII letters lowered, other ASCII but digits to spaces.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256)
)
_NONE = np.iinfo(np.int64).max

#: Arrays of a shard's row: per document, per list, per block.
ARRAYS = {
    "ids": "<i8", "ranked": "?", "lengths": "<i8",
    "terms": "<u4", "frequency": "<u4", "first_block": "<u4",
    "first": "<u2", "last": "<u2", "size": "<u2", "most": "<u4", "least_1": "<i8", "least_2": "<i8", "least_more": "<i8", "wide": "u1", "at": "<u8",
}
SCHEMA = "n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in ARRAYS) + ", postings binary"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def shard_row(ids: list[int | None], lengths: list[int], docs: np.ndarray, words: np.ndarray) -> tuple:
    """One shard's row: ``docs`` and ``words`` are the places of wanted terms, one entry an occurrence."""
    n = np.asarray(lengths, np.int64)
    pairs, tf = np.unique(words * len(ids) + docs, return_counts=True)
    term, doc = pairs // max(1, len(ids)), pairs % max(1, len(ids))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    within = np.arange(len(term)) - np.repeat(starts, np.diff(starts, append=len(term)))
    blocks = np.flatnonzero(within % BLOCK == 0)
    ends = np.append(blocks, len(term))[1:].astype(np.int64)
    gaps = np.diff(doc, prepend=0)
    gaps[blocks] = 0
    at = lambda f, x: f.reduceat(x, blocks) if len(blocks) else np.zeros(0, np.int64)
    least = lambda which: at(np.minimum, np.where(which, n[doc], _NONE))
    most = at(np.maximum, tf)
    wide = (at(np.maximum, gaps) > 255).astype(np.uint8) + 2 * (most > 255)
    parts = []
    for a, b, w in zip(blocks.tolist(), ends.tolist(), wide.tolist()):
        parts.append(gaps[a:b].astype("<u2" if w & 1 else "u1").tobytes() + tf[a:b].astype("<u4" if w & 2 else "u1").tobytes())
    arrays = {
        "ids": [i or 0 for i in ids], "ranked": [i is not None for i in ids], "lengths": n,
        "terms": term[starts], "frequency": np.diff(starts, append=len(term)), "first_block": np.searchsorted(blocks, starts),
        "first": doc[blocks], "last": doc[ends - 1], "size": ends - blocks, "most": most,
        "least_1": least(tf == 1), "least_2": least(tf == 2), "least_more": least(tf > 2), "wide": wide,
        "at": np.cumsum([0, *map(len, parts)])[:-1],
    }
    return len(ids), int(n.sum()), *(np.asarray(arrays[c]).astype(kind).tobytes() for c, kind in ARRAYS.items()), b"".join(parts)


def build(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str, shard: int) -> DataFrame:
    """Index rows of the documents with at least one term; ``vocabulary`` numbers the wanted terms from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split()[0] for c in SCHEMA.split(",")]
        ids, lengths, places, wanted, total = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            row = shard_row(ids, lengths, np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *wanted]))
            for held in (ids, lengths, places, wanted):
                held.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(row)], names=names)

        for batch in sliced(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = terms(text) if text else []
                if not found:
                    continue
                held = np.fromiter(filter(None, map(vocabulary.get, found)), np.int64)
                places.append(np.full(len(held), len(ids)))
                wanted.append(held)
                ids.append(doc)
                lengths.append(len(found))
                total += len(held)
                if len(ids) >= shard or total >= SHARD_TERMS:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


class Weigher:
    """A posting's weight before its term's: grows with the count, falls with the length."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 50 + 50 * lengths * self.n_docs // max(1, self.n_terms)

    def __call__(self, tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return 1000000000 * tf // (1000 * tf + 20 * norms)

    def most(self, tf: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The same for a least length, 0 where there is none."""
        none = least == _NONE
        return np.where(none, 0, self(tf, self.norms(np.where(none, 0, least))))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """One list of a shard: block bounds at hand, blocks decompressed when asked for."""

    def __init__(self, shard: Shard, blocks: slice):
        part = lambda c: shard.arrays[c][blocks]
        self.shard, self.first, self.last, self.size = shard, part("first"), part("last"), part("size").astype(np.int64)
        self.wide, self.at = part("wide").tolist(), part("at").tolist()
        self.bounds = shard.block_bounds[blocks]
        self.bound = int(self.bounds.max())
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        # a closed block reads as its last document: the whole stays in order
        self.docs, self.weights = np.repeat(self.last.astype(np.int64), self.size), np.zeros(int(self.start[-1]), np.int64)
        self.closed = np.ones(len(self.size), bool)

    def open(self, blocks: np.ndarray) -> None:
        for b in blocks[self.closed[blocks]].tolist():
            n, at, wide, raw = int(self.size[b]), self.at[b], self.wide[b], self.shard.postings
            gaps = np.frombuffer(raw, "<u2" if wide & 1 else "u1", n, at)
            tf = np.frombuffer(raw, "<u4" if wide & 2 else "u1", n, at + gaps.nbytes).astype(np.int64)
            here = slice(self.start[b], self.start[b + 1])
            self.docs[here] = docs = int(self.first[b]) + np.cumsum(gaps, dtype=np.int64)
            self.weights[here] = self.shard.weigher(tf, self.shard.norms[docs])
            self.closed[b] = False
            self.shard.opened += 1

    def block_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that may hold each document, and its bound (0 where no block may)."""
        block = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        inside = (self.first[block] <= docs) & (docs <= self.last[block])
        return block, np.where(inside, self.bounds[block], 0)

    def weights_of(self, docs: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[place] == docs, self.weights[place], 0)


class Shard:
    """A shard's row with the corpus averages."""

    def __init__(self, row: dict, weigher: Weigher):
        self.arrays = {c: np.frombuffer(row[c], kind) for c, kind in ARRAYS.items()}
        self.postings, self.weigher, self.opened = row["postings"], weigher, 0
        a = self.arrays
        self.norms = weigher.norms(a["lengths"])
        most = a["most"].astype(np.int64)
        self.block_bounds = np.maximum(
            np.maximum(weigher.most(np.ones_like(most), a["least_1"]), weigher.most(np.full_like(most, 2), a["least_2"])),
            weigher.most(most, a["least_more"]),
        )
        self.place = {t: k for k, t in enumerate(a["terms"].tolist())}
        self.lists: dict[int, Postings] = {}

    def list_of(self, term: int) -> Postings | None:
        if term not in self.place:
            return None
        if term not in self.lists:
            k, firsts = self.place[term], self.arrays["first_block"]
            end = firsts[k + 1] if k + 1 < len(firsts) else len(self.arrays["last"])
            self.lists[term] = Postings(self, slice(int(firsts[k]), int(end)))
        return self.lists[term]

    def search(self, wanted: list[tuple[int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, document ids) of all documents that may have a place among the best: score ``floor`` (1 at least) or
        more; ``wanted`` are the item's (term, weight)."""
        lists = [(w * p.bound, w, p) for t, w in wanted if w > 0 and (p := self.list_of(t)) is not None]
        lists.sort(key=lambda x: x[0])
        floor, below, split = max(floor, 1), [0], 0
        for bound, _, _ in lists:
            below.append(below[-1] + bound)
        while split < len(lists) and below[split + 1] < floor:
            split += 1
        score = np.zeros(len(self.norms), np.int64)
        for _, w, p in lists[split:]:
            p.open(np.arange(len(p.size)))
            score[p.docs] += w * p.weights
        docs = np.flatnonzero((score > 0) & self.arrays["ranked"])
        docs = docs[score[docs] + below[split] >= floor]
        for k in range(split - 1, -1, -1):
            if not len(docs):
                break
            _, w, p = lists[k]
            block, most = p.block_of(docs)
            stays = score[docs] + w * most + below[k] >= floor
            docs, block, most = docs[stays], block[stays], most[stays]
            p.open(np.unique(block[most > 0]))
            score[docs] += w * np.where(most > 0, p.weights_of(docs), 0)
        docs = docs[score[docs] >= floor]
        return score[docs], self.arrays["ids"][docs]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _block_results(items: list[tuple[int, str]], docs: DataFrame, k: int, id_col: str, text_col: str, shard: int) -> DataFrame:
    asked = [(item, sorted(set(terms(text or "")))) for item, text in items]
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, ts in asked for t in ts}), 1)}
    index = stage(build(docs, vocabulary, id_col, text_col, shard), "index")
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for t, n in zip(batch.column("terms").to_pylist(), batch.column("frequency").to_pylist()):
                sums[np.frombuffer(t, "<u4")] += np.frombuffer(n, "<u4")
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["term", "df"])

    counted = index.select("terms", "frequency").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r.term: r.df for r in counted.collect()}  # as many as the block of items has terms
    n_docs, n_terms = total.docs or 0, total.terms or 0
    wanted = [(item, [(n, weight(n_docs, df[n])) for n in map(vocabulary.get, ts) if n in df]) for item, ts in asked]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(n_docs, n_terms)
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(wanted)
        for batch in batches:
            for row in batch.to_pylist():
                here = Shard(row, weigher)
                for q, (_, ts) in enumerate(wanted):
                    scores, ids = best[q]
                    more, found = here.search(ts, int(scores[-1]) if len(scores) >= k else 0)
                    if len(more):
                        best[q] = best_of(np.concatenate([scores, more]), np.concatenate([ids, found]), k)
        items = [pa.array([item] * len(b[0]), pa.int64()) for (item, _), b in zip(wanted, best)]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays(items) if items else pa.array([], pa.int64()), pa.array(np.concatenate([none, *(b[1] for b in best)])), pa.array(np.concatenate([none, *(b[0] for b in best)]))],
            names=["item_id", "doc_id", "score"],
        )

    found = index.mapInArrow(search, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(
    items: DataFrame, docs: DataFrame, k: int = K, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text",
    shard: int = SHARD, block: int = ITEMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, scores above 0, ties by ascending id.

    Null or termless text of a document: not counted and not ranked; of an item: no rows. Rows without a document id count
    in the statistics but are not ranked; repeated ids: every row is a document. Texts of items that share an id (null is
    one too) are one item. Other columns are not read. Empty table on either side: no rows.
    """
    item = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    item = item.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    parts, held, size = [], [], 0
    for row in item.orderBy("item_id").toLocalIterator():
        if held and (len(held) >= block or size + len(row.text) > ITEM_CHARS):
            parts.append(stage(_block_results(held, docs, k, id_col, text_col, shard), "found"))
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    out = _block_results(held, docs, k, id_col, text_col, shard)
    for part in parts:
        out = out.unionByName(part)
    return out
