"""Packing of token sequences into windows of a fixed length by best-fit decreasing.

Documents are encoded, an end id is appended, and what is longer than a window is first cut into full windows
and a rest. The pieces are dealt by a hash of their document into groups of bounded size; each group is sorted by
descending length in Spark and streamed through a segment tree over the remaining capacities 0..window, which finds
the tightest open window in log2(window) steps. A task holds the open windows of one group only, and the ids pass
through it, so memory does not grow with the table.

A group of 8,192 documents wastes at most its last few windows; best-fit decreasing over the whole table would gain
less than 0.1 % and would need one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import sliced
from tidegrid.llm.units import is_wide, library_encoder

WINDOW = 4096
#: Documents of a group on average; more documents make more groups, not larger ones.
GROUP = 8192

#: Low bits of a sequence id: the window within its group; the group is above them.
_WITHIN = 24

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("grp", T.LongType()),
    ]
)
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


class TightestWindow:
    """Open windows by remaining capacity, found through a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, name) of a window with the least capacity of ``need`` or more; it is no longer open."""
        at, count = need + self.leaves, self.count
        while not count[at]:
            while at & 1:  # a right child: nothing of its parent's range is left above it
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        at, count = capacity + self.leaves, self.count
        while at:
            count[at] += by
            at >>= 1


class BestFit:
    """Places lengths one by one; in descending order this is best-fit decreasing."""

    def __init__(self, window: int):
        self.window, self.tree, self.made = window, TightestWindow(window), 0

    def place(self, length: int) -> tuple[int, int]:
        """(window number, offset in it)."""
        found = self.tree.take(length)
        if found is None:
            found, self.made = (self.window, self.made), self.made + 1
        capacity, name = found
        if capacity > length:
            self.tree.add(capacity - length, name)
        return name, self.window - capacity


def pieces(docs: DataFrame, vocabulary: str, kind: str, end_id: int, window: int, groups: int, id_col: str, text_col: str) -> DataFrame:
    """Full windows and the rest of each document's ids, with the group that packs them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_encoder(vocabulary, kind), np.asarray([end_id], dtype="<u4").tobytes()
        narrow = not is_wide(vocabulary, end_id)  # 16-bit ids in the shuffle
        for batch in sliced(batches):
            rows: list[tuple] = []
            docs, texts, homes = (c.to_pylist() for c in batch.columns)
            for doc, ids, group in zip(docs, encode([t or "" for t in texts]), homes):
                ids += end
                total, step = len(ids) // 4, 4 * window
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    size = len(part)
                    part = np.frombuffer(part, "<u4").astype("<u2").tobytes() if narrow else part
                    # the full windows of one very long text are spread over the groups
                    rows.append((doc, at // 4, size // 4, total, part, (group + at // step) % groups if size == step else group))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(columns)], names=PIECES.names
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        # with the row's place, so that repeated rows and rows without id and text spread
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), F.lit(groups)).alias("grp"),
    )
    return source.mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 2, window: int = WINDOW, group: int = GROUP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece: document, its ids (little-endian unsigned 32-bit), sequence and offset there.

    Null or empty text: the end id alone. Null ids: kept as null. Repeated rows: each is packed. Of the table
    only ``id_col`` and ``text_col`` are read, so further columns cannot clash. Empty table: no rows.
    """
    groups = max(1, math.ceil(docs.count() / group))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit, narrow = None, None, not is_wide(vocabulary, end_id)
        for batch in batches:
            ids = batch.column("ids")
            if narrow:
                ids = pa.array([np.frombuffer(i, "<u2").astype("<u4").tobytes() for i in ids.to_pylist()], pa.binary())
            names, offsets = [], []
            for group, length in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist()):
                if group != now:
                    now, fit = group, BestFit(window)
                name, offset = fit.place(length)
                names.append((group << _WITHIN) + name)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")), ids, pa.array(names, pa.int64()), pa.array(offsets, pa.int64())],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"],
            )

    return (
        pieces(docs, vocabulary, kind, end_id, window, groups, id_col, text_col)
        .repartition("grp")
        .sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", F.xxhash64("ids"))
        .mapInArrow(place, PACKED)
    )


def padding(length: int, window: int = WINDOW) -> int:
    """Padding ids of a sequence that holds ``length``: up to the window, none at a power of two."""
    return 0 if length and not length & (length - 1) else window - length
