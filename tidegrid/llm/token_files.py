"""Token files: ids of all documents in ascending document order, with Elias-Fano coded document boundaries.

The table is range-partitioned by document id, each partition is encoded in order and streamed into one file, and
the list of files (one row a partition) gives every file's base offset. A file is

    8 bytes   magic
    ids       16 bits each, or 32 if the vocabulary needs them
    doc ids   64 bits each, in order; a bitmap of null ids
    low bits, high bits, samples of the Elias-Fano code of the document ends
    footer    JSON: counts and section sizes;  4 bytes: its length;  8 bytes magic

so the offset of a document comes from a select on about 2 + log2(ids per document) bits each. Files are written
under a name of their own and moved into place when complete: a task that is run again replaces its file by an
equal one, and a reader never sees half a file.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import new_folder, sliced
from tidegrid.llm.elias_fano import EliasFano
from tidegrid.llm.units import is_wide, library_encoder

MAGIC = b"TGTOK\x00\x01\n"
FILES = "shard int, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids binary"
#: Ids that a reader holds at once.
BLOCK = 1 << 20


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenWriter:
    def __init__(self, path: str, wide: bool):
        self.store, self.path = file_system(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.kind = self.store.open_output_stream(self.part), np.dtype("<u4" if wide else "<u2")
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.ends: list[int] = []
        self.total = 0
        self.out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        values = np.frombuffer(ids, "<u4")
        if self.kind.itemsize == 2 and values.max(initial=0) >> 16:
            raise ValueError("an id does not fit the file's 16 bits")
        self.out.write(values.astype(self.kind).tobytes())
        self.total += len(values)
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.ends.append(self.total)

    def close(self) -> None:
        code = EliasFano.build(np.asarray(self.ends, np.uint64))
        sections = [
            np.asarray(self.docs, "<i8").tobytes(), np.packbits(np.asarray(self.nulls, bool)).tobytes(),
            code.low.tobytes(), code.high.tobytes(), code.samples.tobytes(),
        ]
        footer = json.dumps({"width": self.kind.itemsize, "n_ids": self.total, "n_docs": code.n, "universe": code.universe, "sizes": [len(s) for s in sections]}).encode()
        for part in [*sections, footer, len(footer).to_bytes(4, "little"), MAGIC]:
            self.out.write(part)
        self.out.close()
        self.store.move(self.part, self.path)


class TokenReader:
    """Random access: ``reader[k]`` are the ids of the k-th document of the file."""

    def __init__(self, path: str):
        store, place = file_system(path)
        self.file = store.open_input_file(place)
        size, tail = self.file.size(), len(MAGIC) + 4
        end = self.file.read_at(tail, size - tail)
        if end[4:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a complete token file")
        length = int.from_bytes(end[:4], "little")
        self.footer = json.loads(self.file.read_at(length, size - tail - length))
        at, parts = size - tail - length - sum(self.footer["sizes"]), []
        for n in self.footer["sizes"]:
            parts.append(self.file.read_at(n, at))
            at += n
        n, self.kind = self.footer["n_docs"], np.dtype(f"<u{self.footer['width']}")
        self.docs = np.frombuffer(parts[0], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(parts[1], np.uint8))[:n].astype(bool)
        self.ends = EliasFano(n, self.footer["universe"], np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], "<u8"), np.frombuffer(parts[4], "<u4"))

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, len(MAGIC) + start * width), self.kind)

    def __len__(self) -> int:
        return self.ends.n

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids(*self.span(k))

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document, start in the file, ids) in order; the ids are read in large blocks."""
        ends = self.ends.all()
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
            block = self.ids(int(starts[first]), int(ends[last - 1]))
            for k in range(first, last):
                yield (None if self.nulls[k] else int(self.docs[k])), int(starts[k]), block[starts[k] - starts[first] : ends[k] - starts[first]]
            first = last


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, kind: str = "byte", end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> list[tuple[str, int, int, int]]:
    """Write the files; (path, first id's offset, documents, ids) of each in order: one short row a partition.

    Null or empty text: the end id alone. Null document ids come first. Repeated ids follow one another in the order
    of a hash of their text. Other columns are not read. Empty table: no files. Ids take 16 bits where the vocabulary's
    largest one fits, else 32.
    """
    wide = is_wide(vocabulary, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        encode, end = library_encoder(vocabulary, kind), np.asarray([end_id], "<u4").tobytes()
        path = f"{folder}/tokens-{shard:06d}"
        for batch in sliced(batches):
            writer = writer or TokenWriter(path, wide)
            docs, texts = (c.to_pylist() for c in batch.columns)
            for doc, ids in zip(docs, encode([t or "" for t in texts])):
                writer.add(doc, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = (
        ordered.repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(write, FILES)
        .collect()
    )
    files.sort(key=lambda f: f.shard)
    bases = itertools.accumulate((f.n_ids for f in files), initial=0)
    return [(f.path, base, f.n_docs, f.n_ids) for f, base in zip(files, bases)]


def read_tokens(spark, files: list[tuple[str, int, int, int]]) -> DataFrame:
    """Each document's offset among all ids, and its ids (little-endian unsigned 32-bit), from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                documents = iter(TokenReader(path))
                while rows := list(itertools.islice(documents, 512)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _, _ in rows], pa.int64()),
                            pa.array([base + s for _, s, _ in rows], pa.int64()),
                            pa.array([len(i) for _, _, i in rows], pa.int64()),
                            pa.array([i.astype("<u4").tobytes() for _, _, i in rows], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    listed = spark.createDataFrame([(p, b) for p, b, _, _ in files], "path string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, READ)


def token_table(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the files on the session's shared storage and read them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, folder, vocabulary, **options))
