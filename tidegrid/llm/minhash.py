"""Near duplicates by b-bit MinHash: bands propose, bit counts estimate, full shingle sets confirm.

1. One pass over the texts: shingle set, its digest, 256 minima; 32 bands of 4 minima as bucket keys, and the low 4
   bits of every minimum as 4 bit planes (128 bytes a document).
2. Documents with equal sets are one class, represented by its least id, however many copies there are.
3. Classes that share a bucket are compared by XOR and bit counts of their planes. Agreement by chance (1 in 16) is
   taken out of the estimate, and pairs under the threshold less 4 standard errors go (3e-5 of those at it). Of a bucket only a spanning
   forest of the best estimates is passed on (one pair fewer than classes, never all pairs). A bucket of more than
   2,048 classes is dealt over blocks, and each pair of blocks is one group.
4. Pairs are confirmed on the full sets of both texts, which are fetched by joins on the id.
5. In buckets whose classes are still in several components, all pairs between components over the estimate's bound
   are confirmed in the group itself, which has the texts: a forest edge that failed hides no other link, and only
   links leave the task.
6. Components by star steps.

At a similarity of 0.75 a pair shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import sliced, stage
from tidegrid.llm.graph import connected_components
from tidegrid.llm.shingles import WORDS, shingle_set

MINIMA, BITS = 256, 4
BANDS, ROWS = 32, 4
#: Least similarity of a link, in percent.
PERCENT = 75
#: Standard errors by which an estimate may fall short.
SLACK = 4.0
#: Classes of a bucket that one group compares.
BLOCK = 2048
#: Shingles that a group keeps at once.
SETS = 1 << 22

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """32-bit minima of the set under each hash function."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[at : at + 256, None] ^ _B) * _A).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band; the band's number is mixed in through its own multipliers."""
    x = (m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _C).sum(1, dtype=np.uint64)
    x ^= x >> np.uint64(31)
    return (x * _C[:, 0]).view(np.int64)


def bit_planes(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, plane by plane, in 64-bit words."""
    flags = (m[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(flags.astype(np.uint8), axis=1).view(np.int64).ravel()


def similarity(equal: np.ndarray | float) -> np.ndarray | float:
    """Estimate from the share of minima whose low bits are equal, corrected for chance."""
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_equal(percent: int = PERCENT, slack: float = SLACK) -> int:
    """Equal minima that a pair at the threshold has, less ``slack`` standard errors."""
    chance = 2.0**-BITS
    p = percent / 100 * (1 - chance) + chance
    return int(MINIMA * p - slack * (MINIMA * p * (1 - p)) ** 0.5)


def equal_minima(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Equal minima of each row of ``planes`` with ``other``, by bit counts."""
    differ = (planes ^ other).view(np.uint64).reshape(-1, BITS, MINIMA // 64)
    return MINIMA - np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(1, dtype=np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands, planes for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, digests, bands, planes = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text)
                m = minima(s)
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(m))
                planes.append(bit_planes(m))
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(x[0]), pa.int32()), pa.array(np.concatenate(x))) for x in (bands, planes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), *arrays], names=["doc_id", "n_shingles", "digest", "bands", "planes"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, planes array<long>")


def _forest(ids: np.ndarray, planes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the most equal pairs with ``least`` equal minima, growing one tree after another."""
    n, out = len(ids), []
    best, parent, left = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        equal = equal_minima(planes, planes[at])
        nearer = left & (equal > best)
        best[nearer], parent[nearer] = equal[nearer], at
        at = int(np.where(left, best, -2).argmax())
        if best[at] >= least:
            out.append((int(ids[parent[at]]), int(ids[at])))
    return out


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both) > 0


def _links_across(ids: np.ndarray, planes: np.ndarray, parts: np.ndarray, texts: list[bytes], least: int, percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed links between different parts; a link found joins its parts, so it saves the pairs between them."""
    sets: dict[int, np.ndarray] = {}

    def shingles(k: int) -> np.ndarray:
        if k not in sets:
            if sum(map(len, sets.values())) > SETS:
                sets.clear()
            sets[k] = shingle_set(texts[k])
        return sets[k]

    parts = parts.copy()
    for k in range(len(ids) - 1):
        near = np.flatnonzero((parts[k + 1 :] != parts[k]) & (equal_minima(planes[k + 1 :], planes[k]) >= least)) + k + 1
        for other in near.tolist():
            if parts[other] != parts[k] and _similar(shingles(k), shingles(other), percent):
                parts[parts == parts[other]] = parts[k]
                yield int(ids[k]), int(ids[other])


def _in_groups(members: DataFrame, pairs_of) -> DataFrame:
    """Distinct pairs (a < b) that ``pairs_of`` finds in each group of ``members`` (bucket, i, j, rep, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches):
            rows = pa.Table.from_batches(group)
            ids = rows.column("rep").to_numpy()
            planes = rows.column("planes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            for a, b in pairs_of(ids, planes, rows):
                out.append((min(a, b), max(a, b)))
                if len(out) == 1 << 16:
                    yield _pair_batch(out)
                    out = []
        if out:
            yield _pair_batch(out)

    keys = ["bucket", "i", "j"]
    dealt = members.repartition(*keys).sortWithinPartitions(*keys, "rep")
    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _propose(members: DataFrame, least: int) -> DataFrame:
    """A spanning forest of each group."""

    def pairs_of(ids: np.ndarray, planes: np.ndarray, rows: pa.Table) -> list[tuple[int, int]]:
        if len(ids) == 2:
            return [(int(ids[0]), int(ids[1]))] if equal_minima(planes[:1], planes[1])[0] >= least else []
        return _forest(ids, planes, least)

    return _in_groups(members, pairs_of)


def _remaining(members: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between different parts of a group; the texts are there, so pairs are confirmed where they are found."""

    def pairs_of(ids: np.ndarray, planes: np.ndarray, rows: pa.Table) -> Iterator[tuple[int, int]]:
        return _links_across(ids, planes, rows.column("part").to_numpy(), rows.column("text").cast(pa.binary()).to_pylist(), least, percent)

    return _in_groups(members, pairs_of)


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.unique(np.asarray(pairs, np.int64).reshape(-1, 2), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal bucket, i and j, also over the borders of batches."""
    now, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            key = tuple(keys[:, start].tolist())
            if held and key != now:
                yield held
                held = []
            now = key
            held.append(batch.slice(start, end - start))
    if held:
        yield held


def _members(classes: DataFrame) -> DataFrame:
    """Classes of each bucket with several, dealt over blocks where a bucket is large."""
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: (x != own) | (blocks == 1))
    shared = buckets.join(several, "bucket").select("bucket", "rep", own.alias("own"), F.explode(others).alias("other"))
    return shared.select("bucket", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are as similar as ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, shingle_set(None))
        for batch in sliced(batches):
            out = []
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))]
            for a, b, x, y in zip(*columns):
                if y != last[0] or y is None:
                    last = (y, shingle_set(y))
                if _similar(shingle_set(x), last[1], percent):
                    out.append((a, b))
            if out:
                yield _pair_batch(out)

    x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least id reachable over links), kept.

    Null or blank texts have no shingles and no links: kept. Rows without an id cannot be linked: component_id is
    null, kept is true. Rows that repeat an id are one document with several texts. Other columns are not read.
    Empty table: no rows.
    """
    least = least_equal(percent)
    sets = stage(signatures(docs, id_col, text_col), "signatures")
    named = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("planes").alias("planes")), "classes")
    members = stage(_members(classes).join(classes.select("rep", "planes"), "rep"), "members")
    pairs = stage(_propose(members, least), "pairs")
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the ids grow with the table, so this join has one plan at every size
    texts = stage(source.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    links = stage(_confirm(pairs, texts, percent), "links")
    parts = stage(connected_components(links), "parts")
    # the rest: buckets in which more than one component is left
    part = F.coalesce("component", "rep").alias("part")
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "i", "j", "rep", "planes", part)
    split = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("bucket")
    # only classes with a partner over the estimate's bound have a text here; the others have no link to find
    here = placed.join(split, "bucket", "left_semi").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    more = _remaining(here, least, percent)
    parts = stage(connected_components(links.union(more)), "parts")
    found = sets.join(classes.select("digest", "rep"), "digest", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (with their columns) whose document stays: one of each component."""
    gone = near_duplicates(docs, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def estimate(planes: Column, other: Column) -> Column:
    """The same estimate as a column expression, for signatures kept in a table."""
    words = MINIMA // 64
    equal = F.lit(MINIMA)
    for w in range(words):
        differ = planes[w].bitwiseXOR(other[w])
        for plane in range(1, BITS):
            differ = differ.bitwiseOR(planes[plane * words + w].bitwiseXOR(other[plane * words + w]))
        equal = equal - F.bit_count(differ)
    return (equal / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)
