"""Exact top-k by inner product: vectors in order of descending length, partial sums in rotated coordinates.

Vectors are rotated by the eigenvectors of their second-moment matrix (the right singular vectors of the table), so
that the leading coordinates carry most of each product. A candidate block is scanned from its longest vector on. For
a chunk of candidates the head coordinates give partial sums, and by Cauchy-Schwarz the rest adds at most the product
of the two tails' lengths; only candidates whose bound reaches the query's k-th best so far get their exact integer
product. A query is done with a block when its length times that of the next vector is below its k-th best.

Queries and candidates are both dealt into blocks of bounded size by a hash of the id, and one group is one pair of
blocks, so memory and the work of a task do not grow with the table; each group returns at most k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage

K = 10
#: Queries and candidates of a group on average; a chunk of a scan; share of the coordinates that is the head.
QUERIES, CANDIDATES, CHUNK, HEAD = 2048, 8192, 1024, 0.25


def integers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer products; beyond 64 bits they are computed as Python integers and end at the largest 64-bit ones."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < 2.0**62:
        return rows @ query
    wide = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in wide], np.int64)


def scan(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score): the k best candidates of each query, none with the query's own id."""
    length = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    cid, c, length = cid[order], c[order], length[order]
    head = max(1, math.ceil(HEAD * c.shape[1])) if c.shape[1] else 0
    qr, cr = q @ rotation, c @ rotation
    q_tail, c_tail = (np.sqrt((x[:, head:] ** 2).sum(1)) for x in (qr, cr))
    q_length = np.sqrt((q.astype(float) ** 2).sum(1))
    best: list[list[tuple[int, int]]] = [[] for _ in qid]
    floor = np.full(len(qid), -np.inf)
    slack = 1e-9 * (1 + q_length * length.max(initial=0))  # of the rounding of rotated sums
    alive = np.arange(len(qid))
    for at in range(0, len(cid), CHUNK):
        alive = alive[q_length[alive] * length[at] + slack[alive] >= floor[alive]]
        if not len(alive):
            break
        part = slice(at, at + CHUNK)
        bound = qr[alive, :head] @ cr[part, :head].T + np.outer(q_tail[alive], c_tail[part])
        hopeful = bound + slack[alive, None] >= floor[alive, None]
        for row, query in enumerate(alive.tolist()):
            picked = np.flatnonzero(hopeful[row]) + at
            picked = picked[cid[picked] != qid[query]]
            if not len(picked):
                continue
            scores = exact(c[picked], q[query])
            if len(picked) > k:
                top = np.lexsort((cid[picked], -scores))[:k]
                picked, scores = picked[top], scores[top]
            merged = best[query] + list(zip((-scores).tolist(), cid[picked].tolist()))
            best[query] = sorted(merged)[:k]
            if len(best[query]) == k:
                floor[query] = -best[query][-1][0]
    for query, found in zip(qid.tolist(), best):
        for negative, candidate in found:
            yield query, candidate, -negative


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments, largest first: sums of width x width numbers, added in Spark."""
    if not width:
        return np.zeros((0, 0))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    sums = [F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)]
    rows = vectors.select("v").mapInArrow(moments, "i int, row array<double>").groupBy("i").agg(*sums).orderBy("i").collect()
    matrix = np.array([r[1:] for r in rows], float) if rows else np.eye(width)
    return np.linalg.eigh(matrix)[1][:, ::-1]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    if (lengths == width).all():
        return column.flatten().to_numpy().reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    for k, row in enumerate(column.to_pylist()):
        out[k, : len(row)] = row
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. The id is the
    key: rows that repeat it count once, with the least vector. Vectors of fewer components than the longest count as
    filled up with zeros. Products beyond 64 bits end there. Empty table, or one vector: no rows.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).filter(F.col("id").isNotNull() & usable(F.col("e")))
    clean = stage(named.select("id", integers(F.col("e")).alias("v")).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    size = clean.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    width = size.width or 0
    rotation = rotation_of(clean, width)
    q_blocks, c_blocks = max(1, math.ceil(size.q / QUERIES)), max(1, math.ceil(size.n / CANDIDATES))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = clean.filter(F.col("id") % every == 0).select("id", "v", F.lit(True).alias("asks"), block(q_blocks, 1).alias("qb"), every_block(c_blocks).alias("cb"))
    c = clean.select("id", "v", F.lit(False).alias("asks"), every_block(q_blocks).alias("qb"), block(c_blocks, 2).alias("cb"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids, asks, x = group.column("id").to_numpy(), group.column("asks").to_numpy(), _matrix(group.column("v"), width)
        found = list(scan(ids[asks], x[asks], ids[~asks], x[~asks], rotation, k))
        a, b, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})

    found = q.unionByName(c).groupBy("qb", "cb").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
