"""Repair of the turn structure of conversations: cheapest edits, and among those the least audit string.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Its rows stand in order of turn (nulls
first). A row is blank (no visible character), a duplicate (role and text stood before) or truncated (its last visible
character ends no sentence); the first of these that holds is its fault. Each row is kept (0), given the role that must come
next (``R``, 2) or deleted (``D``, 3; blank and duplicate rows must be), empty turns are inserted anywhere (``I``, 2), and a
truncated row that stays costs 1 more. The audit is the edits' initials in order.

Method. Nodes are (rows done, state); states are start, after s, after u, after a. A backward cost DP leaves the arcs
that lie on a cheapest path. The audits of two nodes are compared by prefix doubling: rank 0 is the first initial of a
node's least audit, and the rank of length 2^(k+1) is that of the pair (rank of length 2^k here, rank of length 2^k at the
node 2^k edits on). With the ranks each node takes its arc of least (initial, rank of the node it leads to), and the paths
are read off the doubled pointers, all nodes of a batch at once.

Scale. Rows are range-partitioned by conversation and turn, so the rows of one huge conversation spread, and are cut into
chunks of at most ``CHUNK`` neighbours, of which only one byte a row goes on. A chunk is a 4 x 4 matrix of least costs
between states; of a conversation with several chunks the matrices (one for every ``CHUNK`` rows) are combined from the end,
then each chunk finds its audits for every state it may start in, and the states are followed from the front. Edits
meet the texts in one stream in row order, which holds one chunk's audit at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import sliced, stage

#: Bits of a row's place within its chunk.
CHUNK_BITS = 12
#: Nodes of a batch that are ranked together.
NODES = 1 << 19

#: Costs. Letters of a role: other, s, u, a. States: start, after s, after u, after a.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT, NEVER = 0, 2, 3, 2, 1, 1 << 40
LETTERS = "?sua"
STEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
FORCED = np.array([2, 2, 3, 2])
ROLE = ("user", "user", "assistant", "user")
#: What ends a conversation in each state: empty turns up to the next place where it may end.
CLOSING = (0, 2, 1, 0)
END = np.array([INSERT * n for n in CLOSING], np.int64)

#: A row's byte: letter in the low two bits, then its fault.
BLANK, DUPLICATE, TRUNCATED, PAD = 4, 8, 16, 32
FAULTS = {BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}
INITIALS = np.frombuffer(b"\0DIKR", "S1")

EDITS = "conv_id long, place long, edit string, turn long, old_role string, role string, text string, fault string, cost int"


def costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from each node: (chunks, rows + 1, 4). Rows are aligned at the end; ``ends`` are the costs there."""
    n, rows = codes.shape
    out = np.empty((n, rows + 1, 4), np.int64)
    out[:, rows] = ends
    for i in range(rows - 1, -1, -1):
        ahead, code = out[:, i + 1], codes[:, i]
        stays = np.where(code & (BLANK | DUPLICATE), NEVER, np.where(code & TRUNCATED, CUT_SHORT, 0))[:, None]
        step = STEP.T[code & 3]
        keep = np.where(step >= 0, np.take_along_axis(ahead, np.maximum(step, 0), 1), NEVER) + KEEP + stays
        best = np.minimum(np.minimum(ahead + DELETE, keep), ahead[:, FORCED] + REROLE + stays)
        best[:, 2:] = np.minimum(best[:, 2:], best[:, [3, 2]] + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        out[:, i] = np.where((code == PAD)[:, None], ahead, best)
    return out


def matrices(codes: np.ndarray) -> np.ndarray:
    """Least cost from each state before a chunk to each state after it: (chunks, 4, 4)."""
    return np.stack([costs(codes, np.where(np.arange(4) == s, 0, NEVER)[None, :])[:, 0] for s in range(4)], axis=2)


def least_audits(codes: np.ndarray, ends: np.ndarray) -> list[list[tuple[bytes, int]]]:
    """For each chunk and state before it: the least cheapest audit and the state after it."""
    n, rows = codes.shape
    cost = costs(codes, ends)
    here, ahead = cost[:, :-1], cost[:, 1:]
    node = np.arange(cost.size).reshape(cost.shape)
    live = (codes != PAD)[:, :, None]
    may = live & ~(codes & (BLANK | DUPLICATE)).astype(bool)[:, :, None]
    short = np.where(codes & TRUNCATED, CUT_SHORT, 0)[:, :, None]
    step = STEP.T[codes & 3]
    to = np.maximum(step, 0)
    # arcs in the order of their initials: delete, insert, keep, rerole
    arcs = [
        (live & (here == ahead + DELETE), node[:, 1:]),
        (live & (here == here[:, :, FORCED] + INSERT), node[:, :-1][:, :, FORCED]),
        (may & (step >= 0) & (here == np.take_along_axis(ahead, to, 2) + KEEP + short), np.take_along_axis(node[:, 1:], to, 2)),
        (may & (here == ahead[:, :, FORCED] + REROLE + short), node[:, 1:][:, :, FORCED]),
    ]
    label, pointer = np.zeros(cost.shape, np.int64), node.copy()
    for initial, (best, target) in reversed(list(enumerate(arcs, 1))):
        label[:, :-1] = np.where(best, initial, label[:, :-1])
        pointer[:, :-1] = np.where(best, target, pointer[:, :-1])
    rank, jump = label.ravel(), pointer.ravel()
    while (jump != jump[jump]).any():  # ranks of audits of length 1, 2, 4, ...
        _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
        jump = jump[jump]
    # the arc of least (initial, rank of its end)
    chosen = np.full(cost.shape, np.iinfo(np.int64).max)
    label, pointer = np.zeros(cost.shape, np.int64), node.copy()
    for initial, (best, target) in enumerate(arcs, 1):
        key = np.where(best, initial * (int(rank.max()) + 1) + rank[target], chosen[:, :-1])
        better = key < chosen[:, :-1]
        chosen[:, :-1] = np.minimum(key, chosen[:, :-1])
        label[:, :-1] = np.where(better, initial, label[:, :-1])
        pointer[:, :-1] = np.where(better, target, pointer[:, :-1])
    label, jumps, steps = label.ravel(), [pointer.ravel()], (pointer != node).ravel().astype(np.int64)
    while (jumps[-1] != jumps[-1][jumps[-1]]).any():
        steps = steps + steps[jumps[-1]]
        jumps.append(jumps[-1][jumps[-1]])
    starts = node[np.arange(n), (codes == PAD).sum(1)].ravel()
    length, last = steps[starts], jumps[-1][starts] % 4
    at = np.repeat(starts[:, None], int(length.max(initial=0)), 1)
    place = np.arange(at.shape[1])
    for bit, jump in enumerate(jumps):
        far = (place >> bit & 1).astype(bool)
        at[:, far] = jump[at[:, far]]
    text = INITIALS[label[at]] if at.size else np.empty(at.shape, "S1")
    found = [(text[k, : length[k]].tobytes(), int(last[k])) for k in range(len(starts))]
    return [found[4 * b : 4 * b + 4] for b in range(n)]


def _padded(rows: list[bytes]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), PAD, np.uint8)
    for k, row in enumerate(rows):
        if row:
            out[k, -len(row) :] = np.frombuffer(row, np.uint8)
    return out


def _alike(codes: list[bytes]) -> Iterator[list[int]]:
    """Places of chunks of similar length, few enough for one batch."""
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    while order:
        longest, take = len(codes[order[-1]]) + 1, 1
        while take < len(order) and (take + 1) * longest * 4 <= NODES and 2 * (len(codes[order[-1 - take]]) + 1) >= longest:
            take += 1
        yield order[-take:]
        del order[-take:]


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        out: list = [None] * len(codes)
        for some in _alike(codes):
            for k, matrix in zip(some, matrices(_padded([codes[k] for k in some]))):
                out[k] = matrix.ravel().tolist()
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], names=["key", "chunk", "matrix"])


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("audit", pa.string()), ("codes", pa.binary())])
    for batch in batches:
        keys, chunks, codes, ends = (batch.column(c).to_pylist() for c in ("key", "chunk", "codes", "ends"))
        rows = []
        for some in _alike(codes):
            end = np.array([END if ends[k] is None else ends[k] for k in some], np.int64)
            for k, found in zip(some, least_audits(_padded([codes[k] for k in some]), end)):
                states = range(1) if ends[k] is None else range(4)  # a conversation of one chunk starts at the start
                rows += [(keys[k], chunks[k], s, found[s][1], found[s][0].decode(), codes[k]) for s in states]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _from_the_end(chunks: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each chunk of one conversation."""
    chunks = chunks.sort_values("chunk", ascending=False)
    now, ends = END, []
    for matrix in chunks.matrix:
        ends.append(now.tolist())
        now = (np.asarray(matrix).reshape(4, 4) + now[None, :]).min(1)
    return pd.DataFrame({"key": chunks.key, "chunk": chunks.chunk, "ends": ends})


def _from_the_front(chunks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each chunk of one conversation starts."""
    state, rows = 0, []
    for chunk, part in chunks.sort_values("chunk").groupby("chunk"):
        rows.append((chunks.key.iloc[0], chunk, state))
        state = int(part.end[part.start == state].iloc[0])
    return pd.DataFrame(rows, columns=["key", "chunk", "start"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream of audits and rows of whole conversations, in order, as edits."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("old_role", pa.string()),
        ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int32()),
    ])
    out: list[tuple] = []
    key, conv, place, state, audit, at, codes, row = None, None, 0, 0, "", 0, b"", 0

    def insert() -> None:
        nonlocal place, state
        out.append((conv, place, "I", None, None, ROLE[state], "", None, INSERT))
        place, state = place + 1, int(FORCED[state])

    def close() -> None:
        for _ in range(CLOSING[state] if key is not None else 0):
            insert()

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return done

    for batch in sliced(batches):
        for name, given, turn, role, text, edits, bits in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "audit", "codes"))):
            if name != key:
                close()
                key, place, state = name, 0, 0
            if edits is not None:
                audit, at, codes, row = edits, 0, bits, 0
                continue
            conv = given
            while audit[at] == "I":
                insert()
                at += 1
            edit, code = audit[at], codes[row]
            at, row = at + 1, row + 1
            fault = FAULTS.get(code & (BLANK | DUPLICATE | TRUNCATED))
            left = CUT_SHORT if code & TRUNCATED else 0
            if edit == "D":
                out.append((conv, place, edit, turn, role, None, text, fault, DELETE))
            elif edit == "R":
                out.append((conv, place, edit, turn, role, ROLE[state], text, fault, REROLE + left))
                state = int(FORCED[state])
            else:
                out.append((conv, place, edit, turn, role, role, text, fault, KEEP + left))
                state = int(STEP[state][code & 3])
            place += 1
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def repair(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row an edit of conversations (conv_id, turn, role, text): conv_id, place (from 0, in order), edit (K, R, D or I),
    turn and old_role (null for an inserted turn), role (null for a deleted one), text, fault (blank, duplicate, truncated or
    null) and cost. The rows whose edit is not D are the repaired conversation. Rows of one conversation follow one another.

    Null role or text: one space. Null turns stand first; rows of equal turn in order of role, a hash of the text and their
    place in the table, so repeated rows are neighbours and all but the first are duplicates. Null conv_id: one conversation.
    Other columns are not read. Empty table: no rows.
    """
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    given = given.withColumns({"key": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "hash": F.md5("text")})
    order = ["key", F.col("turn").asc_nulls_first(), "role", "hash", "row"]
    placed = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("k", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("chunk", F.shiftright("k", chunk_bits)).drop("row"), "turns")
    # faults
    letter = F.greatest(F.instr(F.lit(LETTERS[1:]), F.substring("role", 1, 1)), F.lit(0))
    letter = F.when(F.length("role") > 0, letter).otherwise(0)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marks = placed.select("key", "k", "chunk", F.xxhash64("role").alias("r"), "hash", letter.alias("letter"), blank.alias("blank"), cut.alias("cut"))
    first = marks.groupBy("key", "r", "hash").agg(F.min("k").alias("first"))
    marks = marks.join(first, ["key", "r", "hash"])
    fault = F.when(F.col("blank"), BLANK).when(F.col("k") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    code = F.lpad(F.hex(F.col("letter") + fault), 2, "0")
    chunks = marks.groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", code.alias("code")))).alias("rows"))
    codes = F.unhex(F.array_join(F.transform("rows", lambda r: r["code"]), ""))
    chunks = stage(chunks.select("key", "chunk", codes.alias("codes")), "chunks")
    # conversations of several chunks
    several = chunks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    parts = chunks.join(several, "key", "left_semi").mapInArrow(_matrix_rows, "key string, chunk long, matrix array<long>")
    ends = parts.groupBy("key").applyInPandas(_from_the_end, "key string, chunk long, ends array<long>")
    audits = chunks.join(ends, ["key", "chunk"], "left").mapInArrow(_audit_rows, "key string, chunk long, start int, end int, audit string, codes binary")
    audits = stage(audits, "audits")
    follow = audits.join(several, "key", "left_semi").select("key", "chunk", "start", "end")
    starts = follow.groupBy("key").applyInPandas(_from_the_front, "key string, chunk long, start int")
    taken = audits.join(starts, ["key", "chunk", "start"], "left_semi").unionByName(audits.join(several, "key", "left_anti"))
    # one stream: a chunk's audit, then its rows
    blank_row = [F.lit(None).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    edits = taken.select("key", "chunk", F.lit(-1).cast("long").alias("k"), *blank_row, "audit", "codes")
    texts = placed.select("key", "chunk", "k", "conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("binary").alias("codes"))
    stream = edits.unionByName(texts).repartition("key").sortWithinPartitions("key", "chunk", "k")
    return stream.select("key", "conv_id", "turn", "role", "text", "audit", "codes").mapInArrow(_edits, EDITS)
