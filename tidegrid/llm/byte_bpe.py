"""Byte-pair encoding from a rank file in linear time, by longest matches and backtracking.

The merges of a rank file define one token sequence for a text. A sequence of tokens is that one exactly if each
adjacent pair is *compatible*: encoding the pair's bytes gives the pair back. So the encoder takes the longest
vocabulary entry at the current place (all matches come from one pass of an Aho-Corasick automaton over the bytes,
mapped to Latin-1), keeps it if it is compatible with the token before it and its end is not known as a dead end,
else tries the next shorter prefix, and with none left marks the place as dead and steps back. Every place is marked
at most once. Compatibility of a pair is found by undoing merges, at most one for each byte, and memoised.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import sliced
from tidegrid.llm.units import UnitEncoder, as_bytes

#: Pairs whose compatibility is kept, and matches of the pattern whose tokens are.
PAIRS, PIECES = 1 << 18, 1 << 17


class ByteBpe:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.vocabulary: pa.Array | None = None
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins; None for one byte, and for entries that no merge makes."""
        if token not in self.parts:
            piece = self.bytes[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def made(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self.split(token) is not None

    def prefix(self, token: int) -> int | None:
        """The longest entry that is a proper prefix."""
        if token not in self.shorter:
            piece = self.bytes[token]
            self.shorter[token] = next((self.ranks[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ranks), None)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the later of the two last merges, and ask whether the tokens that meet would have merged sooner.

        ``bound``: only a merge before this one can have come first. A merge across the border beats one of the
        same rank to its right, and not one to its left, as equal ranks merge from the left.
        """
        bound = len(self.bytes)
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < bound:
                return False
            a = left if len(self.bytes[left]) > 1 else -1
            b = right if len(self.bytes[right]) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, left = a, self.split(a)[1]
            else:
                bound, right = b + 1, self.split(b)[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None and self.made(whole):
            return [whole]
        longest = [0] * len(piece)
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length] = rank  # ends rise, so the longest is last
        alive, tokens, at, token = bytearray(b"\1") * (len(piece) + 1), [], 0, longest[0]
        while at < len(piece):
            last = tokens[-1] if tokens else None
            while token is not None:
                end = at + len(self.bytes[token])
                if alive[end] and self.made(token) and (last is None or self.compatible(last, token)):
                    break
                token = self.prefix(token)
            if token is None:
                alive[at] = 0
                token = tokens.pop()
                at -= len(self.bytes[token])
            else:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(piece) else None
        return tokens

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list; null for a null list, and an error for an id that the vocabulary lacks."""
        if self.vocabulary is None:
            self.vocabulary = pa.array([self.bytes.get(i) for i in range(max(self.bytes) + 1)], pa.binary())
        tokens = self.vocabulary.take(ids.flatten())
        if tokens.null_count:
            raise KeyError("an id without an entry")
        ends = np.cumsum([0, *pc.fill_null(ids.value_lengths(), 0).to_pylist()])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens, mask=ids.is_null()), b"")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[ByteBpe, UnitEncoder]:
    """One for each worker process."""
    import regex

    bpe, pieces = ByteBpe(path), regex.compile(pattern).findall
    known: dict[str, list[int]] = {}  # matches that several units share

    def encode(unit: str) -> bytes:
        ids: list[int] = []
        for piece in pieces(unit):
            tokens = known.get(piece)
            if tokens is None:
                tokens = bpe.encode_piece(piece.encode())
                if len(piece) < 32:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = tokens
            ids += tokens
        return as_bytes(ids)

    return bpe, UnitEncoder("byte", lambda units: [encode(u) for u in units])


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each whole text, each match of the pattern by itself, no special tokens.

    With ``decoded``, also a column of the bytes that the ids stand for, decoded in the same pass. ``decode`` after ``encode``
    gives the same, but a task then has two workers that swap roles from task to task, so each comes to hold the memo.

    Null or empty text: an empty array. Null or repeated ids: a row for each row. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, units = codec(ranks, pattern)
        for batch in sliced(batches):
            found = units([text or "" for text in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *map(len, found)]) // 4
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            columns = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
            if decoded:
                columns["decoded"] = bpe.decode_many(columns["ids"])
            yield pa.RecordBatch.from_pydict(columns)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes that the ids stand for; null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = codec(ranks, pattern)
        for batch in sliced(batches):
            texts = bpe.decode_many(batch.column(ids_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
