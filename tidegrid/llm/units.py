"""Whole-text encoding by memoised units: a text is cut where no token can span, and each cut's ids are kept.

Cuts used, and why they change no id:

* ``word`` vocabularies drop white space, so a text may be cut at every space and line feed.
* ``byte`` vocabularies split text by ``public_tokenizers.PATTERN`` first. There a space or line feed that a
  non-white character follows always starts a new match (it is the last of its white run, which the pattern
  leaves to what comes next), so a text may be cut before it.

A text that holds one of the vocabulary's added tokens is encoded as it stands.

Units that the memo lacks are encoded together, joined by a separator whose id no other text has. The memo is two
generations of bounded size, so memory does not grow with the corpus and frequent units stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Units, and characters in them, that a generation of the memo keeps.
MEMO, MEMO_CHARS = 1 << 19, 1 << 23
#: Texts whose units are looked up together: few, so that they are still in the processor's cache when joined.
TOGETHER = 64
#: Signs that are a match of their own where a letter stands before them and white space or nothing after.
TAILS = frozenset(".,;:!?")

_OPEN = re.compile(r"[ \n](?:\s|\Z)")
_CUT = re.compile(r"(?=[ \n]\S)")


def word_units(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def byte_units(text: str) -> list[str]:
    """Units as they stand, but that the space before most of them is left out; see ``byte_unit``."""
    if _OPEN.search(text):
        first, *rest = _CUT.split(text)
        return [first, *(u[1:] if u[0] == " " else u for u in rest)]
    return text.replace("\n", " \n").split(" ")


def byte_unit(key: str) -> str:
    return key if key[:1] == "\n" else " " + key


class UnitEncoder:
    """Texts to ids (little-endian unsigned 32-bit bytes). ``encode_many`` gives those of a list of units."""

    def __init__(
        self, kind: str, encode_many: Callable[[list[str]], list[bytes]], limit: int = MEMO, whole: tuple[str, ...] = (),
        encode_whole: Callable[[list[str]], list[bytes]] | None = None,
    ):
        self.byte, self.encode_many, self.limit, self.whole, self.encode_whole = kind == "byte", encode_many, limit, whole, encode_whole
        self.cut = byte_units if self.byte else word_units
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails = {"": b""}
        self.chars = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids for at in range(0, len(texts), TOGETHER) for ids in self._some(texts[at : at + TOGETHER])]

    def _some(self, texts: list[str]) -> list[bytes]:
        special = [k for k, t in enumerate(texts) if any(w in t for w in self.whole)]
        if special:  # a vocabulary's added token may span cuts: such texts are encoded as they stand
            given = dict(zip(special, self.encode_whole([texts[k] for k in special])))
            rest = iter(self._some([t for k, t in enumerate(texts) if k not in given]))
            return [given[k] if k in given else next(rest) for k in range(len(texts))]
        if len(self.memo) >= self.limit or self.chars >= MEMO_CHARS:
            self.memo, self.old, self.chars = {}, self.memo, 0
        cuts = [self.cut(t) for t in texts]
        if not self.byte:
            return [b"".join(ids) for ids in self._known(cuts)]
        # after a line feed, which is one token, a text starts as it does by itself, unless with white space
        plain = [bool(c[0]) and not c[0][0].isspace() for c in cuts]
        firsts = [c[0] for c in cuts]
        for c, ok in zip(cuts, plain):
            c[0] = "\n" + c[0] if ok else "\n"
        joined = [b"".join(ids) for ids in self._known(cuts)]
        feed = len(self.memo["\n"]) if "\n" in self.memo else 0
        return [ids[4:] if ok else (self.encode_many([f])[0] if f else b"") + ids[feed:] for f, ok, ids in zip(firsts, plain, joined)]

    def _known(self, cuts: list[list[str]]) -> list[list[bytes]]:
        """The ids of each unit; those that the memo lacks are learned together."""
        get = self.memo.get
        found = [list(map(get, c)) for c in cuts]
        rows, places, lacking = [], [], []
        for c, ids in zip(cuts, found):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                rows.append(ids)
                places.append(at)
                lacking.append(c[at])
        self._learn(set(lacking))
        for ids, at, unit in zip(rows, places, lacking):
            ids[at] = self.memo[unit]
        return found

    def _learn(self, lacking: set[str]) -> None:
        """A new unit is learned without the sign after its last letter, which both kinds of pattern match by itself there.
        ``word`` vocabularies lower all letters, so plain ASCII is lowered here, and fewer units are new."""
        memo, old, byte = self.memo, self.old, self.byte
        again = old.keys() & lacking
        memo.update((unit, old[unit]) for unit in again)
        new = list(lacking - again)
        self.chars += sum(map(len, lacking))
        cores, ends = [], []
        for unit in new:
            core, tail = unit, ""
            if unit[-1:] in TAILS and "A" <= unit[-2:-1] < "\u0250" and unit[-2].isalpha():
                core, tail = unit[:-1], unit[-1]
            if not byte and core.isascii() and "<" not in core:
                core = core.lower()
            cores.append(core)
            ends.append(tail)
        need = list(set(cores).difference(memo))
        memo.update(zip(need, self.encode_many([byte_unit(u) for u in need] if byte else need)))
        tails = set(ends).difference(self.tails)
        self.tails.update(zip(tails, self.encode_many(list(tails))))
        memo.update(zip(new, map(bytes.__add__, map(memo.__getitem__, cores), map(self.tails.__getitem__, ends))))


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def is_wide(path: str, end_id: int = 0) -> bool:
    """Whether ids of a vocabulary file (or the end id) need more than 16 bits."""
    return max(max(_tokenizer(path).get_vocab(True).values(), default=0), end_id) >= 1 << 16


@lru_cache(maxsize=4)
def library_encoder(path: str, kind: str) -> UnitEncoder:
    """The tokenizers library's encoder of a vocabulary file, one for each worker process."""
    tokenizer = _tokenizer(path)
    whole = tuple(token.content for token in tokenizer.get_added_tokens_decoder().values())

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # a zero by itself is one token, which no unit without a zero has
    between = " 0" if kind == "byte" else " 0 "
    ((mark,),) = encode([between])

    def encode_many(units: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {"": b""}
        simple = [u for u in units if u and "0" not in u]
        groups = [simple[at : at + 256] for at in range(0, len(simple), 256)]
        for some, joined in zip(groups, encode([between.join(g) for g in groups])):
            ids = np.asarray(joined, dtype="<u4")
            ends = np.flatnonzero(ids == mark)
            if len(ends) == len(some) - 1:
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                found.update(zip(some, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]))
        alone = [u for u in dict.fromkeys(units) if u not in found]
        found.update(zip(alone, map(as_bytes, encode(alone))))
        return list(map(found.__getitem__, units))

    return UnitEncoder(kind, encode_many, whole=whole, encode_whole=lambda texts: list(map(as_bytes, encode(texts))))
