"""Conversation repair against a plain search of the least (cost, audit)."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER
from tidegrid.llm import repair
from tidegrid.llm.queries import QUERIES
from tidegrid.llm.query_repair import damaged, summaries

SPACE = " \t\n\v\f\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def slow_repair(rows):
    """(cost, audit, repaired rows) of ordered (role, text) with faults, by trying every edit."""
    seen, faults = set(), []
    for role, text in rows:
        visible = text.strip(SPACE)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, last, inserted):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def add(cost, edit, rest, kept):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], (*kept, *rest[2])))

        if inserted < 2:
            for c in follow[last].replace("s", ""):
                add(2, "I", best(i, c, inserted + 1), ((full[c], ""),))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            add(3, "D", best(i + 1, last, 0), ())
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] and role[:1] in follow[last]:
                    add(extra, "K", best(i + 1, role[0], 0), ((role, text),))
                for c in follow[last].replace("s", ""):
                    add(2 + extra, "R", best(i + 1, c, 0), ((full[c], text),))
        return min(found) if found else None

    return *best(0, "", 0), faults


def slow(rows):
    """The contract's row of each conversation, from damaged rows in table order (ties of turn must be equal rows)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in slow_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        cost, audit, kept, faults = slow_repair(tuple((r[2], r[3]) for r in mine))
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in sorted(rng.sample(range(12), rng.randrange(1, 8))):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "s"])
            text = rng.choice(["Yes.", "No", "Why? \n", " \t", "", None, "a\x1c", "日本語。", "Well!", f"Text {rng.random()}."])
            rows.append((conv, turn, role, text))
        if rng.random() < 0.2:
            rows.append((conv, None, "user", f"No turn {conv}"))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [12, 1])
def test_repair_equals_plain_search(spark, bits):
    rows = made(4, 300)
    found = summaries(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk_bits=bits).collect()
    want = slow(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_query_equals_plain_search(spark):
    given = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = slow([tuple(r) for r in given.collect()])
    found = QUERIES["op11_repair"](spark, FOLDER).collect()
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_edits_rebuild_rows(spark):
    """Every row has one edit; what stays reads as it should; repeated rows, odd texts and clashing columns."""
    rows = made(7, 40) + [(1000, 5, "user", "again")] * 3 + [(1001, None, None, None), (1002, 1, "user", "x" * 20000 + ".")]
    given = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(1), "key": F.lit("k"), "audit": F.lit(None), "k": F.lit(3)})
    edits = repair.repair(given).collect()
    assert sum(e.edit != "I" for e in edits) == len(rows)
    by = {}
    for e in edits:
        by.setdefault(e.conv_id, []).append(e)
    for conv, mine in by.items():
        assert [e.place for e in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[:1] for e in mine if e.edit != "D"))
    assert [e.fault for e in by[1000] if e.edit != "I"] == ["truncated", "duplicate", "duplicate"]
    assert [e.edit for e in by[1001]] == ["D"] and [e.edit for e in by[1002]] == ["K", "I"]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert summaries(none).count() == 0 and repair.repair(none).count() == 0


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = summaries(spark.createDataFrame([(5, turn, "user", "x")], SCHEMA)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_one_long_conversation_in_chunks(spark):
    """A conversation over many chunks gives what one chunk gives."""
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {t}", f"Fine {t}.", ""])) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (repair.repair(damaged(df), chunk_bits=b).orderBy("place").collect() for b in (12, 4))
    assert one == many


def test_ranks_follow_audits():
    """Nodes' least audits from the doubled pointers are those of a plain walk."""
    rng = np.random.default_rng(1)
    codes = [bytes((rng.integers(0, 4, n) + rng.choice([0, 0, 4, 8, 16], n)).astype(np.uint8)) for n in rng.integers(1, 40, 60)]
    found = repair.least_audits(repair._padded(codes), np.repeat(repair.END[None], 60, 0))
    for code, mine in zip(codes, found):
        assert mine[0] == repair.least_audits(repair._padded([code]), repair.END[None])[0][0]
