"""Query of the conversation repair: damaged rows, their repair, and a digest of it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import repair
from tidegrid.llm.common import sliced, table
from tidegrid.llm.queries import register

SUMMARY = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage that a hash of conversation and turn picks: one is dropped, emptied, loses its sentence ends,
    is repeated, or becomes the user's. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


class Summary:
    """Counts and hashes of one conversation's edits, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.digest, self.before = conv_id, [], hashlib.sha256(), None
        self.count = dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost"], 0)
        self.first = self.last = None
        self.turns, self.empty = 0, True

    def add(self, edit: str, turn: int | None, old: str | None, role: str | None, text: str, fault: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.count["cost"] += cost
        if fault:
            self.count[fault] += 1
        if old is not None:
            if self.before is not None and self.before[:1] + old[:1] not in ("su", "ua", "au"):
                self.count["illegal"] += 1
            self.before = old
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if role is not None:
            self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, *self.count.values(), "".join(self.audit), self.digest.hexdigest()


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in the order that ``repair`` gives them: a conversation starts at place 0."""
    now: Summary | None = None
    for batch in sliced(batches):
        done = []
        for conv, place, *edit in zip(*(c.to_pylist() for c in batch.columns)):
            if place == 0:
                if now is not None:
                    done.append(now.row())
                now = Summary(conv)
            now.add(*edit)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), SUMMARY)], schema=SUMMARY)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), SUMMARY)], schema=SUMMARY)


def summaries(conversations: DataFrame, **options) -> DataFrame:
    """A row for every conversation of the table; zeros where no row is left."""
    edits = repair.repair(damaged(conversations), **options).select("conv_id", "place", "edit", "turn", "old_role", "role", "text", "fault", "cost")
    ddl = "found long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = edits.mapInArrow(lambda batches: (b.rename_columns(["found", *b.schema.names[1:]]) for b in summarise(batches)), ddl)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.drop("found").na.fill({**zero, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


@register("op11_repair")
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "conversations"))
