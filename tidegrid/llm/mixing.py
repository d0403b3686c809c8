"""Mixing of sources to target weights: equal blocks of words are apportioned by highest quotients.

Every source gets a target: its weight's share of all words, at most ``REPEATS`` times what it has; what a source at
its limit leaves is shared again by weight. Each source's documents stand in a seeded order (md5 of seed and id) and
their words are cut into blocks of equal length, so a source's target is a number of its own blocks (its votes).
Seats go to sources by highest quotients votes / 1, votes / 3, votes / 5, ... (Sainte-Lague) down to a quotient of
1, which is where every source has its votes rounded to the nearest whole number. The order of the seats is the
order of the mix: runs of ``SHARD`` seats are its shards, so each shard holds every source's integer quota, and the
shards' quotas add up to the source's.

Seat k of a source is filled by the block that a seeded permutation has at k mod n, in the pass k div n over its n
blocks: whole passes first, then a seeded selection, none more than ``REPEATS`` times.

A block is a 2^-20 part of all words, 64 words at least, so there are about 2^20 seats at any size of the table.
Documents are placed by running sums inside small hash ranges of a source and sums of the ranges before, so a source
that holds most rows is not gathered anywhere; what is joined to the documents is one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD, stage, text_of
from tidegrid.operators.ranking import global_position

#: Weights of the sources in order, repeating; how often a word may be taken.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Blocks of the mix (about), least words of a block, seats of a shard, documents of a hash range (about).
SEATS, LEAST, SHARD, RANGE = 1 << 20, 64, 1 << 16, 1 << 11
#: A prime above any number of blocks: j * STEP mod n is a permutation of 0..n-1.
STEP = 2147483647


def _hashed(*parts: Column) -> Column:
    """52 bits of an md5, as a whole number in the order of its digits."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Sources (source, source_size) with ``rank`` (from 0, nulls last), ``weight`` and ``target``.

    Shares are dealt again until none is above its limit: one small aggregate a round.
    """
    ranked = global_position(sources, [F.col("source").asc_nulls_last()], name="rank").withColumn("rank", F.col("rank") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = stage(ranked.withColumn("weight", weight), "sources")
    limit = repeats * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, shared, at_limit = total, ranked.agg(F.sum("weight")).first()[0] or 0, -1
    while True:
        full = limit * F.lit(float(shared)) < F.col("weight") * F.lit(float(left))
        now = ranked.agg(
            F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if now.n == at_limit or not now.weight:
            break
        left, shared, at_limit = total - now.taken, now.weight, now.n
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(max(shared, 1)))
    return ranked.withColumn("target", F.when(full, limit.cast("double")).otherwise(share))


def apportion(sources: DataFrame, block: int, shard: int = SHARD, repeats: int = REPEATS, seed: int = 13) -> DataFrame:
    """Sources with their blocks and seats: n, short (words of a block; the first ``over`` blocks have one more), shift
    of the permutation, seats, and ``quotas``: array of (shard, first seat there, seats there) in order."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    rows = sources.withColumn("n", n).withColumns({
        "short": F.expr("source_size div nullif(n, 0)"), "over": F.expr("source_size % nullif(n, 0)"),
        "votes": F.try_divide(F.col("target") * F.col("n"), F.col("source_size")),
        "shift": _hashed(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))) % F.nullif("n", F.lit(0)),
    })
    rows = rows.withColumn("seats", F.coalesce(F.least(repeats * F.col("n"), F.floor(F.col("votes") + 0.5).cast("long")), F.lit(0)))
    rows = stage(rows, "apportioned")
    seats = rows.filter("seats > 0").select("rank", "votes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seats") - 1)).alias("k"))
    seats = seats.select("rank", "k", (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"))
    dealt = global_position(seats, [F.desc("quotient"), F.col("rank"), F.col("k")], name="seat")
    quotas = dealt.groupBy("rank", F.expr(f"(seat - 1) div {shard}").alias("shard")).agg(F.min("k").alias("first"), F.count("*").alias("quota"))
    lists = quotas.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("first", "shard", "quota"))).alias("quotas"))
    return rows.join(lists, "rank", "left").drop("votes")


# words of block j start here; words of the document in block j; the block's place in the seeded permutation
_START = "({j} * short + least({j}, over))"
_PLACE = f"((({{j}} * {STEP}L) + shift) % n)"
_BLOCK = "if({p} < over * (short + 1), {p} div (short + 1), over + ({p} - over * (short + 1)) div greatest(short, 1))"


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 13, seats: int = SEATS, least: int = LEAST,
    shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row a document: doc_id, source, size (words), source_size, target (its source's words in the mix) and
    ``pieces``: what the mix takes of it, an array of (shard, seat of its source, start and length in words), once for
    each time.

    Null or blank text: size 0, no pieces. Null source: a source of its own, the last one; an empty one is a source too.
    Null ids, repeated ids and repeated rows: every row is a document (those of equal id stand in order of size and a hash of the
    text). Other columns are not read. Empty table: no rows. No words at all: targets of 0.
    """
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_col).alias("text_hash"),
        ),
        "sizes",
    )
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "totals")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    plan = stage(apportion(targets(sizes, weights, repeats), max(least, -(-total // seats)), shard, repeats, seed), "plan")
    same = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    digits = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.withColumns({"key": same, "h": digits}).join(plan.withColumn("key", same).drop("source"), "key")
    # hash ranges of a source: at most about RANGE documents each, in the order of the digits
    width = F.expr(f"({1 << 52}L div (n_docs div {RANGE} + 1)) + 1")
    placed = placed.withColumn("part", F.expr("cast(conv(substring(h, 1, 13), 16, 10) as long)") .cast("long"))
    placed = placed.withColumn("part", F.floor(F.col("part") / width).cast("long"))
    parts = placed.groupBy("key", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("key", "part").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["key", "part"])
    placed = placed.withColumn("at", F.col("ahead") + F.col("inside"))
    words = f"least({_START.format(j='(j + 1)')}, at + size) - greatest({_START.format(j='j')}, at)"
    piece = (
        "struct(element_at(filter(quotas, s -> s.first <= seat), -1).shard as shard, seat,"
        f" greatest({_START.format(j='j')}, at) - at as start, {words} as length)"
    )
    passes = f"transform(sequence(0L, {repeats - 1}L), pass -> pass * n + {_PLACE.format(j='j')})"
    taken = f"transform(filter({passes}, seat -> seat < seats), seat -> {piece})"
    blocks = f"sequence({_BLOCK.format(p='at')}, {_BLOCK.format(p='(at + size - 1)')})"
    none = "cast(array() as array<struct<shard: bigint, seat: bigint, start: bigint, length: bigint>>)"
    pieces = F.expr(f"if(size > 0, flatten(transform({blocks}, j -> {taken})), {none})")
    return placed.select("doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"))
