"""Ordering over whole tables without one big task.

A row number or an exact quantile over a group that may hold a third of all rows
must not put the group into one task. Rows are range-partitioned, numbered inside
each partition, and shifted by the sizes of the partitions before.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

_ROW_BITS = 33


def _ranged(df: DataFrame, group: list[str], order: list) -> DataFrame:
    spread = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    fixed = cut_lineage(spread.withColumn("_m", F.monotonically_increasing_id()))
    return fixed.withColumn("_p", F.shiftright("_m", _ROW_BITS)).withColumn(
        "_i", F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)
    )


def _join_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their partition's offset; a null group is a group like any other."""
    named = offsets.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_p", "_k")
    same = F.col("_p") == F.col("_k")
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, same).drop("_k", *(f"_k_{k}" for k in keys))


def global_position(df: DataFrame, order: list, group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """1-based position in ``order`` (which must be unique) inside ``group`` or the whole table."""
    group = group or []
    rows = _ranged(df, group, order)
    sizes = rows.groupBy("_p", *group).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = _join_offsets(rows, offsets, group)
    return joined.withColumn(name, F.col("_off") + F.col("_i") - F.col("_first") + 1).drop(
        "_p", "_m", "_i", "_off", "_first"
    )


#: Rounds of a keyed permutation.
ROUNDS = 24


def round_keys(seed: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}/{r}".encode()).hexdigest()[:13], 16) for r in range(1, ROUNDS + 1)]


def keyed_permutation(i: Column, n: int, seed: int) -> Column:
    """Where a permutation of 0..n-1 that ``seed`` fixes sends i: exact for any n, without sorting anything.

    In each round i has one partner, (key - i) mod n, and a hash that both share decides whether they swap.
    """
    keys = F.array(*[F.lit(k % max(n, 1)) for k in round_keys(seed)])

    def swap(x: Column, r: Column) -> Column:
        partner = (F.element_at(keys, r) + F.lit(n) - x) % max(n, 1)
        digit = F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), r.cast("string"), F.greatest(x, partner).cast("string"))), 1, 1)
        return F.when(F.conv(digit, 16, 10).cast("int") % 2 == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), swap)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key as columns q0..qk, exact at any group size.

    Equal values are counted first, so a value shared by a third of all rows is one row.
    """
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count("*").alias("_c")
    )
    rows = _ranged(counts, keys, ["_v"])
    sizes = rows.groupBy("_p", *keys).agg(F.sum("_c").alias("_n"))
    by_key = Window.partitionBy(*(keys or [F.lit(0)]))
    before = by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_p",
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    local = Window.partitionBy("_p", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        _join_offsets(rows.withColumn("_cum", F.sum("_c").over(local)), offsets, keys)
        .withColumn("_hi", F.col("_off") + F.col("_cum"))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        for part, pos in (("a", F.floor(at)), ("b", F.ceil(at))):
            hit = (F.col("_lo") <= pos) & (pos < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{part}{i}"))
    agg = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    outs = []
    for i, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        outs.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * frac).alias(f"q{i}"))
    return agg.select(*keys, *outs)
