"""Multi-level rollups of the bottom series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["state_id", "store_id", "cat_id", "dept_id", "item_id"]

# Level number -> grouping keys.
LEVELS: dict[int, list[str]] = {
    1: [],
    2: ["state_id"],
    3: ["store_id"],
    4: ["cat_id"],
    5: ["dept_id"],
    6: ["state_id", "cat_id"],
    7: ["state_id", "dept_id"],
    8: ["store_id", "cat_id"],
    9: ["store_id", "dept_id"],
    10: ["item_id"],
    11: ["state_id", "item_id"],
    12: ["item_id", "store_id"],
}

# Keys that follow from a kept key.
PARENTS = {"item_id": ["dept_id", "cat_id"], "dept_id": ["cat_id"], "store_id": ["state_id"]}

TOP_LEVELS = [1, 2, 3, 4, 5]


def _gid(kept: list[str], keys: list[str]) -> int:
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in kept)


def with_parents(kept: list[str]) -> list[str]:
    implied = {p for k in kept for p in PARENTS.get(k, [])}
    return [k for k in KEYS if k in kept or k in implied]


# The mid levels every other level can be summed from.
SOURCES = {12: [12], 11: [11, 10], 9: [9, 8, 7, 6, 5, 4, 3, 2, 1]}


def rollup_hierarchy(
    df: DataFrame,
    sums: list[str],
    by: list[str] | None = None,
    levels: list[int] | None = None,
    parents: bool = False,
) -> DataFrame:
    """Sums of ``sums`` at every level, per ``by`` (for example the day).

    Two steps instead of one copy of every bottom row per level: grouping sets make
    item x store, item x state and department x store; the small ones feed the rest.
    ``grouping_id`` and the level number tell a level from a null key. With ``parents``
    a level keeps the keys implied by its own ones.
    """
    by = by or []
    levels = levels or list(LEVELS)
    steps = {src: [lv for lv in outs if lv in levels] for src, outs in SOURCES.items()}
    steps = {src: outs for src, outs in steps.items() if outs}
    kept = {src: with_parents(LEVELS[src]) for src in steps}
    sets = [[F.col(c) for c in [*kept[src], *by]] for src in steps]
    first = df.groupingSets(sets, *KEYS, *by).agg(
        *[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("_gid")
    )
    outs = F.lit(None).cast("array<int>")
    for src, targets in steps.items():
        hit = F.col("_gid") == _gid(kept[src], KEYS) * (1 << len(by))
        outs = F.when(hit, F.array(*[F.lit(lv) for lv in targets])).otherwise(outs)
    spread = first.select(*KEYS, *by, *sums, F.explode(outs).alias("level"))
    masked = []
    for key in KEYS:
        having = [lv for lv in levels if key in (with_parents(LEVELS[lv]) if parents else LEVELS[lv])]
        masked.append(F.when(F.col("level").isin(having), F.col(key)).alias(key) if having else F.lit(None).cast("string").alias(key))
    return (
        spread.select("level", *masked, *by, *sums)
        .groupBy("level", *KEYS, *by)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def level_series_id(levels: list[int] | None = None):
    """Name of a rolled-up series: Total_X, key_X or key1_key2 in the order of LEVELS."""
    name = F.lit(None).cast("string")
    for lv in levels or list(LEVELS):
        cols = LEVELS[lv]
        if not cols:
            made = F.lit("Total_X")
        elif len(cols) == 1:
            made = F.concat_ws("_", F.col(cols[0]), F.lit("X"))
        else:
            made = F.concat_ws("_", *cols)
        name = F.when(F.col("level") == lv, made).otherwise(name)
    return name


def label_levels(df: DataFrame) -> DataFrame:
    """Name each rolled-up series and write 'All' for keys outside its level."""
    named = df.withColumn("series", level_series_id())
    return named.withColumns({k: F.coalesce(F.col(k), F.lit("All")) for k in KEYS})


def rollup_top(df: DataFrame, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """The five top blocks under one id column."""
    rolled = rollup_hierarchy(df, sums, by, TOP_LEVELS)
    name = F.coalesce(F.lit(None).cast("string"), *[F.col(k) for k in KEYS], F.lit("all"))
    return rolled.select(name.alias("id_str"), *(by or []), *sums)


def level_scale(df: DataFrame) -> DataFrame:
    """Series count of each level over the count at the bottom; one row per level."""
    series = rollup_hierarchy(df.select(*KEYS).distinct().withColumn("n", F.lit(1)), ["n"])
    counts = series.groupBy("level").agg(F.count("*").alias("series_count"))
    bottom = counts.filter(F.col("level") == max(LEVELS)).select("series_count").scalar()
    return counts.withColumn("multiplier", F.col("series_count") / bottom)
