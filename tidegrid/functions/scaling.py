"""Scaling and distribution transforms with their inverses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.normal import normal_cdf, normal_ppf


def minmax_fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's range."""
    return train.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])


def minmax_apply(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """(x - lo) / (hi - lo); a constant column gives x - lo."""
    out = df.withColumn("_f", fit.select(F.struct(*fit.columns)).scalar())
    cols = {}
    for c in columns:
        lo, hi = F.col(f"_f.{c}__lo"), F.col(f"_f.{c}__hi")
        cols[c] = (F.col(c) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return out.withColumns(cols).drop("_f")


def mean_scale(df: DataFrame, keys: list[str], value: str, floor: float = 1e-10) -> DataFrame:
    """Per series mean |x| over observed rows; the global mean for series without a non-zero value."""
    per = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.coalesce(F.sum(F.abs(value)), F.lit(0.0)).alias("_s"))
    default = per.agg(F.sum("_s") / F.greatest(F.sum("_n"), F.lit(1))).scalar()
    scale = F.when(F.col("_s") > 0, F.col("_s") / F.col("_n")).otherwise(default)
    return per.select(*keys, F.greatest(scale, F.lit(floor)).alias("scale"))


def apply_scale(df: DataFrame, scale: DataFrame, keys: list[str], value: str, out: str, clip: float | None = None) -> DataFrame:
    x = F.col(value) / F.col("scale")
    if clip is not None:
        x = F.when(F.col(value).isNotNull(), F.least(F.greatest(x, F.lit(-clip)), F.lit(clip)))
    return df.join(scale, keys).withColumn(out, x)


def unscale(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) * F.col("scale"))


def boxcox(x: Column, lam1: float, lam2: float = 0.0) -> Column:
    z = x + lam2
    return F.log(z) if abs(lam1) < 1e-12 else (F.pow(z, F.lit(lam1)) - 1) / lam1


def boxcox_inverse(y: Column, lam1: float, lam2: float = 0.0) -> Column:
    if abs(lam1) < 1e-12:
        return F.exp(y) - lam2
    return F.pow(F.greatest(y * lam1 + 1, F.lit(0.0)), F.lit(1.0 / lam1)) - lam2


def scale_by_vol(df: DataFrame, columns: list[str], vol: str, sentinel: float = -10.0) -> DataFrame:
    """Divide by the volatility where it is positive; the sentinel for missing stays."""
    return df.withColumns(
        {c: F.when(F.col(c) == sentinel, F.col(c)).otherwise(F.try_divide(F.col(c), F.col(vol))) for c in columns}
    )


def add_noise(df: DataFrame, columns: dict[str, float], keys: list[str], seed: int) -> DataFrame:
    """Add N(0, sigma) fixed by the row's keys."""
    from tidegrid.operators.forecast import normal_draw

    return df.withColumns(
        {c: F.col(c) + sigma * normal_draw(keys, seed + 2 * i) for i, (c, sigma) in enumerate(columns.items())}
    )


def scale_noise(df: DataFrame, columns: dict[str, float], keys: list[str], seed: int) -> DataFrame:
    """Multiply by exp(range x N(0, 0.5)), fixed by the row's keys: signs and zeros stay."""
    from tidegrid.operators.forecast import normal_draw

    return df.withColumns(
        {c: F.col(c) * F.exp(spread * 0.5 * normal_draw(keys, seed + 2 * i)) for i, (c, spread) in enumerate(columns.items())}
    )


def cdf_transform(history: DataFrame, new: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """Values to normal scores through each series' piecewise-linear empirical CDF.

    The CDF value of a row follows from how many history values lie below it and equal it,
    and from its two neighbours, so one window over the distinct values does the lookup.
    Shares are winsorised at 1 / (4 m^(1/4) sqrt(3.14 ln m)).
    """
    parts = history.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_h"))
    if new is not None:
        parts = parts.unionByName(new.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_h")))
    distinct = parts.groupBy(*keys, "_v").agg(F.sum("_h").alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_v")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    seen = F.when(F.col("_c") > 0, F.col("_v"))
    table = distinct.select(
        *keys, "_v", "_c",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_left"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_m"),
        F.last(seen, ignorenulls=True).over(before).alias("_lo"),
        F.first(seen, ignorenulls=True).over(after).alias("_hi") if new is not None else F.lit(None).cast("double").alias("_hi"),
    )
    m = F.col("_m").cast("double")
    between = (F.col("_left") - 1) / m + F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) / m
    share = (
        F.when((F.col("_left") == 0) & (F.col("_c") <= 1), F.lit(0.0))
        .when(F.col("_c") == 1, F.col("_left") / m)
        .when(F.col("_c") > 1, (F.col("_left") + F.floor(F.col("_c") / 2) - 1) / m)
        .when(F.col("_left") == F.col("_m"), (m - 1) / m)
        .otherwise(between)
    )
    cut = F.try_divide(F.lit(1.0), 4 * F.pow(m, F.lit(0.25)) * F.sqrt(3.14 * F.log(m)))
    table = table.withColumn("cdf", F.least(F.greatest(share, cut), 1 - cut))
    scored = table.select(*keys, F.col("_v").alias(value), "cdf", normal_ppf(F.col("cdf")).alias("score"))
    target = new if new is not None else history
    return target.join(scored, [*keys, value])


def cdf_inverse(history: DataFrame, scores: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """Normal scores back to values on each series' sorted history (bounded by its days)."""
    sorted_values = history.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_x"))
    joined = scores.join(sorted_values, keys)
    m = F.size("_x")
    pos = normal_cdf(F.col(score)) * m
    i = F.least(F.greatest(F.floor(pos).cast("int"), F.lit(0)), m - 1)
    low = F.element_at("_x", i + 1)
    high = F.element_at("_x", F.least(i + 2, m))
    return joined.withColumn(value, low + (high - low) * F.least(F.greatest(pos - i, F.lit(0.0)), F.lit(1.0))).drop("_x")


# --- array-entry field helpers ---------------------------------------------------------

def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def set_field(df: DataFrame, name: str, value: Column, only_if_absent: bool = False) -> DataFrame:
    if name not in df.columns:
        return df.withColumn(name, value)
    return df.withColumn(name, F.coalesce(F.col(name), value) if only_if_absent else value)


def select_fields(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def stack_fields(df: DataFrame, fields: list[str], out: str) -> DataFrame:
    """Several time arrays as rows of one matrix; empty inputs are left out; inputs are dropped."""
    return df.withColumn(out, F.filter(F.array(*fields), lambda a: F.size(a) > 0)).drop(*[f for f in fields if f != out])


def concat_fields(df: DataFrame, fields: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.concat(*fields)).drop(*[f for f in fields if f != out])


def expand_dims(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn(field, F.array(field))


def add_dim_index(df: DataFrame, matrix: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sequence(F.lit(0), F.size(matrix) - 1))


def normal_limit(m: int) -> float:
    """The winsorising share for a history of m values."""
    return 1 / (4 * m ** 0.25 * math.sqrt(3.14 * math.log(m)))
