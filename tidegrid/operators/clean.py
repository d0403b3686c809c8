"""Filters, masks, imputation and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.ranking import exact_quantiles


def release_filter(grid: DataFrame, prices: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Rows from the first priced week on, with ``release`` counted from the earliest one.

    ``grid`` has store_id, item_id, wm_yr_wk. With keep_rows only the column is added.
    """
    release = prices.groupBy("store_id", "item_id").agg(F.min("wm_yr_wk").alias("release"))
    first = release.agg(F.min("release")).scalar()
    out = grid.join(release, ["store_id", "item_id"], "left" if keep_rows else "inner")
    if not keep_rows:
        out = out.filter(F.col("wm_yr_wk") >= F.col("release"))
    return out.withColumn("release", F.col("release") - first)


def mask_leading_zeros(df: DataFrame, keys: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    """Zeros before a series' first sale become null."""
    run = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.coalesce(F.col(value), F.lit(0.0)) > 0).over(run)
    return df.withColumn(value, F.when(started, F.col(value)))


def first_nonzero(df: DataFrame, keys: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) != 0, F.col(day))).alias("first_day"))


def split_masks(df: DataFrame, end: Column, h: int, context: int, day: str = "d") -> DataFrame:
    """train: d <= end; valid: last h of train; predict: the future h with ``context`` days before."""
    d = F.col(day)
    return df.withColumns(
        {
            "is_train": d <= end,
            "is_valid": (d <= end) & (d > end - h),
            "is_predict": (d > end - context) & (d <= end + h),
        }
    )


def cv_windows(df: DataFrame, windows: dict[str, tuple[int, int]], day: str = "d") -> DataFrame:
    """One copy of a row per named (start, end] window it lies in. The window table is a literal: no join."""
    table = F.array(*[
        F.struct(F.lit(n).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in windows.items()
    ])
    hits = F.filter(table, lambda w: (F.col(day) > w["a"]) & (F.col(day) <= w["b"]))
    return df.withColumn("_w", F.explode(hits)).withColumn("fold", F.col("_w")["fold"]).drop("_w")


def mask_after(df: DataFrame, cut: Column, day: str = "d", value: str = "sales") -> DataFrame:
    """Null target beyond a day, so that later features cannot see it."""
    return df.withColumn(value, F.when(F.col(day) <= cut, F.col(value)))


def exclude_periods(df: DataFrame, first_days: int, months: list[int], day: str = "d", date: str = "date",
                    holidays: DataFrame | None = None) -> DataFrame:
    """Drop the start of the history, whole months and, when given, listed days."""
    out = df.filter((F.col(day) >= first_days) & ~F.month(date).isin(months))
    return out if holidays is None else out.join(holidays, day, "left_anti")


def zero_new_items(df: DataFrame, keys: list[str], n: int, day: str = "d", value: str = "sales",
                   weight: str = "weight") -> DataFrame:
    """Weight 0 in the first n observed days."""
    run = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count(value).over(run)
    return df.withColumn(weight, F.when(seen < n, F.lit(0.0)).otherwise(F.col(weight)))


def fill_constant(df: DataFrame, fills: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take the column's exact median."""
    out = df
    for c in columns:
        median = exact_quantiles(df.select(c), c, [0.5]).select("q0").scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), median))
    return out


def fill_forward(df: DataFrame, keys: list[str], columns: list[str], day: str = "d") -> DataFrame:
    run = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns})


def observed_indicator(df: DataFrame, value: str, dummy: float = 0.0) -> DataFrame:
    """1 where observed, and nulls replaced by a dummy."""
    return df.withColumn("observed", F.col(value).isNotNull().cast("int")).withColumn(
        value, F.coalesce(F.col(value), F.lit(float(dummy)))
    )


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Null stays null."""
    out = c
    if lo is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(lo)))
    if hi is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(hi)))
    return out


def clip_quantile(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Winsorise by the column's exact global quantiles."""
    bounds = exact_quantiles(df.select(value), value, [lo, hi]).select(F.struct("q0", "q1").alias("b")).scalar()
    bounded = df.withColumn("_b", bounds)
    inside = F.least(F.greatest(F.col(value), F.col("_b.q0")), F.col("_b.q1"))
    return bounded.withColumn(value, F.when(F.col(value).isNotNull(), inside)).drop("_b")


def keep_events(cal: DataFrame, name: str, lo: Column, hi: Column, day: str = "d") -> DataFrame:
    """Blank event names that never occur inside the day range."""
    seen = cal.filter((F.col(day) >= lo) & (F.col(day) <= hi) & F.col(name).isNotNull()).select(name).distinct()
    return cal.join(seen.withColumn("_seen", F.lit(True)), name, "left").withColumn(
        name, F.when(F.col("_seen"), F.col(name))
    ).drop("_seen")


def sample_series(frames: list[DataFrame], key: str, rate: float, seed: int) -> list[DataFrame]:
    """Keep the same random share of keys in every frame; the choice depends on the key alone."""
    from tidegrid.operators.forecast import uniform_draw

    chosen = frames[0].select(key).distinct().filter(uniform_draw([key], seed) < rate)
    return [f.join(chosen, key, "left_semi") for f in frames]


_INTS = [(T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31)]


def narrow_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast whole-number columns to the smallest type that holds their range (one aggregate, one row read back)."""
    whole = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)) and (columns is None or f.name in columns)
    ]
    if not whole:
        return df
    row = df.agg(*[x for c in whole for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))]).first()
    casts = {}
    for c in whole:
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        for kind, bits in _INTS:
            if lo is not None and -(1 << bits) <= lo and hi < (1 << bits):
                casts[c] = F.col(c).cast(kind)
                break
    return df.withColumns(casts) if casts else df
