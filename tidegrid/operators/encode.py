"""Group statistics, encodings and diagnostics.

Group values come from an aggregate joined back (partial sums make a hot group cheap),
not from a window over the group, which would put the group in one task. Windows are
used only where a partition is bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.ranking import global_position
from tidegrid.session import cut_lineage


def price_stats(prices: DataFrame, keys: list[str], price: str = "sell_price") -> DataFrame:
    stats = prices.groupBy(*keys).agg(
        F.max(price).alias("price_max"), F.min(price).alias("price_min"),
        F.stddev_samp(price).alias("price_std"), F.avg(price).alias("price_mean"),
    )
    return prices.join(stats, keys).withColumn("price_norm", F.try_divide(F.col(price), F.col("price_max")))


def price_counts(prices: DataFrame, price: str = "sell_price") -> DataFrame:
    """Distinct prices of an item in a store, and distinct items at the same price in a store."""
    per_item = prices.groupBy("store_id", "item_id").agg(F.countDistinct(price).alias("price_nunique"))
    per_price = prices.groupBy("store_id", price).agg(F.countDistinct("item_id").alias("item_nunique"))
    return prices.join(per_item, ["store_id", "item_id"]).join(per_price, ["store_id", price])


def price_momentum(prices: DataFrame, weeks: DataFrame, price: str = "sell_price") -> DataFrame:
    """Ratio to the previous row, to the mean of the calendar month (across years) and of the year."""
    rows = prices.join(weeks, "wm_yr_wk", "left")
    item = ["store_id", "item_id"]
    order = Window.partitionBy(*item).orderBy("wm_yr_wk")
    p = F.col(price)
    return rows.withColumns(
        {
            "price_momentum": F.try_divide(p, F.lag(price).over(order)),
            "price_momentum_m": F.try_divide(p, F.avg(price).over(Window.partitionBy(*item, "month"))),
            "price_momentum_y": F.try_divide(p, F.avg(price).over(Window.partitionBy(*item, "year"))),
        }
    ).drop("month", "year")


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def _mean_std(n: Column, s: Column, s2: Column) -> tuple[Column, Column]:
    mean = F.try_divide(s, n)
    var = F.when(n > 1, F.greatest(F.lit(0.0), (s2 - s * s / n) / (n - 1)))
    return mean, F.sqrt(var)


def target_encode(df: DataFrame, groups: list[list[str]], keys: list[str], train: Column, value: str = "sales",
                  on: list[str] | None = None) -> DataFrame:
    """Mean and sample std of the training target per group, on every row. ``on``: columns among ``keys`` that determine
    the others, which the large join then uses alone.

    All groups are functions of ``keys``, so the big table is read once for count, mean and
    squared deviations per key, every group is derived from that small checkpointed table, and
    one join puts all columns back. Means are taken less the mean of all, so a large common
    level costs no digits.
    """
    y = F.when(train, F.col(value))
    table = cut_lineage(
        df.groupBy(*keys).agg(F.count(y).alias("_n"), F.avg(y).alias("_mean"), (F.var_pop(y) * F.count(y)).alias("_m2"))
    )
    level = table.agg(F.try_divide(F.sum(F.col("_mean") * F.col("_n")), F.sum("_n"))).scalar()
    table = table.withColumn("_c", level).select(
        *keys, "_n", "_c", ((F.col("_mean") - F.col("_c")) * F.col("_n")).alias("_s"),
        (F.col("_m2") + (F.col("_mean") - F.col("_c")) * (F.col("_mean") - F.col("_c")) * F.col("_n")).alias("_q"),
    )
    out = table
    for group in groups:
        name = "_".join(group)
        sums = table.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.sum("_q").alias("q"), F.first("_c").alias("c"))
        mean, std = _mean_std(F.col("n"), F.col("s"), F.col("q"))
        mean = mean + F.col("c")
        out = out.join(sums.select(*group, mean.alias(f"enc_{name}_mean"), std.alias(f"enc_{name}_std")), group)
    on = on or keys
    return df.join(out.drop("_n", "_s", "_q", "_c", *(k for k in keys if k not in on)), on)


def encode_by(df: DataFrame, col: str, by: str, train: Column, value: str = "sales") -> DataFrame:
    stats = df.filter(train).groupBy(col, by).agg(
        F.avg(value).alias(f"enc_{col}_{by}_mean"), F.stddev_samp(value).alias(f"enc_{col}_{by}_std")
    )
    return df.join(stats, [col, by], "left")


def divide_by_group(df: DataFrame, group: list[str], value: str = "sales", name: str = "scaled") -> DataFrame:
    """Value over the group's mean (a missing mean counts 1)."""
    means = df.groupBy(*group).agg(F.coalesce(F.avg(value), F.lit(1.0)).alias("_g"))
    return df.join(means, group).withColumn(name, F.try_divide(F.col(value), F.col("_g"))).drop("_g")


def divide_by_total(df: DataFrame, day: str = "d", value: str = "sales", name: str = "scaled") -> DataFrame:
    """Value over the day's total relative to the mean daily total."""
    daily = df.groupBy(day).agg(F.sum(value).alias("_t"))
    mean = daily.agg(F.avg("_t")).scalar()
    return df.join(daily, day).withColumn(name, F.try_divide(F.col(value), F.col("_t") / mean)).drop("_t")


def between_store_std(df: DataFrame, item: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    """Sample std over stores of an item's sales per day."""
    return df.groupBy(*item, day).agg(F.stddev_samp(value).alias("store_std"), F.count("*").alias("stores"))


def trailing_weights(df: DataFrame, keys: list[str], level: list[str], span: int, day: str = "d", value: str = "revenue") -> DataFrame:
    """Trailing-span revenue of a series over that of its level on the same day."""
    frame = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(span - 1), 0)
    rows = df.withColumn("trailing", F.sum(value).over(frame))
    totals = rows.groupBy(*level, day).agg(F.sum("trailing").alias("_t"))
    return rows.join(totals, [*level, day]).withColumn("weight", F.try_divide(F.col("trailing"), F.col("_t"))).drop("_t")


def dataset_stats(df: DataFrame, keys: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    """Size, range and shape of a panel, in one pass over per-series sums."""
    v = F.col(value)
    per = df.groupBy(*keys).agg(
        F.count("*").alias("len"), F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(F.abs(v)).alias("a"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(v == F.floor(v)).alias("whole"),
    )
    return per.agg(
        F.count("*").alias("num_series"),
        F.sum("len").alias("num_observations"),
        F.sum(F.col("len") - F.col("n")).alias("num_missing"),
        F.min("lo").alias("min_target"),
        F.max("hi").alias("max_target"),
        F.try_divide(F.sum("s"), F.sum("n")).alias("mean_target"),
        F.try_divide(F.sum("a"), F.sum("n")).alias("mean_abs_target"),
        F.min("whole").alias("integer_target"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        F.avg("len").alias("mean_length"),
    )


def scale_bucket(mean_abs: Column, base: float = 2.0) -> Column:
    return F.floor(F.log(mean_abs + 1) / F.lit(math.log(base)) + 1e-12).cast("int")


def scale_histogram(df: DataFrame, keys: list[str], base: float = 2.0, value: str = "sales") -> DataFrame:
    """Series per bucket int(log_base(mean |x| + 1)); series without a value go to bucket null."""
    per = df.groupBy(*keys).agg(F.avg(F.abs(value)).alias("_m"))
    return per.groupBy(scale_bucket(F.col("_m"), base).alias("bucket")).agg(F.count("*").alias("series"))


def bias_factors(actual: DataFrame, forecast: DataFrame, keys: list[str], day: str = "d") -> DataFrame:
    """Mean of daily mean actuals over mean of daily mean forecasts, per group."""

    def mean(df: DataFrame, c: str, out: str) -> DataFrame:
        daily = df.groupBy(*keys, day).agg(F.avg(c).alias("_m"))
        return daily.groupBy(*keys).agg(F.avg("_m").alias(out))

    both = mean(actual, "sales", "_a").join(mean(forecast, "forecast", "_f"), keys)
    return both.select(*keys, F.try_divide(F.col("_a"), F.col("_f")).alias("factor"))


def agg_importance(df: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    return (
        df.groupBy(feature)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("groups"))
        .orderBy(F.desc("mean"), feature)
    )


def mean_predictions(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values], F.count("*").alias("ct"))


def n_unique(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct count per column, one row per column."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    wide = df.agg(*[count(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "n_unique")


def mean_by_event(df: DataFrame, cal: DataFrame, columns: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    """Mean daily total by each calendar column's value."""
    daily = df.groupBy(day).agg(F.sum(value).alias("total")).join(cal, day)
    long = daily.select(
        "total", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in columns])).alias("_k")
    )
    return long.groupBy(F.col("_k.kind").alias("kind"), F.col("_k.name").alias("name")).agg(
        F.avg("total").alias("mean_total"), F.count("*").alias("days")
    )


def encode_ordinal(df: DataFrame, col: str, out: str) -> DataFrame:
    """Code 0..k-1 in the order of the sorted distinct values; null becomes 0 and shifts the rest by one."""
    codes = global_position(df.select(col).distinct().filter(F.col(col).isNotNull()), [col], name=out)
    has_null = df.agg(F.max(F.col(col).isNull().cast("int"))).scalar()
    return (
        df.join(codes.withColumn(out, F.col(out) - 1), col, "left")
        .withColumn(out, (F.coalesce(F.col(out), F.lit(-1)) + has_null).cast("int"))
    )


def one_hot(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.withColumns({f"{col}_{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in values})


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def every_kth(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """Every k-th row by falling weight."""
    return global_position(df, [F.desc(by), tie], name="_pos").filter((F.col("_pos") - 1) % k == 0).drop("_pos")


def sort_panel(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)


def check_ids(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Missing, unexpected and common ids; one aggregate over the union of both sides."""
    both = found.select(key, F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(
        expected.select(key, F.lit(0).alias("f"), F.lit(1).alias("e"))
    ).groupBy(key).agg(F.max("f").alias("f"), F.max("e").alias("e"))
    return both.agg(
        F.sum(F.when((F.col("e") == 1) & (F.col("f") == 0), 1).otherwise(0)).alias("missing"),
        F.sum(F.when((F.col("f") == 1) & (F.col("e") == 0), 1).otherwise(0)).alias("unexpected"),
        F.sum(F.col("f") * F.col("e")).alias("common"),
    )
