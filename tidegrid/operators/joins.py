"""Joins of grids with prices, calendars, events and forecasts.

No broadcast is forced: Spark broadcasts a side when its measured size is under
spark.sql.autoBroadcastJoinThreshold and otherwise shuffles, with skewed partitions split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_join_keep(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that appends only columns the left side lacks."""
    new = [c for c in right.columns if c not in left.columns or c in on]
    return left.join(right.select(*new), on, "left")


def join_m1(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join that fails while running if the right side repeats a key, so rows cannot multiply."""
    others = [c for c in right.columns if c not in on]
    message = F.lit(f"repeated key in the right side of a many-to-one join on {on}")
    single = right.groupBy(*on).agg(F.first(F.struct(*others)).alias("_v"), F.count("*").alias("_n"))
    guard = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    checked = single.filter(guard).select(*on, "_v.*")
    return left.join(checked, on, how)


def left_semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def assemble_features(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Feature blocks of one grid side by side, by key and never by row position."""
    return reduce(lambda a, b: left_join_keep(a, b, on), frames)


def expand_horizon(df: DataFrame, h: int) -> DataFrame:
    """Each row for days_fwd 1..h."""
    return df.withColumn("days_fwd", F.explode(F.sequence(F.lit(1), F.lit(h))))


def join_horizon(df: DataFrame, cal: DataFrame, columns: list[str], h: int, day: str = "d") -> DataFrame:
    """Each row for days_fwd 1..h with the calendar at its base day (_d) and at the base day + days_fwd (_p). The base
    day is joined before a row becomes h."""
    base = cal.select(F.col("d").alias(day), *[F.col(c).alias(f"{c}_d") for c in columns])
    ahead = cal.select(F.col("d").alias("_t"), *[F.col(c).alias(f"{c}_p") for c in columns])
    rows = expand_horizon(df.join(base, day), h)
    return rows.withColumn("_t", F.col(day) + F.col("days_fwd")).join(ahead, "_t", "left").drop("_t")


def horizon_targets(df: DataFrame, keys: list[str], h: int, oos: bool, day: str = "d", value: str = "sales") -> DataFrame:
    """Each row for days_fwd 1..h with the target ``y`` that many days on. In sample, days without one drop out; out of
    sample it is -1.

    The next h days of a row are a frame of its series, so the rows are shuffled once, before one becomes h.
    """
    coming = Window.partitionBy(*keys).orderBy(day).rangeBetween(1, h)
    rows = df.withColumn("_a", F.collect_list(F.struct(F.col(day).alias("t"), F.col(value).alias("v"))).over(coming))
    if oos:
        rows = rows.withColumn("_m", F.map_from_entries("_a"))
        steps = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.struct(k.alias("days_fwd"), F.coalesce(F.element_at("_m", F.col(day) + k), F.lit(-1.0)).alias("y")))
    else:
        steps = F.transform("_a", lambda x: F.struct((x["t"] - F.col(day)).alias("days_fwd"), x["v"].alias("y")))
    return rows.select(*df.columns, F.inline(steps))


def event_countdown(cal: DataFrame, columns: dict[str, list[str]], k: int = 30, exact: bool = False, day: str = "d") -> DataFrame:
    """For each event name: k on the target day, falling by one per day before it, else 0; a later event wins.

    Unless ``exact``, the count is k on the day before the event (the original's row offset).
    ``columns``: event column -> its event names.
    """
    shift = 0 if exact else 1
    parts, names = [], []
    for col, events in columns.items():
        label = F.concat_ws("_", F.lit(col), F.col(col))
        days = cal.filter(F.col(col).isin(events)).select(
            label.alias("event"), F.col(day).alias("_e"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i")
        )
        parts.append(days.select("event", (F.col("_e") - shift - F.col("_i")).alias(day), "_e"))
        names += [f"{col}_{e}" for e in events]
    hits = reduce(DataFrame.unionByName, parts).groupBy(day, "event").agg(F.max("_e").alias("_e"))
    counts = hits.withColumn("v", k - (F.col("_e") - shift - F.col(day)))
    wide = counts.groupBy(day).pivot("event", names).agg(F.first("v"))
    out = cal.select(day).join(wide, day, "left").fillna(0, subset=names)
    return out.withColumn("event_sum", reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in names]))


def days_since_last_sale(df: DataFrame, keys: list[str], n: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Days since the row where the count of sales (seen n rows late) last rose; no self join."""
    order = Window.partitionBy(*keys).orderBy(day)
    sold = (F.col(value) > 0).cast("int")
    late = df.withColumn("_late", F.lag(sold, n).over(order))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = late.withColumn("_cnt", F.coalesce(F.sum("_late").over(run), F.lit(-1)))
    # the count never falls, so its first day is the last day it changed
    changed = F.when(F.coalesce(F.lag("_cnt").over(order), F.lit(-2)) != F.col("_cnt"), F.col(day))
    marked = counted.withColumn("_chg", changed)
    return marked.withColumn("last_sale", F.col(day) - F.last("_chg", ignorenulls=True).over(run)).drop(
        "_late", "_cnt", "_chg"
    )


def price_to_day(df: DataFrame, prices: DataFrame, calendar: DataFrame, how: str = "left") -> DataFrame:
    """Weekly prices on daily rows, through the calendar's week."""
    return df.join(calendar.select("d", "wm_yr_wk"), "d").join(prices, ["store_id", "item_id", "wm_yr_wk"], how)


def align_forecasts(ids: DataFrame, forecasts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One column per forecast for a list of ids: a union and one aggregate; missing ids stay null."""
    parts = [f.select(*keys, F.lit(n).alias("_m"), "forecast") for n, f in forecasts.items()]
    parts.append(ids.select(*keys, F.lit("").alias("_m"), F.lit(None).cast("double").alias("forecast")))
    stacked = reduce(DataFrame.unionByName, parts)
    named = [F.max(F.when(F.col("_m") == n, F.col("forecast"))).alias(n) for n in forecasts]
    wide = stacked.groupBy(*keys).agg(*named, F.max(F.col("_m") == "").alias("_listed"))
    return wide.filter("_listed").drop("_listed")
