"""Date, calendar and lag features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar_parts(date: str) -> dict[str, Column]:
    """Day, ISO week, month, years since the first, week of month, Monday = 0 weekday, weekend."""
    return {
        "tm_d": F.dayofmonth(date),
        "tm_w": F.weekofyear(date),
        "tm_m": F.month(date),
        "tm_y": F.year(date),
        "tm_wm": F.ceil(F.dayofmonth(date) / 7).cast("int"),
        "tm_dw": F.weekday(date),
        "tm_w_end": (F.weekday(date) >= 5).cast("int"),
    }


def with_calendar_parts(df: DataFrame, date: str) -> DataFrame:
    out = df.withColumns(calendar_parts(date))
    first = df.agg(F.min(F.year(date))).scalar()
    return out.withColumn("tm_y", F.col("tm_y") - first)


def day_group(date: str) -> Column:
    """Days 1-5 -> 1 ... 26-31 -> 6."""
    return F.least(F.lit(6), F.ceil(F.dayofmonth(date) / 5)).cast("int")


# Feature -> (column, largest index); each is value / largest - 0.5.
def _unit(ts: str) -> dict[str, tuple[Column, int]]:
    return {
        "minute_of_hour": (F.minute(ts), 59),
        "hour_of_day": (F.hour(ts), 23),
        "day_of_week": (F.weekday(ts), 6),
        "day_of_month": (F.dayofmonth(ts), 30),
        "day_of_year": (F.dayofyear(ts), 364),
        "month_of_year": (F.month(ts), 11),
        "week_of_year": (F.weekofyear(ts), 51),
    }


# Features suited to each frequency.
FREQ_FEATURES = {
    "month": ["month_of_year"],
    "week": ["day_of_month", "week_of_year"],
    "day": ["day_of_week", "day_of_month", "day_of_year"],
    "business_day": ["day_of_week", "day_of_month", "day_of_year"],
    "hour": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "minute": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
}


def time_features(df: DataFrame, ts: str, freq: str) -> DataFrame:
    """Features in about [-0.5, 0.5]. Day, month and week stay 1-based, so they can pass 0.5."""
    table = _unit(ts)
    return df.withColumns({n: table[n][0] / F.lit(float(table[n][1])) - 0.5 for n in FREQ_FEATURES[freq]})


# Calendar fields used for Fourier features per frequency.
FREQ_FOURIER = {
    "month": ["week_of_year"],
    "week": ["days_in_month", "week_of_year"],
    "day": ["day_of_week"],
    "business_day": ["day_of_week", "day_of_year"],
    "hour": ["hour_of_day", "day_of_week"],
    "minute": ["minute_of_hour", "hour_of_day", "day_of_week"],
}


def fourier_features(df: DataFrame, ts: str, freq: str) -> DataFrame:
    """cos and sin of 2 pi v / (largest v in the data + 1)."""
    table = {n: c for n, (c, _) in _unit(ts).items()}
    table["days_in_month"] = F.dayofmonth(F.last_day(ts))
    names = FREQ_FOURIER[freq]
    out = df.withColumns({f"_{n}": table[n] for n in names})
    tops = out.agg(F.struct(*[F.max(f"_{n}").alias(n) for n in names])).scalar()
    out = out.withColumn("_top", tops)
    for n in names:
        angle = 2 * math.pi * F.col(f"_{n}") / (F.col(f"_top.{n}") + 1)
        out = out.withColumns({f"{n}_cos": F.cos(angle), f"{n}_sin": F.sin(angle)})
    return out.drop("_top", *[f"_{n}" for n in names])


def _around(centre: int, delta: int) -> list[int]:
    return list(range(centre - delta, centre + delta + 1))


def lags_for(freq: str, multiple: int = 1, bound: int = 1200, limit: int | None = None) -> list[int]:
    """1..7, then the same season in earlier cycles, for minute, hour, day, week or month steps."""
    # Season -> (units per cycle, spread, cycles).
    steps = {"minute": 1, "hour": 60, "day": 60 * 24, "week": 60 * 24 * 7}
    found: set[int] = set()

    def add(unit: str, n: float) -> None:
        cycles = {"minute": (60, 2, 3), "hour": (24, 1, 7), "day": (7, 1, 4), "week": (52, 1, 3), "month": (12, 1, 3)}
        per, delta, count = cycles[unit]
        for k in range(1, count + 1):
            found.update(int(x) for x in _around(int(k * per // n), delta))
        if unit == "day":
            found.update(_around(int(30 // n), 1))
        if unit == "week":
            found.update(int(x // n) for x in (4, 8, 12))

    if freq == "month":
        add("month", multiple)
    else:
        order = ["minute", "hour", "day", "week"]
        for unit in order[order.index(freq):]:
            add(unit, multiple * steps[freq] / steps[unit])
    out = [1, 2, 3, 4, 5, 6, 7] + sorted(x for x in found if 7 < x <= bound)
    return out[:limit]


# The short lag sets used with Fourier features.
SHORT_LAGS = {"month": [1, 12], "day": [1, 7, 14], "business_day": [1, 2], "hour": [1, 24, 168], "minute": [1, 4, 12, 24, 48]}


def moon_phase(date: str) -> Column:
    """Eight-phase index from days since 2001-01-01. Phase at that day and lunations per day."""
    days = F.datediff(F.col(date).cast("date"), F.lit("2001-01-01").cast("date"))
    lunations = F.lit(0.20439731) + days * F.lit(0.03386319269)
    return F.floor(F.pmod(lunations, F.lit(1.0)) * 8 + 0.5).cast("int").bitwiseAND(7)


def cents(c: Column) -> Column:
    """Fractional part of a price."""
    return c - F.floor(c)


def event_type_columns(cal: DataFrame, types: list[str]) -> DataFrame:
    """Per event type, the name of the day's event of that type, else 'None'."""
    cols = {}
    for kind in types:
        second = F.when(F.col("event_type_2") == kind, F.col("event_name_2")).otherwise(F.lit("None"))
        cols[f"{kind.lower()}_holiday"] = F.when(F.col("event_type_1") == kind, F.col("event_name_1")).otherwise(second)
    return cal.withColumns(cols)


def snap_features(cal: DataFrame, columns: dict[str, str], width: int, day: str = "d") -> DataFrame:
    """State flags to rows, with lags 1 and 2 and the running number of the flagged day."""
    from tidegrid.operators.windows import nth_in_window

    long = cal.select(day, *[F.col(c).alias(s) for c, s in columns.items()]).unpivot([day], list(columns.values()), "state", "snap")
    w = Window.partitionBy("state").orderBy(day)
    lagged = long.withColumns({f"snap_lag_{n}": F.coalesce(F.lag("snap", n).over(w), F.lit(0)) for n in (1, 2)})
    return nth_in_window(lagged, ["state"], "snap", width, "nth_snap_day", day)


def age_feature(df: DataFrame, keys: list[str], order: str, log: bool = True) -> DataFrame:
    """log10(2 + t) or t, t counted from 0 in each series."""
    t = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("age", F.log10(t + F.lit(2.0)) if log else t.cast("double"))


def const_feature(df: DataFrame, value: float, horizon: int = 0, target: str = "target") -> DataFrame:
    """A constant for each time step of an array entry, and for the horizon."""
    return df.withColumn("feat_const", F.array_repeat(F.lit(float(value)), F.size(target) + horizon))


def log_trend(df: DataFrame, day: str = "d") -> DataFrame:
    return df.withColumn("logd", F.log1p((F.col(day) - df.agg(F.min(day)).scalar()).cast("double")))
