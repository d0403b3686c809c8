"""Holiday dates by rule, signed distances to them and kernels: expressions only, no join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 187  # fixed value: half a year and a few days


def _fixed(month: int, day: int) -> Callable[[Column], Column]:
    return lambda year: F.make_date(year, F.lit(month), F.lit(day))


def _nth(month: int, weekday: str, n: int, plus: int = 0) -> Callable[[Column], Column]:
    """n-th weekday of the month, plus some days; next_day looks strictly after its date."""

    def date(year: Column) -> Column:
        before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
        return F.date_add(F.next_day(before, weekday), 7 * (n - 1) + plus)

    return date


def _last_monday_of_may(year: Column) -> Column:
    return F.date_sub(F.next_day(F.make_date(year, F.lit(5), F.lit(31)), "Mon"), 7)


def easter(year: Column) -> Column:
    """Gregorian Easter by the century/golden-number rule."""
    y = year

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    golden = y % 19
    century = div(y, 100)
    epact = (century - div(century, 4) - div(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = epact - div(epact, 28) * (1 - div(epact, 28) * div(F.lit(29) / (epact + 1), 1) * div(21 - golden, 11))
    weekday = (y + div(y, 4) + moon + 2 - century + div(century, 4)) % 7
    offset = moon - weekday
    month = 3 + div(offset + 40, 44)
    day = offset + 28 - 31 * div(month, 4)
    return F.make_date(y, month, day)


def _easter_plus(days: int) -> Callable[[Column], Column]:
    return lambda year: F.date_add(easter(year), days)


HOLIDAYS: dict[str, Callable[[Column], Column]] = {
    "new_years_day": _fixed(1, 1),
    "martin_luther_king_day": _nth(1, "Mon", 3),
    "superbowl": _nth(2, "Sun", 1),
    "presidents_day": _nth(2, "Mon", 3),
    "good_friday": _easter_plus(-2),
    "easter_sunday": _easter_plus(0),
    "easter_monday": _easter_plus(1),
    "mothers_day": _nth(5, "Sun", 2),
    "memorial_day": _last_monday_of_may,
    "independence_day": _fixed(7, 4),
    "labor_day": _nth(9, "Mon", 1),
    "columbus_day": _nth(10, "Mon", 2),
    "thanksgiving": _nth(11, "Thu", 4),
    "black_friday": _nth(11, "Thu", 4, 1),
    "cyber_monday": _nth(11, "Thu", 4, 4),
    "christmas_eve": _fixed(12, 24),
    "christmas_day": _fixed(12, 25),
    "new_years_eve": _fixed(12, 31),
}


def distance_to_holiday(date: str, name: str) -> Column:
    """Days from the earliest such holiday within the window (negative before it)."""
    d = F.col(date).cast("date")
    dates = F.array(*[HOLIDAYS[name](F.year(d) + k) for k in (-1, 0, 1)])
    near = F.filter(dates, lambda h: F.abs(F.datediff(d, h)) <= WINDOW_DAYS)
    return F.datediff(d, F.array_min(near))


def indicator(distance: Column) -> Column:
    return (distance == 0).cast("double")


def exponential_kernel(alpha: float = 1.0, tol: float = 1e-9) -> Callable[[Column], Column]:
    def kernel(distance: Column) -> Column:
        v = F.exp(-alpha * F.abs(distance))
        return F.when(v > tol, v).otherwise(0.0)

    return kernel


def squared_exponential_kernel(alpha: float = 1.0, tol: float = 1e-9) -> Callable[[Column], Column]:
    def kernel(distance: Column) -> Column:
        v = F.exp(-alpha * distance * distance)
        return F.when(v > tol, v).otherwise(0.0)

    return kernel


def holiday_features(df: DataFrame, date: str, names: list[str], kernel: Callable[[Column], Column] = indicator) -> DataFrame:
    return df.withColumns({n: kernel(distance_to_holiday(date, n)) for n in names})
