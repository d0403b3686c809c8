"""Small helpers shared by the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, columns: list[str], digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round computed doubles so that two engines agree on the text of a value (and on zero's sign).

    ``nudge`` moves values that sit exactly on a rounding tie off it, in both engines alike.
    """
    return df.withColumns({c: F.round(F.col(f"`{c}`") + F.lit(nudge), digits) + F.lit(0.0) for c in columns})


def rnd(expr: str, name: str, digits: int = 6, nudge: float = 0.0) -> str:
    return f"round({expr} + {nudge!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"
