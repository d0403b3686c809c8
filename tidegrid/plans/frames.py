"""Forecasts and evaluation frames shared by several queries (same as the SQL views fc7, hist, fcm, ev, serr)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators.metrics import seasonal_error_observed
from tidegrid.plans.flagship import HORIZON, naive_forecast
from tidegrid.sources.retail import SERIES

QCOLS = {0.1: "q10", 0.5: "q50", 0.9: "q90"}


def cut_day(t):
    return t.staged.last_day - HORIZON


def fc7(t):
    return naive_forecast(t)


def history(t):
    """The last 28 training days of every series."""
    cut = cut_day(t)
    return t.staged.grid_between(cut - HORIZON, cut)


def hist(t):
    return history(t).groupBy(*SERIES).agg(
        F.avg("sales").alias("mean"), *[F.percentile("sales", q).alias(c) for q, c in QCOLS.items()]
    )


def fcm(t):
    steps = F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("step")
    return history(t).groupBy(*SERIES).agg(F.avg("sales").alias("forecast")).select(*SERIES, steps, "forecast")


def actuals(t):
    """The held-out days; a series' rows start at its first sale."""
    cut = cut_day(t)
    return t.staged.grid_between(cut, cut + HORIZON).select(
        *SERIES, (F.col("d") - cut).alias("step"), F.col("sales").alias("y")
    )


def ev(t):
    return (
        actuals(t)
        .join(fc7(t).select("id", "step", "forecast"), ["id", "step"])
        .join(hist(t).select("id", "mean", *QCOLS.values()), "id")
    )


def serr(t):
    return seasonal_error_observed(t.staged.panel, ["id"], 7, cut_day(t))
