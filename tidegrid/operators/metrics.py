"""Point, scaled and quantile accuracy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.hierarchy import KEYS, rollup_hierarchy


def mean_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)


def zero_if_flat(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


def naive_scale(df: DataFrame, keys: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    """Mean squared one-step change from the first non-zero day."""
    order = Window.partitionBy(*keys).orderBy(day)
    started = F.max(F.col(value) != 0).over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = F.col(value) - F.lag(value).over(order)
    rows = df.select(*keys, F.when(started, step * step).alias("_sq"))
    return rows.groupBy(*keys).agg(F.avg("_sq").alias("scale"))


def rmsse(df: DataFrame, scale: DataFrame, keys: list[str], rooted: bool = True) -> DataFrame:
    """``df``: keys, y, forecast. A zero scale gives null."""
    mse = df.groupBy(*keys).agg(F.avg(F.pow(F.col("y") - F.col("forecast"), F.lit(2.0))).alias("_mse"))
    ratio = F.try_divide(F.col("_mse"), F.col("scale"))
    return mse.join(scale, keys).select(*keys, (F.sqrt(ratio) if rooted else ratio).alias("rmsse"))


def wrmsse_levels(sales: DataFrame, forecast: DataFrame, revenue: DataFrame, train_end: Column, horizon: int = 28) -> DataFrame:
    """Weighted scaled error per level (12 rows). Infinite ratios are dropped.

    ``sales``: keys, d, sales, where days without a row count 0 (a dense grid works too);
    ``forecast``: keys, step, forecast; ``revenue``: keys, revenue. The three are stacked, not
    joined: sums merge them at every level.

    Nothing is densified. The squared steps of a gap-free series follow from its non-zero
    days: a step from the day before, or a fall to 0 and a rise from 0 across a gap.
    """
    zero = F.lit(0.0)
    stacked = (
        sales.filter("sales != 0").select(*KEYS, "d", "sales", zero.alias("fc"), zero.alias("revenue"))
        .unionByName(
            forecast.select(
                *KEYS, (F.col("step") + train_end).cast("int").alias("d"), zero.alias("sales"),
                F.col("forecast").alias("fc"), zero.alias("revenue"),
            )
        )
        .unionByName(
            revenue.select(*KEYS, train_end.cast("int").alias("d"), zero.alias("sales"), zero.alias("fc"), "revenue")
        )
    )
    rolled = rollup_hierarchy(stacked, ["sales", "fc", "revenue"], ["d"])
    series = ["level", *KEYS]
    order = Window.partitionBy(*series).orderBy("d")
    x, before = F.col("sales"), F.lag("sales").over(order)
    square = lambda c: c * c
    steps = F.when(F.col("d") - F.lag("d").over(order) == 1, square(x - before)).otherwise(square(x) + square(before))
    rows = rolled.withColumns({"_steps": steps, "_end": train_end})
    trained = F.col("d") <= F.col("_end")
    past_day = F.when(trained, F.col("d"))
    per_series = rows.groupBy(*series).agg(
        F.sum(F.when(trained, F.col("_steps"))).alias("_sum"),
        F.min(past_day).alias("_first"),
        F.max(past_day).alias("_last"),
        F.max_by("sales", past_day).alias("_x"),
        F.first("_end").alias("_end"),
        F.sum(F.when(~trained, square(F.col("sales") - F.col("fc")))).alias("_se"),
        F.sum("revenue").alias("revenue"),
    )
    fall = F.when(F.col("_last") < F.col("_end"), square(F.col("_x"))).otherwise(0.0)
    scale = F.try_divide(F.coalesce("_sum", F.lit(0.0)) + fall, F.col("_end") - F.col("_first"))
    mse = F.coalesce("_se", F.lit(0.0)) / horizon
    score = F.sqrt(F.try_divide(mse, scale))
    scored = per_series.withColumn("_score", score)
    return scored.groupBy("level").agg(
        F.count("*").alias("series"),
        F.try_divide(F.sum(F.col("revenue") * F.col("_score")), F.sum("revenue")).alias("wrmsse"),
    )


def recent_revenue(panel: DataFrame, prices: DataFrame, calendar: DataFrame, end: Column, span: int = 28) -> DataFrame:
    """Units x weekly price over the last ``span`` days, per bottom series."""
    inside = (F.col("d") > end - span) & (F.col("d") <= end)
    days = calendar.select("d", "wm_yr_wk").filter(inside)
    # prices of other weeks are not made
    weeks = [days.agg(f("wm_yr_wk")).scalar() for f in (F.min, F.max)]
    return (
        panel.filter(inside & (F.col("sales") > 0)).join(days, "d")
        .join(prices.filter(F.col("wm_yr_wk").between(*weeks)), ["store_id", "item_id", "wm_yr_wk"])
        .groupBy(*KEYS)
        .agg(F.sum(F.col("sales") * F.col("sell_price")).alias("revenue"))
    )


def revenue_shares(revenue: DataFrame) -> DataFrame:
    """Share of each series in its level's revenue."""
    rolled = rollup_hierarchy(revenue, ["revenue"])
    totals = rolled.groupBy("level").agg(F.sum("revenue").alias("_t"))
    return rolled.join(totals, "level").withColumn("weight", F.try_divide(F.col("revenue"), F.col("_t"))).drop("_t")


def seasonal_error(df: DataFrame, keys: list[str], m: int, day: str = "d", value: str = "sales") -> DataFrame:
    """mean |y_t - y_{t-m}|, with m = 1 for series no longer than m."""
    order = Window.partitionBy(*keys).orderBy(day)
    rows = df.select(
        *keys,
        F.abs(F.col(value) - F.lag(value, m).over(order)).alias("_m"),
        F.abs(F.col(value) - F.lag(value, 1).over(order)).alias("_1"),
    )
    return rows.groupBy(*keys).agg(
        F.when(F.count("*") > m, F.avg("_m")).otherwise(F.avg("_1")).alias("seasonal_error")
    )


def seasonal_error_observed(df: DataFrame, keys: list[str], m: int, end: Column | int, day: str = "d", value: str = "sales") -> DataFrame:
    """``seasonal_error`` of the gap-free series from each one's first row up to day ``end``, from the observed rows alone
    (absent days are 0).

    Each row counts on its own day and, negative, a season later; a day on which only one of the two falls adds its
    size. So the work follows the rows and not the days. One shuffle by series.
    """
    first = F.min(day).over(Window.partitionBy(*keys))
    rows = df.filter(F.col(day) <= end).select(*keys, F.col(day).alias("_d"), F.col(value).alias("_v"), first.alias("_f"))
    rows = rows.withColumn("_n", F.lit(end) - F.col("_f") + 1 if isinstance(end, int) else end - F.col("_f") + 1)
    lag = F.when(F.col("_n") > m, m).otherwise(1)
    sides = F.explode(F.array(F.struct(F.col("_d").alias("t"), F.col("_v").alias("v")), F.struct((F.col("_d") + lag).alias("t"), (-F.col("_v")).alias("v"))))
    spread = rows.select(*keys, "_f", "_n", lag.alias("_m"), sides.alias("_s"))
    inside = spread.filter(F.col("_s.t") < F.col("_f") + F.col("_n"))
    steps = inside.groupBy(*keys, F.col("_s.t").alias("_t"), "_f", "_n", "_m").agg(F.abs(F.sum("_s.v")).alias("_e"))
    total = F.sum(F.when(F.col("_t") >= F.col("_f") + F.col("_m"), F.col("_e")).otherwise(0))
    per = steps.groupBy(*keys).agg(total.alias("_e"), F.max(F.col("_n") - F.col("_m")).alias("_c"))
    return per.select(*keys, F.when(F.col("_c") > 0, F.col("_e") / F.col("_c")).alias("seasonal_error"))


def pinball(y: Column, f: Column, q: float | Column) -> Column:
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    return F.when(y >= f, q * (y - f)).otherwise((1 - q) * (f - y))


def quantile_terms(y: Column, f: Column, q: float) -> Column:
    return 2.0 * F.abs((f - y) * ((y <= f).cast("double") - q))


def evaluate(df: DataFrame, errors: DataFrame, keys: list[str], qcols: dict[float, str], median: str, mean: str,
             alpha: float = 0.05) -> DataFrame:
    """All per-series metrics in one aggregate. ``df``: keys, y, mean, quantile columns."""
    y, med = F.col("y"), F.col(median)
    ae = F.abs(y - med)
    qs = sorted(qcols)
    low = F.col(qcols[min(qs, key=lambda q: abs(q - alpha / 2))])
    high = F.col(qcols[min(reversed(qs), key=lambda q: abs(q - (1 - alpha / 2)))])
    band = (
        high - low
        + F.when(y < low, 2.0 / alpha * (low - y)).otherwise(0.0)
        + F.when(y > high, 2.0 / alpha * (y - high)).otherwise(0.0)
    )
    per = df.groupBy(*keys).agg(
        F.avg(F.pow(y - F.col(mean), F.lit(2.0))).alias("mse"),
        F.sum(ae).alias("abs_error"),
        F.sum(F.abs(y)).alias("abs_target_sum"),
        F.avg(F.abs(y)).alias("abs_target_mean"),
        F.avg(zero_if_flat(ae, F.abs(y))).alias("mape"),
        (2 * F.avg(zero_if_flat(ae, F.abs(y) + F.abs(med)))).alias("smape"),
        F.avg(ae).alias("_mae"),
        F.avg(band).alias("_band"),
        *[F.sum(quantile_terms(y, F.col(c), q)).alias(f"ql_{c}") for q, c in qcols.items()],
        *[F.avg((y < F.col(c)).cast("double")).alias(f"cov_{c}") for c in qcols.values()],
    )
    out = per.join(errors, keys)
    return (
        out.withColumn("mase", zero_if_flat(F.col("_mae"), F.col("seasonal_error")))
        .withColumn("msis", zero_if_flat(F.col("_band"), F.col("seasonal_error")))
        .drop("_mae", "_band")
    )


def aggregate_metrics(per: DataFrame, qcols: dict[float, str], by: list[str] | None = None) -> DataFrame:
    """Totals over series: sums, means and the ratios built from them."""
    avg = ["mse", "abs_target_mean", "seasonal_error", "mase", "mape", "smape", "msis"]
    agg = per.groupBy(*(by or [])).agg(
        *[F.avg(c).alias(c) for c in avg],
        F.sum("abs_error").alias("abs_error"),
        F.sum("abs_target_sum").alias("abs_target_sum"),
        *[F.sum(f"ql_{c}").alias(f"ql_{c}") for c in qcols.values()],
        *[F.avg(f"cov_{c}").alias(f"cov_{c}") for c in qcols.values()],
    )
    agg = agg.withColumns(
        {
            "rmse": F.sqrt("mse"),
            "nrmse": zero_if_flat(F.sqrt("mse"), F.col("abs_target_mean")),
            "nd": zero_if_flat(F.col("abs_error"), F.col("abs_target_sum")),
            **{f"wql_{c}": F.try_divide(F.col(f"ql_{c}"), F.col("abs_target_sum")) for c in qcols.values()},
        }
    )
    return agg.withColumns(
        {
            "mean_wql": mean_of([F.col(f"wql_{c}") for c in qcols.values()]),
            "mae_coverage": mean_of([F.abs(F.col(f"cov_{c}") - q) for q, c in qcols.items()]),
        }
    )


def owa(df: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Half of sMAPE and MASE relative to the season-adjusted naive. ``df``: keys, y, forecast, naive."""
    y = F.col("y")

    def smape(f: str) -> Column:
        return 2 * F.avg(zero_if_flat(F.abs(y - F.col(f)), F.abs(y) + F.abs(F.col(f))))

    per = df.groupBy(*keys).agg(
        smape("forecast").alias("_s"), smape("naive").alias("_sn"),
        F.avg(F.abs(y - F.col("forecast"))).alias("_a"), F.avg(F.abs(y - F.col("naive"))).alias("_an"),
    ).join(errors, keys)
    mase = zero_if_flat(F.col("_a"), F.col("seasonal_error"))
    mase_n = zero_if_flat(F.col("_an"), F.col("seasonal_error"))
    return per.select(
        *keys, (0.5 * (F.try_divide(F.col("_s"), F.col("_sn")) + F.try_divide(mase, mase_n))).alias("owa")
    )


def wspl(df: DataFrame, by: list[str], weight: str = "weight", scale: str = "vol") -> DataFrame:
    """mean(w * pinball / scale) / mean(w). ``df``: by, y, value, q, weight, scale."""
    loss = F.col(weight) * F.try_divide(pinball(F.col("y"), F.col("value"), F.col("q")), F.col(scale))
    return df.groupBy(*by).agg(F.try_divide(F.avg(loss), F.avg(weight)).alias("wspl"))


def loss_columns(df: DataFrame, qcols: dict[float, str], count: str) -> DataFrame:
    """Per-row loss for each quantile, their sum, and the sum times the replicate count."""
    losses = {f"loss_{c}": pinball(F.col("y"), F.col(c), q) for q, c in qcols.items()}
    out = df.withColumns(losses)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in losses])
    return out.withColumn("loss_sum", total).withColumn("loss_weighted", F.col("loss_sum") * F.col(count))


def training_losses(df: DataFrame, whole: DataFrame, keys: list[str], horizon: int, m: int, day: str = "d", value: str = "sales") -> DataFrame:
    """sMAPE and MAPE times 100/H over the mean of the horizon, and MASE. ``whole``: the rows of context and horizon together.

    MASE divides by the mean step of season m over context and horizon, divided once more by the number of such steps, as
    the loss is stated; 0 where nothing changes.
    """
    y, f = F.col("y"), F.col("forecast")
    ae = F.abs(y - f)
    per = df.groupBy(*keys).agg(
        (200.0 / horizon * F.avg(zero_if_flat(ae, F.abs(y) + F.abs(f)))).alias("smape100"),
        (100.0 / horizon * F.avg(zero_if_flat(ae, F.abs(y)))).alias("mape100"),
        F.avg(ae).alias("_a"),
    )
    step = F.abs(F.col(value) - F.lag(value, m).over(Window.partitionBy(*keys).orderBy(day)))
    errors = whole.select(*keys, step.alias("_s")).groupBy(*keys).agg(F.try_divide(F.avg("_s"), F.count("_s")).alias("_e"))
    return per.join(errors, keys).select(*keys, "smape100", "mape100", zero_if_flat(F.col("_a"), F.col("_e")).alias("mase_n"))


def empirical_cdf(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """Equal-width histogram per key and the running share of rows; the top edge closes the last bin."""
    bounds = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)).cast("int")
    bucket = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))
    hist = df.join(bounds, key).groupBy(key, bucket.alias("bin")).agg(
        F.count("*").alias("n"), F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    full = bounds.select(key, "_n", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    dense = full.join(hist.select(key, "bin", "n"), [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    run = Window.partitionBy(key).orderBy("bin")
    return dense.select(
        key, "bin", "n", (F.col("_lo") + (F.col("bin") + 1) * width).alias("edge"),
        (F.sum("n").over(run) / F.col("_n")).alias("cdf"),
    )


def crps_quantiles(df: DataFrame, keys: list[str], qcols: dict[float, str]) -> DataFrame:
    """Mean over the quantile grid of twice the pinball loss, averaged over rows."""
    terms = [2 * pinball(F.col("y"), F.col(c), q) for q, c in qcols.items()]
    return df.groupBy(*keys).agg(F.avg(mean_of(terms)).alias("crps"))


def evaluate_multivariate(df: DataFrame, item: str, dim: str, errors: DataFrame, combined: dict[str, tuple], qcols: dict[float, str],
                          median: str, mean: str) -> DataFrame:
    """Aggregate metrics per dimension, over all dimensions, and after each way of combining the dimensions.

    ``errors``: item, dim, seasonal_error. ``combined``: name -> (aggregate function, errors of the combined series: item,
    seasonal_error), such as ("sum", F.sum) or any function of a column. The dimension is a group key, so any number of
    dimensions is one job.
    """
    values = list(dict.fromkeys(["y", mean, median, *qcols.values()]))
    per = evaluate(df, errors, [item, dim], qcols, median, mean)
    out = aggregate_metrics(per, qcols, [dim]).withColumnRenamed(dim, "scope")
    out = out.unionByName(aggregate_metrics(per, qcols).withColumn("scope", F.lit("all")))
    for name, (how, own_errors) in combined.items():
        together = df.groupBy(item, "step").agg(*[how(F.col(c)).alias(c) for c in values])
        scores = aggregate_metrics(evaluate(together, own_errors, [item], qcols, median, mean), qcols)
        out = out.unionByName(scores.withColumn("scope", F.lit(name)))
    return out


def backtest(df: DataFrame, forecaster, keys: list[str], h: int, m: int, lead: int = 0, day: str = "d",
             value: str = "sales") -> DataFrame:
    """Hold out the last h (after a gap of ``lead``), forecast, score, and describe the training data: one row."""
    from tidegrid.operators.encode import dataset_stats

    cut = df.agg(F.max(day)).scalar() - (h + lead)
    past = df.filter(F.col(day) <= cut)
    fc = forecaster(past, keys).select(*keys, "step", "forecast").filter(F.col("step") > lead)
    actual = df.filter(F.col(day) > cut + lead).select(*keys, (F.col(day) - cut).alias("step"), F.col(value).alias("y"))
    joined = actual.join(fc, [*keys, "step"])
    per = evaluate(joined, seasonal_error(past, keys, m, day, value), keys, {0.5: "forecast"}, "forecast", "forecast")
    stats = dataset_stats(past, keys, day, value)
    scores = aggregate_metrics(per, {0.5: "forecast"})
    both = scores.withColumn("_s", stats.select(F.struct(*stats.columns)).scalar())
    return both.select(*scores.columns, *[F.col(f"_s.{c}").alias(f"train_{c}") for c in ("num_series", "num_observations", "mean_target", "max_length")])


def score_folds(grid: DataFrame, forecast: DataFrame, keys: list[str], cuts: dict[str, Column], h: int) -> DataFrame:
    """RMSE per fold. ``forecast``: fold, keys, step, forecast; ``cuts``: fold -> last training day."""
    parts = None
    for fold, cut in cuts.items():
        rows = grid.filter((F.col("d") > cut) & (F.col("d") <= cut + h)).select(
            F.lit(fold).alias("fold"), *keys, (F.col("d") - cut).alias("step"), F.col("sales").alias("y")
        )
        parts = rows if parts is None else parts.unionByName(rows)
    joined = parts.join(forecast, ["fold", *keys, "step"])
    return joined.groupBy("fold").agg(
        F.sqrt(F.avg(F.pow(F.col("y") - F.col("forecast"), F.lit(2.0)))).alias("value")
    ).select("fold", F.lit("rmse").alias("metric"), "value")
