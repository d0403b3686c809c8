"""Combining, correcting and reconciling forecasts."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.hierarchy import LEVELS, level_series_id, rollup_hierarchy, rollup_top

# The nine quantiles.
QUANTILES = [0.005, 0.025, 0.165, 0.25, 0.5, 0.75, 0.835, 0.975, 0.995]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ensemble_mean(frames: list[DataFrame], keys: list[str], value: str = "forecast") -> DataFrame:
    """Equal-weight mean: one union and one aggregate, not a chain of joins."""
    return union_all(frames).groupBy(*keys).agg(F.avg(value).alias(value))


def combine_disjoint(frames: list[DataFrame], keys: list[str], value: str = "forecast") -> DataFrame:
    """Sum of forecasts that each cover part of the series; a missing part counts 0."""
    return union_all(frames).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def ensemble_geometric(a: DataFrame, b: DataFrame, history: DataFrame, keys: list[str], period: int,
                       sigmas: float = 6.0, wa: int = 3, wb: int = 1) -> DataFrame:
    """(a^wa * b^wb)^(1/(wa+wb)); on steps where the mean of b is beyond m + sigmas*s, a alone.

    m and s come from the daily means of the last ``period`` history days.
    """
    last = history.agg(F.max("d")).scalar()
    daily = history.filter(F.col("d") > last - period).groupBy("d").agg(F.avg("sales").alias("m"))
    limit = daily.agg((F.avg("m") + sigmas * F.stddev_pop("m")).alias("l")).scalar()
    odd = b.groupBy("step").agg(F.avg("forecast").alias("_bm")).select("step", (F.col("_bm") > limit).alias("outlier_day"))
    both = a.withColumnRenamed("forecast", "_a").join(b.withColumnRenamed("forecast", "_b"), keys).join(odd, "step")
    mixed = F.pow(F.pow(F.col("_a"), wa) * F.pow(F.col("_b"), wb), 1.0 / (wa + wb))
    return both.select(*keys, F.when(F.col("outlier_day"), F.col("_a")).otherwise(mixed).alias("forecast"), "outlier_day")


def ensemble(frames: list[DataFrame], keys: list[str], method: str) -> DataFrame:
    """median / mean over members, or every member kept under its number."""
    members = union_all([f.withColumn("member", F.lit(i)) for i, f in enumerate(frames, 1)])
    if method == "none":
        return members
    how = F.avg("forecast") if method == "mean" else F.percentile("forecast", 0.5)
    return members.groupBy(*keys).agg(how.alias("forecast"))


def blend_folds(folds: DataFrame, keys: list[str], n_folds: int, scaler: Column | None = None,
                last_only: bool = False) -> DataFrame:
    """Weights 1..n by fold order over their sum (or the last fold alone), times the scaler."""
    weight = F.when(F.col("fold") == n_folds, 1.0).otherwise(0.0) if last_only else F.col("fold") / F.lit(n_folds * (n_folds + 1) / 2)
    total = F.sum(F.col("forecast") * weight)
    return folds.groupBy(*keys).agg((total * F.max(scaler) if scaler is not None else total).alias("forecast"))


def apply_factors(fc: DataFrame, factors: DataFrame, keys: list[str], step_factors: dict[int, float] | None = None) -> DataFrame:
    """Forecast times its group factor, times a fixed factor on given steps."""
    extra = F.lit(1.0)
    for step, f in (step_factors or {}).items():
        extra = F.when(F.col("step") == step, F.lit(float(f))).otherwise(extra)
    out = fc.join(factors, keys)
    return out.withColumn("forecast", F.col("forecast") * F.col("factor") * extra).drop("factor")


def align_levels(fc: DataFrame, factor: float, max_level: int = 9) -> DataFrame:
    """Scale each level's step profile towards the mean profile of the levels up to max_level.

    ``fc``: level, series, step, q, value (already divided by the level multiplier).
    """
    profile = fc.filter((F.col("q") == 0.5) & (F.col("level") <= max_level)).groupBy("level", "step").agg(
        F.sum("value").alias("_s")
    )
    mean = profile.withColumn("_ratio", F.try_divide(F.avg("_s").over(Window.partitionBy("step")), F.col("_s")))
    out = fc.join(mean.select("level", "step", "_ratio"), ["level", "step"], "left")
    adjust = F.when(F.col("_ratio").isNull(), F.lit(1.0)).otherwise((1 - factor) + factor * F.col("_ratio"))
    return out.withColumn("value", F.col("value") * adjust).drop("_ratio")


def gap_metrics(candidate: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate against the top model, per series.

    'rmsse' is (mean error)^2 over the mean squared step of the top forecast: a bias measure.
    """
    order = Window.partitionBy(*keys).orderBy("step")
    pair = candidate.select(*keys, "step", F.col("forecast").alias("_c")).join(
        top.select(*keys, "step", F.col("forecast").alias("_t")), [*keys, "step"]
    )
    rows = pair.withColumn("_e", F.col("_c") - F.col("_t")).withColumn("_j", F.col("_t") - F.lag("_t").over(order))
    return rows.groupBy(*keys).agg(
        F.try_divide(F.pow(F.avg("_e"), F.lit(2.0)), F.avg(F.col("_j") * F.col("_j"))).alias("rmsse"),
        F.avg("_e").alias("mean_error"),
        F.avg(F.abs("_e")).alias("mean_abs_error"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
    )


def bottom_up(bottom: DataFrame, top: DataFrame, multipliers: list[float]) -> DataFrame:
    """For each multiplier of the bottom forecasts, the mean gap to the top model; the best is marked.

    ``bottom``: hierarchy keys, step, forecast. ``top``: id_str, step, forecast.
    """
    rolled = rollup_top(bottom, ["forecast"], ["step"])
    tries = rolled.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    tries = tries.withColumn("forecast", F.col("forecast") * F.col("multiplier"))
    tops = top.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    gaps = gap_metrics(tries, tops, ["multiplier", "id_str"]).groupBy("multiplier").agg(
        F.avg("rmsse").alias("rmsse"), F.avg("mean_error").alias("mean_error"), F.avg("rmse").alias("rmse")
    )
    best = gaps.agg(F.min_by("multiplier", F.abs("mean_error"))).scalar()
    return gaps.withColumn("best", F.col("multiplier") == best)


def rolling_residuals(df: DataFrame, forecaster, keys: list[str], h: int, blocks: int, lookback: int | None = None,
                      day: str = "d", value: str = "sales") -> DataFrame:
    """Residuals of a forecaster over the last ``blocks`` windows of h days, per series and day.

    All cut points run as one job: history is copied once per block and the block is a key.
    ``lookback`` is the history the forecaster uses; older rows are not copied.
    """
    end = df.agg(F.max(day)).scalar()
    rows = df if lookback is None else df.filter(F.col(day) > end - blocks * h - lookback)
    cuts = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("block"), end.alias("_end"))
    cuts = cuts.withColumn("_cut", F.col("_end") - F.col("block") * h).filter(F.col(day) <= F.col("_cut") + h)
    if lookback is not None:
        cuts = cuts.filter(F.col(day) > F.col("_cut") - lookback)
    fc = forecaster(cuts.filter(F.col(day) <= F.col("_cut")), [*keys, "block"])
    actual = cuts.filter(F.col(day) > F.col("_cut")).select(
        *keys, "block", (F.col(day) - F.col("_cut")).alias("step"), F.col(value).alias("_y")
    )
    return actual.join(fc, [*keys, "block", "step"]).select(
        *keys, "block", "step", (F.col("_y") - F.col("forecast")).alias("residual")
    )


def mean_residuals(residuals: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """Mean residual of each series over all windows, and over the earliest one, which is the last that is looked back to."""
    return residuals.groupBy(*keys).agg(
        F.avg("residual").alias("mean_residual"), F.avg(F.when(F.col("block") == blocks, F.col("residual"))).alias("earliest_mean_residual")
    )


# --- quantiles from point forecasts -------------------------------------------------

# The distributions that give each level's ratios: (kind, spread, shape ...). Kinds: "normal" and "skewed" are
# CDFs at the spread times the quantile's log odds, "power" is the inverse CDF of a power lognormal at the spread times the
# quantile. A level of two averages them.
LEVEL_SHAPES: dict[int, list[tuple]] = {
    1: [("normal", 0.025)],
    2: [("normal", 0.03)],
    3: [("normal", 0.035)],
    4: [("normal", 0.03)],
    5: [("normal", 0.04)],
    6: [("normal", 0.04)],
    7: [("normal", 0.05)],
    8: [("normal", 0.055)],
    9: [("normal", 0.07)],
    10: [("skewed", 0.18, 0.4)],
    11: [("skewed", 0.21, 0.75)],
    12: [("skewed", 0.3, 1.2), ("power", 0.3, 0.04, 0.9)],
}
# Factors of the lowest and highest quantile's ratio; how far ratios are moved off 1; decimals of a ratio.
END_FACTORS = {"normal": (1.0, 1.03), "skewed": (1.0, 1.02), "power": (0.25, 1.02)}
OFF_ONE, DECIMALS = 0.005, 3


def _shape_values(kind: str, spread: float, *shape: float) -> np.ndarray:
    """A shape at the nine quantiles."""
    q, normal = np.array(QUANTILES), NormalDist()
    if kind == "power":
        power, sigma = shape
        tail = (1 - spread * q) ** (1 / power)
        return np.exp([-sigma * normal.inv_cdf(p) for p in tail])
    x = spread * np.log(q / (1 - q))
    below = np.array([normal.cdf(v) for v in x])
    if kind == "normal":
        return below
    # skew normal: less twice Owen's T, by Gauss-Legendre points on 0..skew
    node, weight = np.polynomial.legendre.leggauss(48)
    t = shape[0] * (node + 1) / 2
    owen = np.exp(-np.outer(x * x, 1 + t * t) / 2) @ (weight / (1 + t * t)) * shape[0] / 2 / (2 * math.pi)
    return below - 2 * owen


def level_ratios() -> dict[int, list[float]]:
    """Nine ratios per level, relative to the median; the spread falls with the level."""
    out = {}
    for level, shapes in LEVEL_SHAPES.items():
        tables = []
        for kind, *rest in shapes:
            values = _shape_values(kind, *rest)
            ratios = values / values[QUANTILES.index(0.5)]
            ratios[[0, -1]] *= END_FACTORS[kind]
            tables.append(ratios.round(DECIMALS))
        mean = np.mean(tables, axis=0)
        out[level] = (mean * (1 + OFF_ONE * np.sign(mean - 1))).tolist()
    return out


def ratio_quantiles(bottom: DataFrame, suffix: str, value: str = "forecast") -> DataFrame:
    """Level sums of the point forecasts times the level's nine ratios (108 fixed numbers)."""
    rolled = rollup_hierarchy(bottom, [value], ["step"])
    table = level_ratios()
    ratios = F.create_map(*[x for lv in LEVELS for x in (F.lit(lv), F.array(*[F.lit(r) for r in table[lv]]))])
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    pairs = rolled.select("*", F.explode(F.arrays_zip(qs.alias("q"), ratios[F.col("level")].alias("r"))).alias("_z"))
    q = F.col("_z")["q"]
    return pairs.withColumn("series", level_series_id()).select(
        "level", "series", "state_id", "store_id", "item_id", "step", q.alias("q"),
        F.concat_ws("_", "series", F.format_string("%.3f", q), F.lit(suffix)).alias("name"),
        (F.col(value) * F.col("_z")["r"]).alias("value"),
    )


def history_quantiles(df: DataFrame, keys: list[str], spans: list[int], weights: list[float], day: str = "d",
                      value: str = "sales") -> DataFrame:
    """Weighted mean over spans of each series' quantiles in the last span days: (keys, q, hist)."""
    end = df.agg(F.max(day)).scalar()
    probs = F.array(*[F.lit(q) for q in QUANTILES])
    rows = df.filter(F.col(day) > end - max(spans)).withColumn("_end", end)
    aggs = [
        F.percentile(F.when(F.col(day) > F.col("_end") - span, F.col(value)), probs).alias(f"_p{span}")
        for span in spans
    ]
    stats = rows.groupBy(*keys).agg(*aggs)
    total = sum(weights)
    zipped = F.explode(F.arrays_zip(probs.alias("q"), *[F.col(f"_p{s}") for s in spans])).alias("_z")
    mix = reduce(lambda x, y: x + y, [F.col("_z")[f"_p{s}"] * w for s, w in zip(spans, weights)]) / total
    return stats.select(*keys, zipped).select(*keys, F.col("_z")["q"].alias("q"), mix.alias("hist"))


def weekday_quantiles(df: DataFrame, keys: list[str], blocks: list[int], day: str = "d", value: str = "sales") -> DataFrame:
    """Quantiles per position in the week over the last blocks x 28 days, averaged over the spans."""
    end = df.agg(F.max(day)).scalar()
    probs = F.array(*[F.lit(q) for q in QUANTILES])
    rows = df.filter(F.col(day) > end - 28 * max(blocks)).withColumn("_end", end)
    position = F.pmod(F.col(day) - F.col("_end") - 1, F.lit(7))
    rows = rows.withColumn("weekpos", position)
    aggs = [
        F.percentile(F.when(F.col(day) > F.col("_end") - 28 * b, F.col(value)), probs).alias(f"_p{b}") for b in blocks
    ]
    stats = rows.groupBy(*keys, "weekpos").agg(*aggs)
    zipped = F.explode(F.arrays_zip(probs.alias("q"), *[F.col(f"_p{b}") for b in blocks])).alias("_z")
    mix = reduce(lambda x, y: x + y, [F.col("_z")[f"_p{b}"] for b in blocks]) / len(blocks)
    return stats.select(*keys, "weekpos", zipped).select(*keys, "weekpos", F.col("_z")["q"].alias("q"), mix.alias("week_hist"))


def _quantiles_of(values: Column) -> Column:
    """The nine linear-interpolated quantiles of an array without nulls."""
    probs = F.array(*[F.lit(q) for q in QUANTILES])

    def of_sorted(x: Column) -> Column:
        def one(p: Column) -> Column:
            at = (F.size(x) - 1) * p
            low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
            between = (high - at) * F.get(x, low) + (at - low) * F.get(x, high)
            return F.when(low == high, F.get(x, low)).otherwise(between)

        return F.transform(probs, one)

    return F.transform(F.array(F.array_sort(values)), of_sorted)[0]


def quantile_profiles(df: DataFrame, keys: list[str], spans: list[int], weights: list[float], blocks: list[int], day: str = "d",
                      value: str = "sales") -> DataFrame:
    """What ``history_quantiles`` and ``weekday_quantiles`` give, as arrays of one row a series: (keys, hist, week). One pass and
    one shuffle; a series' recent days are one array, bounded by the longest span."""
    reach = max(*spans, *(28 * b for b in blocks))
    end = df.agg(F.max(day)).scalar()
    rows = df.filter(F.col(day) > end - reach).select(*keys, (end - F.col(day)).alias("_ago"), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    series = rows.groupBy(*keys).agg(F.collect_list(F.struct("_ago", "_v")).alias("_r"))
    recent = lambda days, which: F.transform(F.filter("_r", lambda r: (r["_ago"] < days) & which(r)), lambda r: r["_v"])
    added = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    scaled = lambda x, w: F.transform(x, lambda a: a * w)
    hist = reduce(added, [scaled(_quantiles_of(recent(s, lambda r: F.lit(True))), w) for s, w in zip(spans, weights)])

    def weekday(position: Column) -> Column:
        of = [_quantiles_of(recent(28 * b, lambda r: F.pmod(-r["_ago"] - 1, F.lit(7)) == position)) for b in blocks]
        return scaled(reduce(added, of), 1.0 / len(blocks))

    week = F.transform(F.sequence(F.lit(0), F.lit(6)), weekday)
    return series.select(*keys, scaled(hist, 1.0 / sum(weights)).alias("hist"), week.alias("week"))


def blend_quantiles(fc: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bottom level: model, history and weekday history; item x state: model and mean history.

    ``profiles``: (item_id, store_id, state_id, hist, week), one row a series, so the joins do not multiply with steps or
    quantiles. Fixed values: the blend weights.
    """
    place = F.array_position(F.array(*[F.lit(q) for q in QUANTILES]), F.col("q")).cast("int")
    middle = F.col("q") == 0.5
    bottom = fc.filter("level = 12").drop("state_id").join(profiles.drop("state_id"), ["item_id", "store_id"])
    own, weekly = F.element_at("hist", place), F.element_at(F.get("week", (F.col("step") - 1) % 7), place)
    mixed = F.when(middle, 0.8 * F.col("value") + 0.2 * own).otherwise(0.2 * F.col("value") + 0.7 * own + 0.1 * weekly)
    bottom = bottom.select("level", "series", "q", "step", mixed.alias("value"))
    means = F.array(*[F.avg(F.get("hist", F.lit(i))) for i in range(len(QUANTILES))])
    by_state = profiles.groupBy("state_id", "item_id").agg(means.alias("hist"))
    states = fc.filter("level = 11").join(by_state, ["state_id", "item_id"])
    mixed = F.when(middle, F.col("value")).otherwise(0.91 * F.col("value") + 0.09 * F.element_at("hist", place))
    states = states.select("level", "series", "q", "step", mixed.alias("value"))
    rest = fc.filter("level < 11").select("level", "series", "q", "step", "value")
    return rest.unionByName(states).unionByName(bottom)


# --- sample forecasts ----------------------------------------------------------------

def sample_quantiles(samples: DataFrame, keys: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """Sorted sample at round((n-1) q), ties to even, and the sample mean."""
    packed = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_s"), F.avg(value).alias("mean"))
    at = [F.bround((F.size("_s") - 1) * F.lit(float(p))).cast("int") + 1 for p in probs]
    return packed.select(*keys, "mean", *[F.element_at("_s", a).alias(f"q{i}") for i, a in enumerate(at)])


def copy_dim(samples: DataFrame, dim: str, chosen) -> DataFrame:
    return samples.filter(F.col(dim) == chosen).drop(dim)


def copy_aggregate(samples: DataFrame, keys: list[str], how, value: str = "value") -> DataFrame:
    """Aggregate each sample path over the dimensions left out of ``keys``."""
    return samples.groupBy(*keys).agg(how(F.col(value)).alias(value))


def forecast_json(quantiles: DataFrame, keys: list[str], named: dict[str, str], mean: str = "mean", samples: DataFrame | None = None) -> DataFrame:
    """One JSON document per series: mean and quantile arrays in step order, and with ``samples`` (keys, sample, step,
    value) the sample paths, in order."""
    row = F.struct("step", F.col(mean).alias("mean"), *[F.col(c).alias(n) for n, c in named.items()])
    packed = quantiles.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    parts = [F.col("_r")["mean"].alias("mean"), F.struct(*[F.col("_r")[n].alias(n) for n in named]).alias("quantiles")]
    if samples is not None:
        paths = samples.groupBy(*keys, "sample").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("_v"))
        paths = paths.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", F.col("_v.value").alias("v")))).alias("_s"))
        packed = packed.join(paths, keys)
        parts.append(F.col("_s.v").alias("samples"))
    return packed.select(*keys, F.to_json(F.struct(*parts)).alias("document"))
