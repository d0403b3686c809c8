"""Simple forecasters over many series at once. Output: series keys, step, forecast columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tail(df: DataFrame, keys: list[str], day: str, n: int) -> DataFrame:
    """Last n rows per series with ``back`` = 1 for the newest (row_number limit runs before the shuffle)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(day))
    return df.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)


def _steps(h: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")


def seasonal_naive(df: DataFrame, keys: list[str], h: int, m: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Repeat the last season; a series shorter than m repeats its mean."""
    whole = Window.partitionBy(*keys)
    tail = _tail(df, keys, day, m).withColumn("_n", F.count("*").over(whole)).withColumn(
        "_mean", F.avg(value).over(whole)
    )
    full = tail.filter(F.col("_n") == m).select(
        *keys, F.explode(F.sequence(m + 1 - F.col("back"), F.lit(h), F.lit(m))).alias("step"), F.col(value).alias("forecast")
    ) if h >= m else tail.filter((F.col("_n") == m) & (m + 1 - F.col("back") <= h)).select(
        *keys, (m + 1 - F.col("back")).alias("step"), F.col(value).alias("forecast")
    )
    short = tail.filter((F.col("_n") < m) & (F.col("back") == 1)).select(
        *keys, _steps(h), F.col("_mean").alias("forecast")
    )
    return full.unionByName(short)


def seasonality(df: DataFrame, keys: list[str], m: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Per series: n, autocorrelation terms and whether season m passes the 90% test.

    The test compares twice the squared correlation at lag m with the limit.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(day)
    centred = df.withColumn("_x", F.col(value) - F.avg(value).over(whole))
    lags = centred.select(*keys, "_x", *[F.lag("_x", k).over(order).alias(f"_l{k}") for k in range(1, m + 1)])
    sums = lags.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.col("_x") * F.col("_x")).alias("_v"),
        *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, m + 1)],
    )
    twice = [2 * F.pow(F.try_divide(F.col(f"_c{k}"), F.col("_v")), F.lit(2.0)) for k in range(1, m + 1)]
    total = F.lit(1.0)
    for t in twice:
        total = total + t
    # Fixed value: 1.645 is the two-sided 90% normal limit.
    limit = F.lit(1.645) / F.sqrt("n") * F.sqrt(total)
    passed = (F.col("n") >= 3 * m) & (twice[-1] > limit)
    return sums.select(*keys, "n", twice[-1].alias("season_corr"), limit.alias("season_limit"),
                       F.coalesce(passed, F.lit(False)).alias("seasonal"))


def season_factors(df: DataFrame, keys: list[str], m: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Multiplicative season factor per (series, phase): centred moving average, ratio, mean by phase, normalised."""
    order = Window.partitionBy(*keys).orderBy(day)
    half = m // 2
    frame = order.rowsBetween(-half, half)
    if m % 2:
        trend = F.sum(value).over(frame) / m
    else:
        ends = (F.lag(value, half).over(order) + F.lead(value, half).over(order)) / 2
        trend = (F.sum(value).over(order.rowsBetween(-half + 1, half - 1)) + ends) / m
    pos = F.row_number().over(order) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = df.select(*keys, F.col(value), pos.alias("_pos"), n.alias("_n"), trend.alias("_t"))
    inner = (F.col("_pos") >= half) & (F.col("_pos") < F.col("_n") - half)
    ratio = F.when(inner, F.try_divide(F.col(value), F.col("_t")))
    phases = rows.groupBy(*keys, (F.col("_pos") % m).alias("phase")).agg(F.avg(ratio).alias("raw"))
    mean = F.avg("raw").over(Window.partitionBy(*keys))
    return phases.select(*keys, "phase", F.try_divide(F.col("raw"), mean).alias("factor"))


def naive2(df: DataFrame, keys: list[str], h: int, m: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Last value, season-adjusted where the season test passes. A zero factor gives null."""
    test = seasonality(df, keys, m, day, value)
    last = df.groupBy(*keys).agg(F.max_by(value, day).alias("_last"))
    factors = season_factors(df, keys, m, day, value)
    steps = test.join(last, keys).select(
        *keys, "n", "seasonal", "_last", _steps(h)
    ).withColumn("phase", ((F.col("n") + F.col("step") - 1) % m).cast("int"))
    ends = steps.withColumn("_end", ((F.col("n") - 1) % m).cast("int"))
    at_step = factors.withColumnRenamed("factor", "_fs")
    at_end = factors.withColumnRenamed("factor", "_fe").withColumnRenamed("phase", "_end")
    out = ends.join(at_step, [*keys, "phase"], "left").join(at_end, [*keys, "_end"], "left")
    adjusted = F.try_divide(F.col("_last"), F.col("_fe")) * F.col("_fs")
    return out.select(*keys, "step", F.when(F.col("seasonal"), adjusted).otherwise(F.col("_last")).alias("forecast"))


def mean_forecast(df: DataFrame, keys: list[str], h: int, samples: int = 0, seed: int = 0,
                  value: str = "sales") -> DataFrame:
    """Series mean for each step; with samples, mean + std x standard normal draws."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("_s"))
    steps = stats.select(*keys, "_m", "_s", _steps(h))
    if not samples:
        return steps.select(*keys, "step", F.col("_m").alias("forecast"))
    drawn = steps.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return drawn.select(*keys, "step", "sample", (F.col("_m") + F.col("_s") * normal_draw([*keys, "step", "sample"], seed)).alias("forecast"))


def uniform_draw(cols: list[str], seed: int) -> Column:
    """Uniform (0, 1) number fixed by the row's keys: the same after any repartition or retry."""
    return _uniform([F.col(c) for c in cols], seed)


def _uniform(cols: list[Column], seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def normal_draw(cols: list[str], seed: int) -> Column:
    """Standard normal number fixed by the row's keys (Box-Muller)."""
    radius = F.sqrt(-2 * F.log(uniform_draw(cols, seed)))
    return radius * F.cos(2 * F.pi() * uniform_draw(cols, seed + 1))


def constant_forecast(df: DataFrame, keys: list[str], h: int, value: float) -> DataFrame:
    return df.select(*keys).distinct().select(*keys, _steps(h), F.lit(float(value)).alias("forecast"))


def identity_forecast(df: DataFrame, keys: list[str], h: int, day: str = "d", value: str = "sales") -> DataFrame:
    """The last h values again."""
    return _tail(df, keys, day, h).select(*keys, (h + 1 - F.col("back")).alias("step"), F.col(value).alias("forecast"))


def mean_estimator(df: DataFrame, keys: list[str], h: int, day: str = "d", value: str = "sales") -> DataFrame:
    """One profile for all series: the mean over series of each of the last h positions."""
    return identity_forecast(df, keys, h, day, value).groupBy("step").agg(F.avg("forecast").alias("forecast"))


def with_fallback(main: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The fallback where the main forecast is missing for any step of a series."""
    joined = fallback.withColumnRenamed("forecast", "_fb").join(main, [*keys, "step"], "left")
    bad = F.max(F.col("forecast").isNull() | F.isnan("forecast")).over(Window.partitionBy(*keys))
    return joined.withColumn("used_fallback", bad).select(
        *keys, "step", F.when(F.col("used_fallback"), F.col("_fb")).otherwise(F.col("forecast")).alias("forecast"), "used_fallback"
    )


def _kernel_mass(df: DataFrame, keys: list[str], h: int, day: str, value: str, season: int | None, kind: str,
                 feature_scale: float, weight: float) -> tuple[DataFrame, DataFrame]:
    """History's weight for each value as seen from a step, and the series: their ends and lengths.

    All history days come before every step, so the time part of a weight is the same for all steps up to a factor;
    only the season of the step (``_sp``) matters, and history is first summed per (series, season, value). ``_near``
    is the least season distance of a step from history, which the weights are relative to.
    """
    whole = Window.partitionBy(*keys)
    n = F.count("*").over(whole)
    pos = F.row_number().over(whole.orderBy(day)) - 1
    rows = df.select(*keys, F.col(day).alias("_d"), F.col(value).alias("_v"), pos.alias("_pos"), n.alias("_n"))
    time_weight = F.exp(weight * (F.col("_pos") - F.col("_n") + 1) / (F.col("_n") + h - 1)) if kind == "exponential" else F.lit(1.0)
    phase = (F.col("_d") % season) if season else F.lit(0)
    mass = rows.filter(F.col("_v").isNotNull()).groupBy(*keys, phase.alias("_ph"), "_v").agg(F.sum(time_weight).alias("_w"))
    ends = df.groupBy(*keys).agg(F.max(day).alias("_end"), F.count("*").alias("_n"))
    if not season:
        return mass.select(*keys, F.lit(0).alias("_sp"), "_v", "_w", F.lit(0.0).alias("_near")), ends
    classes = ends.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(min(h, season)))).alias("step"), "_end")
    classes = classes.select(*keys, ((F.col("_end") + F.col("step")) % season).alias("_sp"))
    pairs = mass.join(classes, keys)
    if kind == "exponential":
        gap = weight * F.abs(F.col("_ph") - F.col("_sp")) / F.lit(float(season - 1)) * feature_scale
        # less the least gap of the step: a series without a day near the step's season keeps its relative weights
        pairs = pairs.withColumn("_near", F.min(gap).over(Window.partitionBy(*keys, "_sp")))
        pairs = pairs.withColumn("_w", F.col("_w") * F.exp(F.col("_near") - gap))
    else:
        # a step whose season has no day in history weighs all days alike
        same = F.col("_ph") == F.col("_sp")
        pairs = pairs.withColumn("_any", F.max(same).over(Window.partitionBy(*keys, "_sp"))).filter(same | ~F.col("_any"))
        pairs = pairs.withColumn("_near", F.lit(0.0))
    return pairs.groupBy(*keys, "_sp", "_v").agg(F.sum("_w").alias("_w"), F.max("_near").alias("_near")), ends


def kernel_quantiles(df: DataFrame, keys: list[str], h: int, probs: list[float], day: str = "d",
                     value: str = "sales", season: int | None = None, kind: str = "exponential",
                     feature_scale: float = 1000.0) -> DataFrame:
    """Quantiles of history weighted by closeness to the step (no feedback of drawn values).

    exponential: weight exp(-(distance in scaled time + distance in scaled season)).
    uniform: weight 1, or equality of season.
    """
    pooled, ends = _kernel_mass(df, keys, h, day, value, season, kind, feature_scale, 1.0)
    cls = Window.partitionBy(*keys, "_sp")
    cum = F.sum("_w").over(cls.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    share = pooled.withColumn("_c", cum / F.sum("_w").over(cls))
    # 1e-9 keeps a share that equals the probability up to rounding on the same side in every engine.
    out = share.groupBy(*keys, "_sp").agg(
        *[F.min(F.when(F.col("_c") >= p - 1e-9, F.col("_v"))).alias(f"q{i}") for i, p in enumerate(probs)]
    )
    step_phase = ((F.col("_end") + F.col("step")) % season) if season else F.lit(0)
    steps = ends.select(*keys, "_end", _steps(h)).select(*keys, "step", step_phase.alias("_sp"))
    return steps.join(out, [*keys, "_sp"]).drop("_sp")


def kernel_samples(df: DataFrame, keys: list[str], h: int, n_samples: int, seed: int, day: str = "d",
                   value: str = "sales", season: int | None = None, feature_scale: float = 1000.0,
                   weight: float = 1.0) -> DataFrame:
    """Sample paths from kernel-weighted history in which a path's earlier draws are drawn again.

    A path is an urn. At each step it holds history's values with their weights and the path's own draws so far, whose
    weights depend on the steps alone, not on what was drawn. So each step's totals are known beforehand, for a series
    as a whole; a hashed uniform number picks history (a value by its running sum, see ``kernel_quantiles``) or one of the own
    draws, and a path is a fold over the steps. One row a (series, sample) holds the series' distinct values per season.
    """
    pooled, ends = _kernel_mass(df, keys, h, day, value, season, "exponential", feature_scale, weight)
    run = Window.partitionBy(*keys, "_sp").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = pooled.withColumn("_c", F.sum("_w").over(run)).groupBy(*keys, "_sp").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_c").alias("c"), F.col("_v").cast("double").alias("v")))).alias("values"), F.max("_near").alias("near")
    )
    past = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_sp").alias("sp"), "near", "values")).alias("_past"))
    phase = f"((_end + {{}}) % {season})" if season else "0"
    apart = f"abs({phase.format('s')} - {phase.format('k')}) / {season - 1}.0D * {feature_scale}D" if season else "0.0D"
    length, own = "(_n + {h} - 1.0D)".format(h=h), f"{weight}D * ({apart})"
    # per step: its season's place in _past, the own draws' distances, and the least of all distances
    series = ends.join(past, keys).withColumn("_near", F.expr(
        f"""transform(sequence(1, {h}), s -> named_struct('s', s, 'k', array_position(transform(_past, x -> x.sp), {phase.format('s')}) - 1,
         'gaps', if(s > 1, transform(sequence(1, s - 1), k -> {own}), cast(array() as array<double>))))"""
    ))
    series = series.withColumn("_near", F.expr(
        "transform(_near, p -> named_struct('s', p.s, 'k', cast(p.k as int), 'gaps', p.gaps, 'least', least(_past[cast(p.k as int)].near, coalesce(array_min(p.gaps), double('inf')))))"
    ))
    series = series.withColumn("_urns", F.expr(
        f"""transform(_near, p -> named_struct('s', p.s, 'k', p.k,
         'scale', exp(p.least - _past[p.k].near - {weight}D * p.s / {length}),
         'own', aggregate(transform(p.gaps, (g, i) -> exp(p.least - g - {weight}D * (p.s - i - 1) / {length})), cast(array() as array<double>),
          (sums, w) -> concat(sums, array(coalesce(element_at(sums, -1), 0.0D) + w)))))""".replace("element_at(sums, -1)", "try_element_at(sums, -1)")
    ))
    series = series.withColumn("_urns", F.expr(
        "transform(_urns, p -> named_struct('s', p.s, 'k', p.k, 'scale', p.scale, 'own', p.own, 'past', element_at(_past[p.k].values, -1).c * p.scale))"
    ))
    paths = series.select(*keys, "_past", "_urns", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"))
    drawn = F.transform("_urns", lambda p: (p["past"] + F.coalesce(F.try_element_at(p["own"], F.lit(-1)), F.lit(0.0))) * _uniform([*[F.col(k) for k in keys], p["s"], F.col("sample")], seed))
    paths = paths.withColumn("_x", drawn)
    picked = """aggregate(_urns, cast(array() as array<double>), (path, p) -> concat(path, array(
     if(_x[p.s - 1] < p.past or p.s = 1,
      _past[p.k].values[least(size(filter(_past[p.k].values, r -> r.c * p.scale <= _x[p.s - 1])), size(_past[p.k].values) - 1)].v,
      path[least(size(filter(p.own, c -> p.past + c <= _x[p.s - 1])), p.s - 2)]))))"""
    out = paths.select(*keys, "sample", F.posexplode(F.expr(picked)).alias("_i", "value"))
    return out.select(*keys, (F.col("_i") + 1).alias("step"), "sample", "value")
