"""Queries over forecasters, ensembles, corrections and quantile forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import ensemble as E
from tidegrid.operators import forecast as C
from tidegrid.operators.hierarchy import rollup_top
from tidegrid.plans import frames as X
from tidegrid.plans.flagship import HORIZON, LEVEL, gsets
from tidegrid.plans.helpers import rnd, rounded
from tidegrid.plans.registry import query
from tidegrid.plans.reshape import NAME_CASE

KEY = ["id", "step"]


@query("seasonal_naive", f"SELECT id, step, {rnd('forecast', 'forecast')} FROM fc7", "fc7")
def seasonal_naive(t):
    return rounded(X.fc7(t).select("id", "step", "forecast"), ["forecast"])


M = 7
NAIVE2_SQL = f"""r AS (SELECT id, d, sales, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY id) AS n, sales - avg(sales) OVER (PARTITION BY id) AS x FROM grid WINDOW w AS (PARTITION BY id ORDER BY d)),
 l AS (SELECT id, n, x, {', '.join(f'lag(x, {k}) OVER (PARTITION BY id ORDER BY d) AS l{k}' for k in range(1, M + 1))} FROM r),
 a AS (SELECT id, max(n) AS n, {', '.join(f'2 * pow(sum(x * l{k}) / nullif(sum(x * x), 0), 2) AS c{k}' for k in range(1, M + 1))} FROM l GROUP BY id),
 s AS (SELECT id, n, c7 AS season_corr, 1.645 / sqrt(n) * sqrt(1 + {' + '.join(f'c{k}' for k in range(1, M + 1))}) AS season_limit FROM a),
 tr AS (SELECT id, pos, n, sales, CASE WHEN pos >= 3 AND pos < n - 3 THEN sum(sales) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END AS trend FROM r),
 ph AS (SELECT id, CAST(pos % 7 AS INT) AS phase, avg(CASE WHEN trend <> 0 THEN sales / trend END) AS raw FROM tr GROUP BY ALL),
 f AS (SELECT id, phase, raw / nullif(avg(raw) OVER (PARTITION BY id), 0) AS factor FROM ph)"""
SEASONAL = "coalesce({0}n >= 21 AND season_corr > season_limit, FALSE)"


@query(
    "season_test",
    f"WITH {NAIVE2_SQL} SELECT id, n, {rnd('season_corr', 'season_corr', 8)}, {rnd('season_limit', 'season_limit', 8)}, {SEASONAL.format('')} AS seasonal FROM s",
    "grid",
)
def season_test(t):
    return rounded(C.seasonality(t.grid, ["id"], M), ["season_corr", "season_limit"], 8)


@query("season_factors", f"WITH {NAIVE2_SQL} SELECT id, phase, {rnd('factor', 'factor')} FROM f", "grid")
def season_factors(t):
    out = C.season_factors(t.grid, ["id"], M).withColumn("phase", F.col("phase").cast("int"))
    return rounded(out, ["factor"])


NAIVE2_OUT = f"""z AS (SELECT id, arg_max(sales, d) AS last FROM grid GROUP BY id),
 n2 AS (SELECT s.id, k.step, CASE WHEN {SEASONAL.format('s.')} THEN CASE WHEN fe.factor <> 0 THEN z.last / fe.factor * fs.factor END ELSE z.last END AS forecast
  FROM s JOIN z ON z.id = s.id CROSS JOIN (SELECT CAST(unnest(range(1, 29)) AS INT) AS step) k LEFT JOIN f fs ON fs.id = s.id AND fs.phase = (s.n + k.step - 1) % 7 LEFT JOIN f fe ON fe.id = s.id AND fe.phase = (s.n - 1) % 7)"""


@query("naive2", f"WITH {NAIVE2_SQL}, {NAIVE2_OUT} SELECT id, step, {rnd('forecast', 'forecast')} FROM n2", "grid")
def naive2(t):
    return rounded(C.naive2(t.grid, ["id"], HORIZON, M), ["forecast"])


@query("mean_forecast", f"SELECT id, CAST(unnest(range(1, 29)) AS INT) AS step, {rnd('avg(sales)', 'forecast')} FROM grid GROUP BY id", "grid")
def mean_forecast(t):
    return rounded(C.mean_forecast(t.grid, ["id"], HORIZON), ["forecast"])


@query("mean_forecast_samples")
def mean_forecast_samples(t):
    return C.mean_forecast(t.grid, ["id"], HORIZON, samples=10, seed=1)


@query("constant_forecast", "SELECT DISTINCT id, CAST(s AS INT) AS step, 1.5::DOUBLE AS forecast FROM panel, (SELECT unnest(range(1, 29)) AS s)", "panel")
def constant_forecast(t):
    return C.constant_forecast(t.panel, ["id"], HORIZON, 1.5)


IDENT = "i AS (SELECT id, CAST(29 - row_number() OVER (PARTITION BY id ORDER BY d DESC) AS INT) AS step, sales AS forecast FROM grid QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC) <= 28)"


@query("identity_forecast", f"WITH {IDENT} SELECT * FROM i", "grid")
def identity_forecast(t):
    return C.identity_forecast(t.grid, ["id"], HORIZON)


@query("mean_of_tails", f"WITH {IDENT} SELECT step, round(avg(forecast), 6) AS forecast FROM i GROUP BY step", "grid")
def mean_of_tails(t):
    return rounded(C.mean_estimator(t.grid, ["id"], HORIZON), ["forecast"])


PROBS = [0.1, 0.5, 0.9]


def _kernel_sql(time_weight, season_weight, where=""):
    return f"""WITH r AS (SELECT id, d, sales, row_number() OVER (PARTITION BY id ORDER BY d) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n, max(d) OVER (PARTITION BY id) AS z FROM grid),
 p AS (SELECT id, z, d % 7 AS ph, sales, sum({time_weight}) AS w FROM r GROUP BY ALL),
 x AS (SELECT id, k.step, sales, sum(w * {season_weight}) AS w FROM p CROSS JOIN (SELECT CAST(unnest(range(1, 29)) AS INT) AS step) k {where} GROUP BY ALL),
 c AS (SELECT id, step, sales, sum(w) OVER (PARTITION BY id, step ORDER BY sales) / sum(w) OVER (PARTITION BY id, step) AS c FROM x)
 SELECT id, step, {', '.join(f'min(sales) FILTER (c >= {p} - 1e-9) AS q{i}' for i, p in enumerate(PROBS))} FROM c GROUP BY id, step"""


@query("kernel_quantiles", _kernel_sql("exp((pos - n + 1) / (n + 28 - 1)::DOUBLE)", "exp(-2.0::DOUBLE * abs(ph - (z + k.step) % 7) / 6.0::DOUBLE)"), "grid")
def kernel_quantiles(t):
    return C.kernel_quantiles(t.grid, ["id"], HORIZON, PROBS, season=7, feature_scale=2.0)


@query("climatology_quantiles", _kernel_sql("1", "1", "WHERE ph = (z + k.step) % 7"), "grid")
def climatology_quantiles(t):
    return C.kernel_quantiles(t.grid, ["id"], HORIZON, PROBS, season=7, kind="uniform")


@query("kernel_samples")
def kernel_samples(t):
    """Twenty paths of four weeks for every series; later draws may repeat earlier ones of their path."""
    return C.kernel_samples(t.grid, ["id"], HORIZON, 20, seed=3, season=7, feature_scale=2.0)


@query(
    "forecast_with_fallback",
    f"""WITH {NAIVE2_SQL}, {NAIVE2_OUT}, m AS (SELECT id, step, CASE WHEN hash_free THEN forecast END AS forecast FROM (SELECT *, substr(id, 7, 1) <> '1' AS hash_free FROM n2)),
 b AS (SELECT id, avg(sales) AS fb FROM grid GROUP BY id)
 SELECT m.id, m.step, bool_or(m.forecast IS NULL) OVER (PARTITION BY m.id) AS used_fallback, {rnd('CASE WHEN bool_or(m.forecast IS NULL) OVER (PARTITION BY m.id) THEN b.fb ELSE m.forecast END', 'forecast')} FROM m JOIN b ON b.id = m.id""".replace("hash_free", "kept"),
    "grid",
)
def forecast_with_fallback(t):
    """The main forecast of the brands of one number is treated as failed."""
    main = C.naive2(t.grid, ["id"], HORIZON, M).filter(F.substring("id", 7, 1) != "1")
    return rounded(C.with_fallback(main, C.mean_forecast(t.grid, ["id"], HORIZON), ["id"]), ["forecast"])


# --- ensembles -------------------------------------------------------------------------

@query(
    "align_forecasts",
    "SELECT p.id, s.step, round(a.forecast, 6) AS naive, round(b.forecast, 6) AS mean FROM (SELECT DISTINCT id FROM panel) p CROSS JOIN (SELECT CAST(unnest(range(1, 29)) AS INT) AS step) s LEFT JOIN fc7 a ON a.id = p.id AND a.step = s.step LEFT JOIN fcm b ON b.id = p.id AND b.step = s.step",
    "panel fc7 fcm",
)
def align_forecasts(t):
    from tidegrid.operators.joins import align_forecasts as align

    ids = t.panel.select("id").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    return rounded(align(ids, {"naive": X.fc7(t), "mean": X.fcm(t)}, KEY), ["naive", "mean"])


@query("ensemble_mean", f"SELECT id, step, {rnd('avg(forecast)', 'forecast')} FROM (SELECT id, step, forecast FROM fc7 UNION ALL SELECT id, step, forecast FROM fcm) GROUP BY ALL", "fc7 fcm")
def ensemble_mean(t):
    return rounded(E.ensemble_mean([X.fc7(t), X.fcm(t)], KEY), ["forecast"])


@query(
    "combine_disjoint",
    f"SELECT id, step, {rnd('forecast', 'forecast')} FROM (SELECT id, step, forecast FROM fc7 WHERE cat_id = 'C0' UNION ALL SELECT id, step, forecast FROM fcm WHERE cat_id <> 'C0')",
    "fc7 fcm",
)
def combine_disjoint(t):
    return rounded(E.combine_disjoint([X.fc7(t).filter("cat_id = 'C0'"), X.fcm(t).filter("cat_id <> 'C0'")], KEY), ["forecast"])


@query(
    "ensemble_geometric",
    """WITH day AS (SELECT d, avg(sales) AS m FROM grid, lastday WHERE d > e - 28 * 26 GROUP BY d), lim AS (SELECT avg(m) + 0.05 * stddev_pop(m) AS l FROM day),
 o AS (SELECT step, avg(forecast) > (SELECT l FROM lim) AS outlier_day FROM fc7 GROUP BY step)
 SELECT a.id, a.step, o.outlier_day, round(CASE WHEN o.outlier_day THEN a.forecast ELSE pow(pow(a.forecast, 3) * b.forecast, 0.25) END, 6) AS forecast
 FROM fcm a JOIN fc7 b ON b.id = a.id AND b.step = a.step JOIN o ON o.step = a.step""",
    "grid lastday fc7 fcm",
)
def ensemble_geometric(t):
    t = t.staged
    history = t.grid_between(t.last_day - 28 * 26, t.last_day)
    out = E.ensemble_geometric(X.fcm(t).select(*KEY, "forecast"), X.fc7(t).select(*KEY, "forecast"), history, KEY, 28 * 26, sigmas=0.05)
    return rounded(out, ["forecast"])


@query(
    "ensemble_median",
    f"SELECT id, step, {rnd('median(forecast)', 'forecast')} FROM (SELECT id, step, forecast FROM fc7 UNION ALL SELECT id, step, forecast FROM fcm UNION ALL SELECT id, step, forecast * 2 FROM fcm) GROUP BY ALL",
    "fc7 fcm",
)
def ensemble_median(t):
    twice = X.fcm(t).withColumn("forecast", F.col("forecast") * 2)
    return rounded(E.ensemble([X.fc7(t), X.fcm(t), twice], KEY, "median"), ["forecast"])


@query(
    "ensemble_average",
    f"SELECT id, step, {rnd('avg(forecast)', 'forecast')} FROM (SELECT id, step, forecast FROM fc7 UNION ALL SELECT id, step, forecast FROM fcm UNION ALL SELECT id, step, forecast * 2 FROM fcm) GROUP BY ALL",
    "fc7 fcm",
)
def ensemble_average(t):
    twice = X.fcm(t).withColumn("forecast", F.col("forecast") * 2)
    return rounded(E.ensemble([X.fc7(t), X.fcm(t), twice], KEY, "mean"), ["forecast"])


@query(
    "ensemble_members",
    f"SELECT id, step, 1 AS member, {rnd('forecast', 'forecast')} FROM fc7 UNION ALL SELECT id, step, 2, {rnd('forecast', 'forecast')} FROM fcm",
    "fc7 fcm",
)
def ensemble_members(t):
    """No aggregation: every member under its number."""
    return rounded(E.ensemble([X.fc7(t), X.fcm(t)], KEY, "none").select("id", "step", "member", "forecast"), ["forecast"])


@query("blend_folds", f"SELECT a.id, a.step, {rnd('(a.forecast / 3 + b.forecast * 2 / 3) * 2', 'forecast')} FROM fc7 a JOIN fcm b ON b.id = a.id AND b.step = a.step", "fc7 fcm")
def blend_folds(t):
    folds = X.fc7(t).withColumn("fold", F.lit(1)).unionByName(X.fcm(t).withColumn("fold", F.lit(2)))
    return rounded(E.blend_folds(folds, KEY, 2, scaler=F.lit(2.0)), ["forecast"])


@query(
    "apply_factors",
    """WITH f AS (SELECT dept_id, store_id, avg(y) / avg(forecast) AS factor FROM ev GROUP BY ALL)
 SELECT a.id, a.step, round(a.forecast * f.factor * CASE a.step WHEN 7 THEN 0.9 WHEN 14 THEN 0.96 ELSE 1 END, 6) AS forecast FROM fc7 a JOIN f ON f.dept_id = a.dept_id AND f.store_id = a.store_id""",
    "fc7 ev",
)
def apply_factors(t):
    pair = X.actuals(t).join(X.fc7(t).select("id", "step", "forecast"), KEY)
    factors = pair.groupBy("dept_id", "store_id").agg(F.try_divide(F.avg("y"), F.avg("forecast")).alias("factor"))
    out = E.apply_factors(X.fc7(t), factors, ["dept_id", "store_id"], {7: 0.9, 14: 0.96})
    return rounded(out.select("id", "step", "forecast"), ["forecast"])


RATIOS = ", ".join(f"({lv}, {q}, {r!r})" for lv, rs in E.level_ratios().items() for q, r in zip(E.QUANTILES, rs))
LEVELED = f"""lv AS (SELECT {LEVEL} AS level, state_id, store_id, cat_id, dept_id, item_id, step, sum(forecast) AS s FROM fc7 GROUP BY {gsets('step')}),
 ra AS (SELECT CAST(level AS INT) AS level, CAST(q AS DOUBLE) AS q, CAST(r AS DOUBLE) AS r FROM (VALUES {RATIOS}) v(level, q, r)),
 rq AS (SELECT lv.level, {NAME_CASE.replace('CASE level', 'CASE lv.level')} AS series, lv.state_id, lv.store_id, lv.item_id, lv.step, ra.q, lv.s * ra.r AS value FROM lv JOIN ra ON ra.level = lv.level)"""


@query(
    "ratio_quantiles",
    f"WITH {LEVELED} SELECT level, series, step, q, series || '_' || printf('%.3f', q) || '_evaluation' AS name, {rnd('value', 'value')} FROM rq",
    "fc7",
)
def ratio_quantiles(t):
    out = E.ratio_quantiles(X.fc7(t), "evaluation").drop("state_id", "store_id", "item_id")
    return rounded(out, ["value"])


@query(
    "align_levels",
    f"""WITH {LEVELED}, x AS (SELECT level, series, step, q, value * (1 + level / 100.0::DOUBLE) AS value FROM rq),
 p AS (SELECT level, step, sum(value) AS s FROM x WHERE q = 0.5 AND level <= 9 GROUP BY ALL), m AS (SELECT level, step, avg(s) OVER (PARTITION BY step) / nullif(s, 0) AS ratio FROM p)
 SELECT x.level, x.series, x.step, x.q, {rnd('x.value * coalesce(0.3 + 0.7 * m.ratio, 1)', 'value', nudge=1e-9)} FROM x LEFT JOIN m ON m.level = x.level AND m.step = x.step""",
    "fc7",
)
def align_levels(t):
    base = E.ratio_quantiles(X.fc7(t), "evaluation").select("level", "series", "step", "q", "value")
    base = base.withColumn("value", F.col("value") * (1 + F.col("level") / F.lit(100.0)))
    return rounded(E.align_levels(base, 0.7), ["value"], nudge=1e-9)


TOPS = """GROUPING SETS ((step), (state_id, step), (store_id, step), (cat_id, step), (dept_id, step))"""
TOP_ID = "coalesce(state_id, store_id, cat_id, dept_id, 'all') AS id_str"
GAPS = """jj AS (SELECT {k}, c - t AS e, t - lag(t) OVER (PARTITION BY {k} ORDER BY step) AS j FROM jn),
 gm AS (SELECT {k}, pow(avg(e), 2) / nullif(avg(j * j), 0) AS rmsse, avg(e) AS mean_error, avg(abs(e)) AS mean_abs_error, sqrt(avg(e * e)) AS rmse FROM jj GROUP BY {k})"""


@query(
    "gap_metrics",
    f"""WITH c AS (SELECT {TOP_ID}, step, sum(forecast) AS c FROM fcm GROUP BY {TOPS}), t AS (SELECT {TOP_ID}, step, sum(forecast) AS t FROM fc7 GROUP BY {TOPS}),
 jn AS (SELECT c.id_str, c.step, c.c, t.t FROM c JOIN t ON t.id_str = c.id_str AND t.step = c.step), {GAPS.format(k='id_str')}
 SELECT id_str, {rnd('rmsse', 'rmsse')}, {rnd('mean_error', 'mean_error')}, {rnd('mean_abs_error', 'mean_abs_error')}, {rnd('rmse', 'rmse')} FROM gm""",
    "fc7 fcm",
)
def gap_metrics(t):
    out = E.gap_metrics(rollup_top(X.fcm(t), ["forecast"], ["step"]), rollup_top(X.fc7(t), ["forecast"], ["step"]), ["id_str"])
    return rounded(out, out.columns[1:])


MULTS = [0.9, 0.95, 1.0, 1.05, 1.1]


@query(
    "bottom_up_choice",
    f"""WITH c AS (SELECT {TOP_ID}, step, sum(forecast) AS c FROM fcm GROUP BY {TOPS}), t AS (SELECT {TOP_ID}, step, sum(forecast) AS t FROM fc7 GROUP BY {TOPS}),
 jn AS (SELECT m.multiplier, c.id_str, c.step, c.c * m.multiplier AS c, t.t FROM c JOIN t ON t.id_str = c.id_str AND t.step = c.step CROSS JOIN (SELECT CAST(unnest([{', '.join(map(str, MULTS))}]) AS DOUBLE) AS multiplier) m),
 {GAPS.format(k='multiplier, id_str')}, g AS (SELECT multiplier, avg(rmsse) AS rmsse, avg(mean_error) AS mean_error, avg(rmse) AS rmse FROM gm GROUP BY multiplier)
 SELECT multiplier, {rnd('rmsse', 'rmsse')}, {rnd('mean_error', 'mean_error')}, {rnd('rmse', 'rmse')}, multiplier = (SELECT arg_min(multiplier, abs(mean_error)) FROM g) AS best FROM g""",
    "fc7 fcm",
)
def bottom_up_choice(t):
    out = E.bottom_up(X.fcm(t), rollup_top(X.fc7(t), ["forecast"], ["step"]), MULTS)
    return rounded(out, ["rmsse", "mean_error", "rmse"])


RESIDUALS = """b AS (SELECT id, d, sales, CAST(k AS INT) AS block, e - k * 28 AS cut FROM grid, lastday, (SELECT unnest(range(1, 10)) AS k) WHERE d > e - 9 * 28 - 7),
 tl AS (SELECT id, block, sales, count(*) OVER (PARTITION BY id, block) AS n, avg(sales) OVER (PARTITION BY id, block) AS m, row_number() OVER (PARTITION BY id, block ORDER BY d DESC) AS back FROM b WHERE d > cut - 7 AND d <= cut),
 f AS (SELECT id, block, unnest(CASE WHEN n = 7 THEN range(8 - back, 29, 7) WHEN back = 1 THEN range(1, 29) ELSE [] END) AS step, CASE WHEN n = 7 THEN sales ELSE m END AS forecast FROM tl),
 res AS (SELECT b.id, b.block, CAST(f.step AS INT) AS step, b.sales - f.forecast AS residual FROM b JOIN f ON f.id = b.id AND f.block = b.block AND b.d = b.cut + f.step)"""


@query("rolling_residuals", f"WITH {RESIDUALS} SELECT id, block, step, {rnd('residual', 'residual')} FROM res", "grid lastday")
def rolling_residuals(t):
    return rounded(_residuals(t), ["residual"])


def _residuals(t):
    naive = lambda past, keys: C.seasonal_naive(past, keys, HORIZON, 7)
    recent = t.grid_between(t.last_day - 9 * HORIZON - 7, t.last_day)
    return E.rolling_residuals(recent, naive, ["id"], HORIZON, 9, lookback=7)


@query(
    "mean_residuals",
    f"WITH {RESIDUALS} SELECT id, {rnd('avg(residual)', 'mean_residual')}, {rnd('avg(CASE WHEN block = 9 THEN residual END)', 'earliest_mean_residual')} FROM res GROUP BY id",
    "grid lastday",
)
def mean_residuals(t):
    return rounded(E.mean_residuals(_residuals(t), ["id"], 9), ["mean_residual", "earliest_mean_residual"])


QS = ", ".join(map(str, E.QUANTILES))
HISTQ = f"""h0 AS (SELECT id, item_id, store_id, state_id, quantile_cont(sales, [{QS}]) AS a, quantile_cont(CASE WHEN d > e - 28 THEN sales END, [{QS}]) AS b FROM grid, lastday WHERE d > e - 364 GROUP BY ALL),
 hq AS (SELECT id, item_id, store_id, state_id, CAST(unnest([{QS}]) AS DOUBLE) AS q, unnest(list_transform(list_zip(a, b), lambda z: (z[1] + 1.75 * z[2]) / 2.75)) AS hist FROM h0)"""
WEEKQ = f"""w0 AS (SELECT id, item_id, store_id, state_id, CAST((d - e - 1 + 7000) % 7 AS INT) AS weekpos, quantile_cont(sales, [{QS}]) AS a, quantile_cont(CASE WHEN d > e - 84 THEN sales END, [{QS}]) AS b FROM grid, lastday WHERE d > e - 364 GROUP BY ALL),
 wq AS (SELECT id, item_id, store_id, state_id, weekpos, CAST(unnest([{QS}]) AS DOUBLE) AS q, unnest(list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2)) AS week_hist FROM w0)"""


@query("history_quantiles", f"WITH {HISTQ} SELECT id, q, {rnd('hist', 'hist')} FROM hq", "grid lastday")
def history_quantiles(t):
    recent = t.grid_between(t.last_day - 364, t.last_day)
    return rounded(E.history_quantiles(recent, ["id"], [364, 28], [1.0, 1.75]), ["hist"])


@query("weekday_quantiles", f"WITH {WEEKQ} SELECT id, weekpos, q, {rnd('week_hist', 'week_hist')} FROM wq", "grid lastday")
def weekday_quantiles(t):
    recent = t.grid_between(t.last_day - 364, t.last_day)
    return rounded(E.weekday_quantiles(recent, ["id"], [13, 3]), ["week_hist"])


@query(
    "blended_quantiles",
    f"""WITH {LEVELED}, {HISTQ}, {WEEKQ}, st AS (SELECT state_id, item_id, q, avg(hist) AS hist FROM hq GROUP BY ALL)
 SELECT level, series, q, step, {rnd('value', 'value', nudge=1e-9)} FROM rq WHERE level < 11 UNION ALL
 SELECT rq.level, rq.series, rq.q, rq.step, {rnd('CASE WHEN rq.q = 0.5 THEN rq.value ELSE 0.91 * rq.value + 0.09 * st.hist END', 'value', nudge=1e-9)} FROM rq JOIN st ON st.state_id = rq.state_id AND st.item_id = rq.item_id AND st.q = rq.q WHERE level = 11 UNION ALL
 SELECT rq.level, rq.series, rq.q, rq.step, {rnd('CASE WHEN rq.q = 0.5 THEN 0.8 * rq.value + 0.2 * hq.hist ELSE 0.2 * rq.value + 0.7 * hq.hist + 0.1 * wq.week_hist END', 'value', nudge=1e-9)}
 FROM rq JOIN hq ON hq.item_id = rq.item_id AND hq.store_id = rq.store_id AND hq.q = rq.q JOIN wq ON wq.item_id = rq.item_id AND wq.store_id = rq.store_id AND wq.q = rq.q AND wq.weekpos = (rq.step - 1) % 7 WHERE level = 12""",
    "grid lastday fc7",
)
def blended_quantiles(t):
    t = t.staged
    recent = t.grid_between(t.last_day - 364, t.last_day)
    keys = ["item_id", "store_id", "state_id"]
    profiles = E.quantile_profiles(recent, keys, [364, 28], [1.0, 1.75], [13, 3])
    return rounded(E.blend_quantiles(E.ratio_quantiles(X.fc7(t), "evaluation"), profiles), ["value"], nudge=1e-9)


@query(
    "smooth_horizon",
    """WITH w AS (SELECT id, step, sum(forecast * pow(1 - 1 / 1.04::DOUBLE, 1 - step)) OVER x AS n, sum(pow(1 - 1 / 1.04::DOUBLE, 1 - step)) OVER x AS m FROM fc7 WINDOW x AS (PARTITION BY id ORDER BY step))
 SELECT id, step, round(n / m, 6) + 0.0::DOUBLE AS value FROM w""",
    "fc7",
)
def smooth_horizon(t):
    """Exponential smoothing along F1..F28 of the wide forecast (com 0.04 is span 1.08)."""
    from tidegrid.operators.reshape import pivot_horizon, unpivot_horizon
    from tidegrid.operators.windows import ewm_mean

    wide = pivot_horizon(X.fc7(t), ["id"], "step", "forecast", HORIZON)
    long = unpivot_horizon(wide, ["id"], HORIZON)
    out = ewm_mean(long, ["id"], {"smooth": 1.08}, "step", "value", need={"smooth": 1})
    return rounded(out.drop("value").withColumnRenamed("smooth", "value"), ["value"])


# --- sample forecasts: the last 28 days of each weekday act as sample paths ---------------

def week_samples(t):
    recent = t.grid_between(t.last_day - 364, t.last_day)
    return recent.select(
        "id", "store_id", "item_id", ((t.last_day - F.col("d")) % 7 + 1).alias("step"),
        F.floor((t.last_day - F.col("d")) / 7).cast("int").alias("sample"), F.col("sales").alias("value"),
    )


SAMPLES = "sm AS (SELECT id, store_id, item_id, CAST((e - d) % 7 + 1 AS INT) AS step, CAST((e - d) // 7 AS INT) AS sample, sales AS value FROM grid, lastday WHERE d > e - 364)"


def _pick(p):
    return f"list_sort(list(value))[CAST(round_even((count(*) - 1) * {p}, 0) AS INT) + 1]"


@query(
    "sample_quantiles",
    f"WITH {SAMPLES} SELECT id, step, round(avg(value), 6) AS mean, {_pick(0.1)} AS q0, {_pick(0.5)} AS q1, {_pick(0.9)} AS q2 FROM sm GROUP BY id, step",
    "grid lastday",
)
def sample_quantiles(t):
    return rounded(E.sample_quantiles(week_samples(t), ["id", "step"], PROBS), ["mean"])


@query(
    "sample_dimension_ops",
    f"""WITH {SAMPLES} SELECT 'one' AS kind, item_id, step, sample, value FROM sm WHERE store_id = 'NATION_5' UNION ALL
 SELECT 'sum', item_id, step, sample, sum(value) FROM sm GROUP BY item_id, step, sample""",
    "grid lastday",
)
def sample_dimension_ops(t):
    samples = week_samples(t).drop("id")
    one = E.copy_dim(samples, "store_id", "NATION_5").withColumn("kind", F.lit("one"))
    total = E.copy_aggregate(samples, ["item_id", "step", "sample"], F.sum).withColumn("kind", F.lit("sum"))
    return one.unionByName(total)


@query(
    "forecast_json",
    f"""WITH {SAMPLES}, q AS (SELECT id, step, avg(value) AS mean, {_pick(0.1)} AS q0, {_pick(0.5)} AS q1, {_pick(0.9)} AS q2 FROM sm GROUP BY id, step),
 m AS (SELECT id, list(mean ORDER BY step) AS mean, list(q0 ORDER BY step) AS q0, list(q1 ORDER BY step) AS q1, list(q2 ORDER BY step) AS q2 FROM q GROUP BY id),
 s AS (SELECT id, sample, list(value ORDER BY step) AS v FROM sm GROUP BY id, sample), p AS (SELECT id, list(v ORDER BY sample) AS samples FROM s GROUP BY id)
 SELECT m.id, CAST(to_json({{'mean': mean, 'quantiles': {{'0.1': q0, '0.5': q1, '0.9': q2}}, 'samples': samples}}) AS VARCHAR) AS document FROM m JOIN p ON p.id = m.id""",
    "grid lastday",
)
def forecast_json(t):
    """Mean, three quantiles and all sample paths of every series."""
    samples = week_samples(t)
    q = E.sample_quantiles(samples, ["id", "step"], PROBS)
    return E.forecast_json(q, ["id"], {"0.1": "q0", "0.5": "q1", "0.9": "q2"}, samples=samples)
