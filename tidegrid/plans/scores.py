"""Queries over accuracy measures on the held-out last 28 days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import forecast as C
from tidegrid.operators import metrics as M
from tidegrid.operators.regression import asymmetric_loss
from tidegrid.plans import frames as X
from tidegrid.plans.flagship import HORIZON, LEVEL, WRMSSE, gsets, wrmsse_sql
from tidegrid.plans.forecasts import LEVELED, NAIVE2_OUT, NAIVE2_SQL
from tidegrid.plans.helpers import rnd, rounded
from tidegrid.plans.registry import query
from tidegrid.plans.reshape import NAME_CASE
from tidegrid.sources.files import checkpoint_table

Q = X.QCOLS


@query(
    "rmsse_per_series",
    """WITH s AS (SELECT id, sales - lag(sales) OVER w AS j, max(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM grid, lastday WHERE d <= e - 28 WINDOW w AS (PARTITION BY id ORDER BY d)),
 k AS (SELECT id, avg(CASE WHEN st = 1 THEN j * j END) AS scale FROM s GROUP BY id), m AS (SELECT id, avg(pow(y - forecast, 2)) AS mse FROM ev GROUP BY id)
 SELECT m.id, round(sqrt(mse / nullif(scale, 0)), 6) AS rmsse FROM m JOIN k ON k.id = m.id""",
    "grid lastday ev",
)
def rmsse_per_series(t):
    scale = M.naive_scale(t.staged.grid_between(F.lit(0), X.cut_day(t)), ["id"])
    pair = X.actuals(t).join(X.fc7(t).select("id", "step", "forecast"), ["id", "step"])
    return rounded(M.rmsse(pair, scale, ["id"]), ["rmsse"])


@query(
    "rmsse_squared",
    """WITH s AS (SELECT id, sales - lag(sales) OVER w AS j, max(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM grid, lastday WHERE d <= e - 28 WINDOW w AS (PARTITION BY id ORDER BY d)),
 k AS (SELECT id, avg(CASE WHEN st = 1 THEN j * j END) AS scale FROM s GROUP BY id), m AS (SELECT id, avg(pow(y - forecast, 2)) AS mse FROM ev GROUP BY id)
 SELECT m.id, round(mse / nullif(scale, 0), 6) AS rmsse FROM m JOIN k ON k.id = m.id""",
    "grid lastday ev",
)
def rmsse_squared(t):
    """The scaled error without the root."""
    scale = M.naive_scale(t.staged.grid_between(F.lit(0), X.cut_day(t)), ["id"])
    pair = X.actuals(t).join(X.fc7(t).select("id", "step", "forecast"), ["id", "step"])
    return rounded(M.rmsse(pair, scale, ["id"], rooted=False), ["rmsse"])


def _wspl_rows():
    return " UNION ALL ".join(
        f"SELECT e.store_id, e.id, {q} AS q, CASE WHEN y >= {c} THEN {q} * (y - {c}) ELSE (1 - {q}) * ({c} - y) END AS loss, s.seasonal_error AS vol, mean AS w FROM ev e JOIN serr s ON s.id = e.id"
        for q, c in Q.items())


@query(
    "weighted_scaled_pinball",
    f"WITH r AS ({_wspl_rows()}) SELECT store_id, CAST(q AS DOUBLE) AS q, round(avg(w * loss / nullif(vol, 0)) / avg(w), 6) AS wspl FROM r GROUP BY ALL",
    "ev serr",
)
def weighted_scaled_pinball(t):
    rows = X.ev(t).join(X.serr(t), "id").withColumnRenamed("mean", "weight").withColumnRenamed("seasonal_error", "vol")
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("value")) for q, c in Q.items()])
    long = rows.select("store_id", "y", "weight", "vol", F.explode(pairs).alias("p")).select("store_id", "y", "weight", "vol", "p.*")
    return rounded(M.wspl(long, ["store_id", "q"]), ["wspl"])


def _pin(q, c):
    return f"CASE WHEN y >= {c} THEN {q} * (y - {c}) ELSE (1 - {q}) * ({c} - y) END"


@query(
    "loss_columns",
    "WITH l AS (SELECT id, step, " + ", ".join(f"{_pin(q, c)} AS loss_{c}" for q, c in Q.items()) + " FROM ev) SELECT id, step, "
    + ", ".join(rnd(f"loss_{c}", f"loss_{c}") for c in Q.values()) + f", {rnd('loss_q10 + loss_q50 + loss_q90', 'loss_sum')}, {rnd('(loss_q10 + loss_q50 + loss_q90) * step', 'loss_weighted')} FROM l",
    "ev",
)
def loss_columns(t):
    out = M.loss_columns(X.ev(t), Q, "step").select("id", "step", *[f"loss_{c}" for c in Q.values()], "loss_sum", "loss_weighted")
    return rounded(out, out.columns[2:])


def _flat(n, d):
    return f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / {d} END"


def _per(keys, ev="ev", serr="serr", on="e.id = s.id"):
    return f"""SELECT {keys}, avg(pow(y - mean, 2)) AS mse, sum(abs(y - q50)) AS abs_error, sum(abs(y)) AS abs_target_sum, avg(abs(y)) AS abs_target_mean, any_value(s.seasonal_error) AS seasonal_error,
 avg({_flat('abs(y - q50)', 'abs(y)')}) AS mape, 2 * avg({_flat('abs(y - q50)', '(abs(y) + abs(q50))')}) AS smape,
 {', '.join(f'sum(2 * abs(({c} - y) * (CAST(y <= {c} AS DOUBLE) - {q}))) AS ql_{c}, avg(CAST(y < {c} AS DOUBLE)) AS cov_{c}' for q, c in Q.items())},
 CASE WHEN any_value(s.seasonal_error) = 0 THEN 0 ELSE avg(abs(y - q50)) / any_value(s.seasonal_error) END AS mase,
 CASE WHEN any_value(s.seasonal_error) = 0 THEN 0 ELSE avg(q90 - q10 + 40 * (q10 - y) * CAST(y < q10 AS INT) + 40 * (y - q90) * CAST(y > q90 AS INT)) / any_value(s.seasonal_error) END AS msis
 FROM {ev} e JOIN {serr} s ON {on} GROUP BY {keys}"""


METRICS = ["mse", "abs_error", "abs_target_sum", "abs_target_mean", "seasonal_error", "mape", "smape", "mase", "msis"] + [f"{p}_{c}" for c in Q.values() for p in ("ql", "cov")]


@query("metrics_per_series", f"WITH m AS ({_per('e.id')}) SELECT id, " + ", ".join(rnd(c, c) for c in METRICS) + " FROM m", "ev serr")
def metrics_per_series(t):
    out = M.evaluate(X.ev(t), X.serr(t), ["id"], Q, "q50", "mean")
    return rounded(out, METRICS)


def _total(m, by=""):
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}avg(mse) AS mse, avg(abs_target_mean) AS abs_target_mean, avg(seasonal_error) AS seasonal_error, avg(mase) AS mase, avg(mape) AS mape, avg(smape) AS smape, avg(msis) AS msis,
 sum(abs_error) AS abs_error, sum(abs_target_sum) AS abs_target_sum, {', '.join(f'sum(ql_{c}) AS ql_{c}, avg(cov_{c}) AS cov_{c}' for c in Q.values())} FROM {m} {f'GROUP BY {by}' if by else ''}"""


TOTALS = ["mse", "abs_target_mean", "seasonal_error", "mase", "mape", "smape", "msis", "abs_error", "abs_target_sum"] + [f"{p}_{c}" for c in Q.values() for p in ("ql", "cov")]


def _derived(src, lead=""):
    wql = [f"ql_{c} / nullif(abs_target_sum, 0)" for c in Q.values()]
    cov = [f"abs(cov_{c} - {q})" for q, c in Q.items()]
    extra = [rnd("sqrt(mse)", "rmse"), rnd(_flat("sqrt(mse)", "abs_target_mean"), "nrmse"), rnd(_flat("abs_error", "abs_target_sum"), "nd")]
    extra += [rnd(w, f"wql_{c}") for w, c in zip(wql, Q.values())]
    extra += [rnd(f"({' + '.join(wql)}) / 3", "mean_wql"), rnd(f"({' + '.join(cov)}) / 3", "mae_coverage")]
    return f"SELECT {lead}{', '.join([rnd(c, c) for c in TOTALS] + extra)} FROM {src}"


@query("metrics_total", f"WITH m AS ({_per('e.id')}), a AS ({_total('m')}) {_derived('a')}", "ev serr")
def metrics_total(t):
    out = M.aggregate_metrics(M.evaluate(X.ev(t), X.serr(t), ["id"], Q, "q50", "mean"), Q)
    return rounded(out, out.columns)


def _combined_sql(how):
    """Views of one way of combining the stores of an item: forecasts, history, its seasonal error, metrics."""
    return f"""es_{how} AS (SELECT item_id, step, {how}(y) AS y, {how}(mean) AS mean, {how}(q10) AS q10, {how}(q50) AS q50, {how}(q90) AS q90 FROM ev GROUP BY ALL),
 gs_{how} AS (SELECT item_id, d, {how}(sales) AS sales FROM grid, lastday WHERE d <= e - 28 GROUP BY ALL),
 ss_{how} AS (SELECT item_id, CASE WHEN count(*) > 7 THEN avg(m) ELSE avg(o) END AS seasonal_error FROM (SELECT item_id, abs(sales - lag(sales, 7) OVER w) AS m, abs(sales - lag(sales) OVER w) AS o FROM gs_{how} WINDOW w AS (PARTITION BY item_id ORDER BY d)) GROUP BY item_id),
 ms_{how} AS ({_per('e.item_id', f'es_{how}', f'ss_{how}', 'e.item_id = s.item_id')})"""


@query(
    "metrics_multivariate",
    f"""WITH m AS ({_per('e.item_id, e.store_id')}), {_combined_sql('sum')}, {_combined_sql('max')},
 a AS (SELECT store_id AS scope, * EXCLUDE (store_id) FROM ({_total('m', 'store_id')}) UNION ALL SELECT 'all' AS scope, * FROM ({_total('m')}) UNION ALL SELECT 'sum', * FROM ({_total('ms_sum')}) UNION ALL SELECT 'max', * FROM ({_total('ms_max')}))
 {_derived('a', 'scope, ')}""",
    "ev serr grid lastday",
)
def metrics_multivariate(t):
    """Stores are the dimensions of each item, combined by their sum and by their largest."""
    past = t.staged.grid_between(F.lit(0), X.cut_day(t))
    errors = M.seasonal_error_observed(t.staged.panel, ["item_id", "store_id"], 7, X.cut_day(t))
    combined = {}
    for name, how in (("sum", F.sum), ("max", F.max)):
        together = past.groupBy("item_id", "d").agg(how("sales").alias("sales"))
        combined[name] = (how, M.seasonal_error(together, ["item_id"], 7))
    out = M.evaluate_multivariate(X.ev(t), "item_id", "store_id", errors, combined, Q, "q50", "mean")
    return rounded(out, [c for c in out.columns if c != "scope"])


TRAINED = """tr AS (SELECT g.* FROM grid g, lastday WHERE d <= e - 28), n7 AS (SELECT id, sales, avg(sales) OVER (PARTITION BY id) AS m, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS back FROM tr, lastday WHERE d > e - 35),
 fc AS (SELECT id, unnest(CASE WHEN n = 7 THEN range(8 - back, 29, 7) WHEN back = 1 THEN range(1, 29) ELSE [] END) AS step, CASE WHEN n = 7 THEN sales ELSE m END AS forecast FROM n7),
 se AS (SELECT id, CASE WHEN count(*) > 7 THEN avg(m) ELSE avg(o) END AS seasonal_error FROM (SELECT id, abs(sales - lag(sales, 7) OVER w) AS m, abs(sales - lag(sales) OVER w) AS o FROM tr WINDOW w AS (PARTITION BY id ORDER BY d)) GROUP BY id)"""


def _zero(n, d):
    return f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / {d} END"


#: The season-adjusted naive forecast of the training days; its view of trends is renamed beside ``tr``.
TRAINED_NAIVE2 = f"{NAIVE2_SQL}, {NAIVE2_OUT}".replace(" tr AS (", " tq AS (").replace("FROM tr ", "FROM tq ").replace("FROM grid", "FROM tr")
OWA_SQL = f"""WITH {TRAINED}, {TRAINED_NAIVE2},
 j AS (SELECT g.id, g.sales AS y, fc.forecast, n2.forecast AS naive FROM grid g CROSS JOIN lastday JOIN fc ON fc.id = g.id AND g.d = e - 28 + fc.step JOIN n2 ON n2.id = g.id AND n2.step = fc.step),
 p AS (SELECT id, 2 * avg({_flat('abs(y - forecast)', '(abs(y) + abs(forecast))')}) AS s, 2 * avg({_flat('abs(y - naive)', '(abs(y) + abs(naive))')}) AS sn, avg(abs(y - forecast)) AS a, avg(abs(y - naive)) AS an FROM j GROUP BY id),
 q AS (SELECT p.*, {_zero('a', 'seasonal_error')} AS m, {_zero('an', 'seasonal_error')} AS mn FROM p JOIN se ON se.id = p.id)
 SELECT id, round(0.5 * (s / nullif(sn, 0) + m / nullif(mn, 0)), 6) AS owa FROM q"""


@query("owa_against_naive2", OWA_SQL, "grid lastday")
@query("owa", OWA_SQL, "grid lastday")
def owa(t):
    """Seasonal naive against the season-adjusted naive forecast."""
    t = t.staged
    cut = X.cut_day(t)
    past = checkpoint_table(t.grid.filter(F.col("d") <= cut).select("id", "d", "sales"), "past")
    y = X.actuals(t).select("id", "step", "y")
    fc = C.seasonal_naive(past.filter(F.col("d") > cut - 7), ["id"], HORIZON, 7)
    ref = C.naive2(past, ["id"], HORIZON, 7).withColumnRenamed("forecast", "naive")
    joined = y.join(fc, ["id", "step"]).join(ref, ["id", "step"])
    return rounded(M.owa(joined, M.seasonal_error_observed(t.panel, ["id"], 7, cut), ["id"]), ["owa"])


@query(
    "weighted_pinball_by_level",
    f"""WITH {LEVELED}, recent AS (SELECT g.*, CAST(d - (e - 28) AS INT) AS step, CAST(d - (e - 56) AS INT) AS back FROM grid g, lastday WHERE d > e - 56),
 ya AS (SELECT level, {NAME_CASE} AS series, step, s AS y FROM (SELECT {LEVEL} AS level, state_id, store_id, cat_id, dept_id, item_id, step, sum(sales) AS s FROM recent WHERE step >= 1 GROUP BY {gsets('step')})),
 yb AS (SELECT level, {NAME_CASE} AS series, back, s FROM (SELECT {LEVEL} AS level, state_id, store_id, cat_id, dept_id, item_id, back, sum(sales) AS s FROM recent WHERE back <= 28 GROUP BY {gsets('back')})),
 v AS (SELECT level, series, avg(j) AS vol FROM (SELECT level, series, abs(s - lag(s) OVER (PARTITION BY level, series ORDER BY back)) AS j FROM yb) GROUP BY ALL),
 l AS (SELECT rq.level, rq.q, v.vol, CASE WHEN y >= value THEN rq.q * (y - value) ELSE (1 - rq.q) * (value - y) END AS loss FROM rq JOIN ya ON ya.level = rq.level AND ya.series = rq.series AND ya.step = rq.step JOIN v ON v.level = rq.level AND v.series = rq.series)
 SELECT level, q, {rnd('avg(loss / nullif(vol, 0))', 'wspl')} FROM l GROUP BY level, q""",
    "grid lastday fc7",
)
def weighted_pinball_by_level(t):
    """Mean pinball loss over each level's volatility, for every level and quantile."""
    from tidegrid.operators.ensemble import ratio_quantiles
    from tidegrid.operators.hierarchy import level_series_id, rollup_hierarchy
    from tidegrid.operators.windows import trailing_vol

    t = t.staged
    named = lambda df: df.withColumn("series", level_series_id())
    actual = named(rollup_hierarchy(X.actuals(t), ["y"], ["step"])).select("level", "series", "step", "y")
    back = X.history(t).withColumn("back", F.col("d"))
    past = named(rollup_hierarchy(back, ["sales"], ["back"])).select("level", "series", "back", "sales")
    vol = trailing_vol(past, ["level", "series"], "back").groupBy("level", "series").agg(F.max_by("trailing_vol", "back").alias("vol"))
    rows = ratio_quantiles(X.fc7(t), "evaluation").select("level", "series", "step", "q", "value").join(actual, ["level", "series", "step"]).join(vol, ["level", "series"])
    return rounded(M.wspl(rows.withColumn("weight", F.lit(1.0)), ["level", "q"]), ["wspl"])


@query(
    "backtest",
    f"""WITH {TRAINED},
 j AS (SELECT g.id, g.sales AS y, fc.forecast FROM grid g CROSS JOIN lastday JOIN fc ON fc.id = g.id AND g.d = e - 28 + fc.step),
 p AS (SELECT j.id, avg(pow(y - forecast, 2)) AS mse, sum(abs(y - forecast)) AS ae, sum(abs(y)) AS ts, avg(abs(y)) AS tm, avg({_flat('abs(y - forecast)', 'abs(y)')}) AS mape, 2 * avg({_flat('abs(y - forecast)', '(abs(y) + abs(forecast))')}) AS smape,
  CASE WHEN any_value(se.seasonal_error) = 0 THEN 0 ELSE avg(abs(y - forecast)) / any_value(se.seasonal_error) END AS mase, CASE WHEN any_value(se.seasonal_error) = 0 THEN 0 ELSE avg(40 * abs(y - forecast)) / any_value(se.seasonal_error) END AS msis, any_value(se.seasonal_error) AS se, sum(2 * abs((forecast - y) * (CAST(y <= forecast AS DOUBLE) - 0.5))) AS ql, avg(CAST(y < forecast AS DOUBLE)) AS cov FROM j JOIN se ON se.id = j.id GROUP BY j.id),
 st AS (SELECT count(*) AS n, CAST(sum(c) AS BIGINT) AS o, sum(s) / sum(c) AS m, max(c) AS ml FROM (SELECT id, count(*) AS c, sum(sales) AS s FROM tr GROUP BY id))
 SELECT {rnd('avg(mse)', 'mse')}, {rnd('avg(tm)', 'abs_target_mean')}, {rnd('avg(se)', 'seasonal_error')}, {rnd('avg(mase)', 'mase')}, {rnd('avg(mape)', 'mape')}, {rnd('avg(smape)', 'smape')}, {rnd('avg(msis)', 'msis')},
 {rnd('sum(ae)', 'abs_error')}, {rnd('sum(ts)', 'abs_target_sum')}, {rnd('sum(ql)', 'ql_forecast')}, {rnd('avg(cov)', 'cov_forecast')}, {rnd('sqrt(avg(mse))', 'rmse')}, {rnd('sqrt(avg(mse)) / avg(tm)', 'nrmse')}, {rnd('sum(ae) / sum(ts)', 'nd')},
 {rnd('sum(ql) / sum(ts)', 'wql_forecast')}, {rnd('sum(ql) / sum(ts)', 'mean_wql')}, {rnd('abs(avg(cov) - 0.5)', 'mae_coverage')}, any_value(st.n) AS train_num_series, any_value(st.o) AS train_num_observations, {rnd('any_value(st.m)', 'train_mean_target')}, any_value(st.ml) AS train_max_length FROM p, st""",
    "grid lastday",
)
def backtest(t):
    naive = lambda past, keys: C.seasonal_naive(past.filter(F.col("d") > t.last_day - HORIZON - 7), keys, HORIZON, 7)
    out = M.backtest(t.grid, naive, ["id"], HORIZON, 7)
    whole = ("train_num_series", "train_num_observations", "train_max_length")
    return rounded(out, [c for c in out.columns if c not in whole])


@query(
    "holdout_scores",
    """WITH b AS (SELECT id, d, sales, f.fold, e - f.k AS cut FROM grid, lastday, (VALUES ('recent', 28), ('middle', 56), ('early', 84)) f(fold, k)),
 tl AS (SELECT fold, id, sales, count(*) OVER (PARTITION BY fold, id) AS n, avg(sales) OVER (PARTITION BY fold, id) AS m, row_number() OVER (PARTITION BY fold, id ORDER BY d DESC) AS back FROM b WHERE d > cut - 7 AND d <= cut),
 f AS (SELECT fold, id, unnest(CASE WHEN n = 7 THEN range(8 - back, 29, 7) WHEN back = 1 THEN range(1, 29) ELSE [] END) AS step, CASE WHEN n = 7 THEN sales ELSE m END AS forecast FROM tl)
 SELECT b.fold, 'rmse' AS metric, round(sqrt(avg(pow(b.sales - f.forecast, 2))), 6) AS value FROM b JOIN f ON f.fold = b.fold AND f.id = b.id AND b.d = b.cut + f.step GROUP BY b.fold""",
    "grid lastday",
)
def holdout_scores(t):
    t = t.staged
    recent = t.grid_between(t.last_day - 28 * 4, t.last_day)
    cuts = {"recent": t.last_day - 28, "middle": t.last_day - 56, "early": t.last_day - 84}
    parts = None
    for fold, cut in cuts.items():
        past = recent.filter((F.col("d") > cut - 7) & (F.col("d") <= cut))
        fc = C.seasonal_naive(past, ["id"], HORIZON, 7).withColumn("fold", F.lit(fold))
        parts = fc if parts is None else parts.unionByName(fc)
    return rounded(M.score_folds(recent, parts, ["id"], cuts, HORIZON), ["value"])


@query(
    "holdout_wrmsse",
    f"""WITH {wrmsse_sql('fc7', '_a')}, {wrmsse_sql('fcm', '_b')}, a AS (SELECT level, {WRMSSE} AS x FROM per_a GROUP BY level), b AS (SELECT level, {WRMSSE} AS x FROM per_b GROUP BY level)
 SELECT 'naive' AS forecast, round(avg(x), 6) AS value FROM a UNION ALL SELECT 'mean', round(avg(x), 6) FROM b""",
    "grid prices lastday fc7 fcm",
)
def holdout_wrmsse(t):
    """Mean weighted scaled error over levels, for two forecasts of the same holdout."""
    t = t.staged
    cut = X.cut_day(t)
    revenue = M.recent_revenue(t.panel, t.prices, t.calendar, cut, HORIZON)
    naive = M.wrmsse_levels(t.panel, X.fc7(t), revenue, cut).agg(F.avg("wrmsse").alias("value"))
    mean = M.wrmsse_levels(t.panel, X.fcm(t), revenue, cut).agg(F.avg("wrmsse").alias("value"))
    both = naive.withColumn("forecast", F.lit("naive")).unionByName(mean.withColumn("forecast", F.lit("mean")))
    return rounded(both, ["value"])


@query(
    "training_losses",
    f"""WITH w AS (SELECT id, abs(sales - lag(sales, 7) OVER (PARTITION BY id ORDER BY d)) AS j FROM grid, lastday WHERE d > e - 56), s AS (SELECT id, avg(j) / nullif(count(j), 0) AS err FROM w GROUP BY id)
 SELECT e.id, round(200.0 / 28 * avg({_flat('abs(y - forecast)', '(abs(y) + abs(forecast))')}), 6) AS smape100, round(100.0 / 28 * avg({_flat('abs(y - forecast)', 'abs(y)')}), 6) AS mape100,
 {rnd(_zero('avg(abs(y - forecast))', 'any_value(s.err)'), 'mase_n', 5, nudge=1e-9)} FROM ev e JOIN s ON s.id = e.id GROUP BY e.id""",
    "ev grid lastday",
)
def training_losses(t):
    t = t.staged
    cut = X.cut_day(t)
    pair = X.actuals(t).join(X.fc7(t).select("id", "step", "forecast"), ["id", "step"])
    pair = pair.join(X.hist(t).select("id"), "id", "left_semi")
    whole = t.grid_between(cut - HORIZON, cut + HORIZON).select("id", "d", "sales")
    return rounded(rounded(M.training_losses(pair, whole, ["id"], HORIZON, 7), ["smape100", "mape100"]), ["mase_n"], 5, nudge=1e-9)


@query(
    "empirical_cdf",
    f"""WITH b AS (SELECT store_id, min(sales) AS lo, max(sales) AS hi, count(*) AS n FROM panel GROUP BY store_id),
 h AS (SELECT p.store_id, least(CAST(floor((sales - lo) / ((hi - lo) / 10)) AS INT), 9) AS bin, count(*) AS n FROM panel p JOIN b ON b.store_id = p.store_id GROUP BY ALL),
 d AS (SELECT b.store_id, b.n AS total, lo, hi, k.bin, coalesce(h.n, 0) AS n FROM b CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin) k LEFT JOIN h ON h.store_id = b.store_id AND h.bin = k.bin)
 SELECT store_id, bin, n, {rnd('lo + (bin + 1) * ((hi - lo) / 10)', 'edge')}, {rnd('sum(n) OVER (PARTITION BY store_id ORDER BY bin) / total', 'cdf')} FROM d""",
    "panel",
)
def empirical_cdf(t):
    return rounded(M.empirical_cdf(t.panel, "store_id", "sales", 10), ["edge", "cdf"])


@query("crps_from_quantiles", f"SELECT id, round(avg(({' + '.join(f'2 * ({_pin(q, c)})' for q, c in Q.items())}) / 3), 6) AS crps FROM ev GROUP BY id", "ev")
def crps_from_quantiles(t):
    return rounded(M.crps_quantiles(X.ev(t), ["id"], Q), ["crps"])


@query(
    "asymmetric_loss",
    "SELECT store_id, round(avg(CASE WHEN y - forecast < 0 THEN pow(y - forecast, 2) ELSE pow(y - forecast, 2) * 1.15 END), 6) AS loss FROM ev GROUP BY store_id",
    "ev",
)
def asymmetric_loss_query(t):
    pair = X.actuals(t).join(X.fc7(t).select("id", "step", "forecast"), ["id", "step"]).join(X.hist(t).select("id"), "id", "left_semi")
    return rounded(asymmetric_loss(pair, ["store_id"], "y", "forecast", 1.15), ["loss"])
