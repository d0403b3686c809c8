"""Queries that fit and apply regressions, on the gap-free item x store grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import regression as R
from tidegrid.operators.ranking import ROUNDS, round_keys
from tidegrid.operators.windows import add_lags, rolling
from tidegrid.plans.flagship import HORIZON
from tidegrid.plans.helpers import rnd, rounded
from tidegrid.plans.registry import query
from tidegrid.sources.files import checkpoint_table

FEATURES = ["m7", "m28", "lag_28", "weekend"]


def model_rows(t, grid=None):
    """Target and features that look back at least one horizon; written once, read by every iteration."""
    base = (grid or t.grid).select("id", "dept_id", "store_id", "d", "sales")
    feats = rolling(base, ["id"], [(HORIZON, 7), (HORIZON, 28)], std=False, whole=True)
    feats = add_lags(feats, ["id"], [HORIZON]).withColumnsRenamed({"roll_mean_28_7": "m7", "roll_mean_28_28": "m28"})
    feats = feats.withColumn("weekend", (F.col("d") % 7 >= 5).cast("double"))
    scaled = feats.withColumns({c: F.col(c) / 10 for c in ("m7", "m28", "lag_28")})
    return checkpoint_table(scaled.na.drop(), "model-rows")


def _rows_sql(grid):
    over = "OVER (PARTITION BY id ORDER BY d ROWS BETWEEN {} PRECEDING AND 28 PRECEDING)"
    return f"""mr AS (SELECT id, dept_id, store_id, d, sales, m7 / 10 AS m7, m28 / 10 AS m28 FROM (SELECT *, avg(sales) {over.format(34)} AS m7, avg(sales) {over.format(55)} AS m28,
 row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM {grid}) WHERE k > 55)"""


def _summary(scored, keys):
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("sales").alias("mean_sales"), F.avg("forecast").alias("mean_forecast"),
        F.sqrt(F.avg(F.pow(F.col("sales") - F.col("forecast"), F.lit(2.0)))).alias("rmse"),
    )


@query(
    "fit_local",
    f"SELECT id, count(*) AS n, {rnd('regr_intercept(sales, d / 1000.0::DOUBLE)', 'intercept', 3)}, {rnd('regr_slope(sales, d / 1000.0::DOUBLE)', 'slope', 3)} FROM grid GROUP BY id",
    "grid",
)
def fit_local(t):
    """One least-squares trend per series, all series in one aggregate."""
    rows = t.grid.select("id", (F.col("d") / 1000).alias("x"), "sales")
    beta = R.fit(rows, ["id"], ["x"], "sales", ridge=0.0)
    out = beta.select("id", "n", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope"))
    return rounded(out, ["intercept", "slope"], 3)


def _balance(t, family, slope, **kw):
    """The fit on all but the last 28 days, and whether it solves its equations: per store and feature, the sum of the
    rows' slopes must vanish beside the sum of their sizes."""
    rows = model_rows(t).filter(F.col("d") <= t.last_day - HORIZON)
    beta = R.fit(rows, ["store_id"], FEATURES, "sales", family, **kw)
    scored = R.predict(rows, beta.drop("n"), ["store_id"], FEATURES, family)
    sizes = [F.try_divide(F.abs(F.sum(slope * F.col(f))), F.sum(F.abs(slope * F.col(f)))) for f in FEATURES]
    out = scored.groupBy("store_id").agg(
        F.count("*").alias("n"), F.avg("sales").alias("mean_sales"), F.avg("forecast").alias("mean_forecast"),
        (F.greatest(F.try_divide(F.abs(F.sum(slope)), F.sum(F.abs(slope))), *sizes) < 1e-6).alias("balanced"),
    )
    return rounded(out.join(beta.select("store_id", "converged"), "store_id"), ["mean_sales", "mean_forecast"], 4)


def _balance_sql(forecast):
    return f"WITH {_rows_sql('grid')} SELECT store_id, count(*) AS n, {rnd('avg(sales)', 'mean_sales', 4)}, {forecast}TRUE AS balanced, TRUE AS converged FROM mr, lastday WHERE d <= e - 28 GROUP BY store_id"


@query("fit_by_store_poisson", _balance_sql(rnd("avg(sales)", "mean_forecast", 4) + ", "), "grid lastday")
def fit_by_store_poisson(t):
    """With an intercept the fitted mean of the training rows is their mean."""
    return _balance(t, "poisson", F.col("sales") - F.col("forecast"))


@query("fit_by_store_tweedie", _balance_sql(""), "grid lastday")
def fit_by_store_tweedie(t):
    return _balance(t, "tweedie", (F.col("sales") - F.col("forecast")) * F.pow("forecast", F.lit(-0.1))).drop("mean_forecast")


@query("fit_by_store_asymmetric", _balance_sql(""), "grid lastday")
def fit_by_store_asymmetric(t):
    e = F.col("sales") - F.col("forecast")
    return _balance(t, "asymmetric", F.when(e < 0, e).otherwise(1.15 * e), multiplier=1.15).drop("mean_forecast")


PARTS = [0.25, 0.5, 0.75]


@query(
    "fit_quantile_regressions",
    f"WITH {_rows_sql('dgrid')} SELECT dept_id, q, count(*) AS n, TRUE AS converged, TRUE AS covered FROM mr, (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS q) GROUP BY ALL",
    "dgrid",
)
def fit_quantile_regressions(t):
    """On the department x store level, where sales have quantiles other than zero. ``covered``: the share of rows below is
    within 0.02 of the quantile, or steps over it at equal values."""
    rows = model_rows(t, t.dept_grid)
    beta = R.fit_quantiles(rows, ["dept_id"], FEATURES, "sales", PARTS)
    scored = rows.join(beta.drop("n"), "dept_id").withColumn("forecast", R._linear(FEATURES))
    near = F.col("sales") - F.col("forecast")
    out = scored.groupBy("dept_id", "q").agg(
        F.count("*").alias("n"), F.bool_and("converged").alias("converged"),
        F.avg((near < -0.5).cast("double")).alias("_lo"), F.avg((near <= 0.5).cast("double")).alias("_hi"),
    )
    return out.withColumn("covered", (F.col("_lo") - 0.02 <= F.col("q")) & (F.col("q") <= F.col("_hi") + 0.02)).drop("_lo", "_hi")


@query("fit_pooled_tweedie")
def fit_pooled_tweedie(t):
    rows = model_rows(t)
    model = R.fit_count(rows, FEATURES, "sales", "tweedie", 1.1, 25)
    return _summary(model.transform(rows), ["dept_id"])


@query("fit_pooled_trees")
def fit_pooled_trees(t):
    rows = model_rows(t)
    cut = t.last_day - HORIZON
    model = R.fit_trees(rows.filter(F.col("d") <= cut), FEATURES, "sales", depth=3, rounds=3)
    return _summary(model.transform(rows.filter(F.col("d") > cut)), ["dept_id"])


@query("predict_direct")
def predict_direct(t):
    """All 28 days at once: every feature is at least a horizon old."""
    rows = model_rows(t)
    cut = t.last_day - HORIZON
    beta = R.fit(rows.filter(F.col("d") <= cut), ["store_id"], FEATURES, "sales", "poisson")
    scored = R.predict(rows.filter(F.col("d") > cut), beta, ["store_id"], FEATURES, "poisson")
    return scored.select("id", (F.col("d") - cut).alias("step"), "forecast")


def _stored_grid(t):
    grid = checkpoint_table(t.grid.select("id", "store_id", "d", "sales"), "grid")
    return grid, grid.agg(F.max("d")).first()[0] - HORIZON


@query("predict_recursive")
def predict_recursive(t):
    """Four weeks day by day: short means are recomputed from history and the days predicted so far."""
    grid, end = _stored_grid(t)
    recipe = [("lag", 1), ("lag", 7), ("mean", 1, 7), ("mean", 1, 28)]
    feats = R.history_features(grid.filter(F.col("d") <= end), ["id"], recipe, whole=True)
    beta = R.fit(feats, ["store_id"], [R.feature_name(f) for f in recipe], "sales")
    return R.predict_recursive(grid, checkpoint_table(beta, "beta"), ["id", "store_id"], ["store_id"], [1, 7], [7, 28], HORIZON, end, "gaussian")


@query("predict_staged")
def predict_staged(t):
    """Four models of a week each; the later ones read the earlier ones' days."""
    grid, end = _stored_grid(t)
    return R.predict_staged(grid, ["id"], ["store_id"], [7, 14, 21, 28], end, whole=True)


SEARCH = [{"ridge": r, "features": k} for r in (1e-6, 1.0, 100.0) for k in (2, 4)]


def _years(rows):
    return rows.withColumn("year", F.floor((F.col("d") - 1) / 365).cast("int"))


@query("parameter_search")
def parameter_search(t):
    """Leave one year out, four random parameter sets."""
    return R.tune(_years(model_rows(t)), "year", FEATURES, "sales", SEARCH, 4, 5)


@query(
    "parameter_search_ridge",
    f"""WITH {_rows_sql('grid')}, f AS (SELECT CAST((d - 1) // 365 AS INT) AS fold, count(*)::DOUBLE AS n, sum(m28) AS x, sum(m28 * m28) AS xx, sum(sales)::DOUBLE AS y, sum(m28 * sales) AS xy, sum(sales * sales)::DOUBLE AS yy FROM mr GROUP BY 1),
 o AS (SELECT f.*, r, sum(n) OVER w - n AS tn, sum(x) OVER w - x AS tx, sum(xx) OVER w - xx + r AS txx, sum(y) OVER w - y AS ty, sum(xy) OVER w - xy AS txy FROM f, (SELECT CAST(unnest([0.0, 1.0, 100.0]) AS DOUBLE) AS r) WINDOW w AS (PARTITION BY r)),
 b AS (SELECT *, (tn * txy - tx * ty) / (tn * txx - tx * tx) AS b1 FROM o), c AS (SELECT *, (ty - b1 * tx) / tn AS b0 FROM b)
 SELECT 'features=1,ridge=' || printf('%.1f', r) AS params, fold, {rnd('sqrt((yy - 2 * (b0 * y + b1 * xy) + b0 * b0 * n + 2 * b0 * b1 * x + b1 * b1 * xx) / n)', 'rmse', 5)} FROM c""",
    "grid",
)
def parameter_search_ridge(t):
    """Every ridge for the model of one feature, leaving one year out."""
    grid = [{"ridge": r, "features": 1} for r in (0.0, 1.0, 100.0)]
    return rounded(R.tune(_years(model_rows(t)), "year", ["m28"], "sales", grid, 3, 1), ["rmse"], 5)


@query("permutation_importance")
def permutation_importance(t):
    """Scored on the last 28 days, which the fit has not seen."""
    rows, cut = model_rows(t), t.last_day - HORIZON
    beta = R.fit(rows.filter(F.col("d") <= cut), ["store_id"], FEATURES, "sales")
    return R.permutation_importance(rows.filter(F.col("d") > cut), checkpoint_table(beta, "beta"), ["store_id"], ["id", "d"], FEATURES, "sales", 7)


def _permuted_sql(i, n, seed):
    """The swaps of ``keyed_permutation`` as one reduction."""
    partner = f"((([{', '.join(map(str, round_keys(seed)))}])[r] % {n} + {n} - x) % {n})"
    digit = f"('0x' || substr(md5('{seed}/' || r || '/' || greatest(x, {partner})), 1, 1))::BIGINT % 2"
    return f"list_reduce(list_concat([{i}], range(1, {ROUNDS + 1})), lambda x, r: CASE WHEN {digit} = 1 THEN {partner} ELSE x END)"


@query(
    "permutation_importance_mean",
    f"""WITH {_rows_sql('grid')}, b AS (SELECT store_id, regr_slope(sales, m28) AS b1, regr_intercept(sales, m28) AS b0 FROM mr, lastday WHERE d <= e - 28 GROUP BY store_id),
 p AS (SELECT mr.*, CAST(row_number() OVER (ORDER BY id, d) - 1 AS BIGINT) AS i, CAST(count(*) OVER () AS BIGINT) AS n FROM mr, lastday WHERE d > e - 28),
 q AS (SELECT *, {_permuted_sql('i', 'n', 7)} AS j FROM p), s AS (SELECT q.store_id, q.sales, q.m28, o.m28 AS other FROM q JOIN p o ON o.i = q.j)
 SELECT 'm28' AS feature, {rnd('sqrt(avg(pow(sales - b0 - b1 * other, 2))) - sqrt(avg(pow(sales - b0 - b1 * m28, 2)))', 'importance')} FROM s JOIN b USING (store_id)""",
    "grid lastday",
)
def permutation_importance_mean(t):
    rows, cut = model_rows(t), t.last_day - HORIZON
    beta = R.fit(rows.filter(F.col("d") <= cut), ["store_id"], ["m28"], "sales", ridge=0.0)
    out = R.permutation_importance(rows.filter(F.col("d") > cut), checkpoint_table(beta, "beta"), ["store_id"], ["id", "d"], ["m28"], "sales", 7)
    return rounded(out, ["importance"])
