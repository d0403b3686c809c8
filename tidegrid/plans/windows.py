"""Queries over per-series window features: lags and rolling ones on the gap-free grid, the rest on the days named."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import encode, windows as W
from tidegrid.operators.clean import mask_leading_zeros
from tidegrid.operators.forecast import _tail
from tidegrid.operators.metrics import naive_scale, seasonal_error
from tidegrid.operators.reshape import densify
from tidegrid.plans.helpers import rnd, rounded
from tidegrid.plans.registry import query

ID = ["id"]
WN = "WINDOW w AS (PARTITION BY id ORDER BY d)"
LAGS = [1, 2, 3, 7, 28]


@query("lags", "SELECT id, d, sales, " + ", ".join(f"lag(sales, {n}) OVER w AS lag_{n}" for n in LAGS) + f" FROM grid {WN}", "grid")
def lags(t):
    return W.add_lags(t.grid.select("id", "d", "sales"), ID, LAGS)


def _frame(s, n):
    return f"(PARTITION BY id ORDER BY d ROWS BETWEEN {s + n - 1} PRECEDING AND {s} PRECEDING)"


def _roll_sql(specs, std=True, src="grid"):
    cols = []
    for s, n in specs:
        f = _frame(s, n)
        guard = f"count(sales) OVER {f} = {n}"
        cols.append(rnd(f"CASE WHEN {guard} THEN avg(sales) OVER {f} END", f"roll_mean_{s}_{n}"))
        if std:
            cols.append(rnd(f"CASE WHEN {guard} THEN stddev_samp(sales) OVER {f} END", f"roll_std_{s}_{n}"))
    return f"SELECT id, d, {', '.join(cols)} FROM {src}"


SPECS = [(28, n) for n in (7, 14, 30, 60, 180)]


@query("rolling_shifted", _roll_sql(SPECS), "grid")
def rolling_shifted(t):
    out = W.rolling(t.grid.select("id", "d", "sales"), ID, SPECS, whole=True).drop("sales")
    return rounded(out, out.columns[2:])


TMP = [(s, n) for s in (1, 7, 14) for n in (7, 14, 30, 60)]


@query("rolling_several_shifts", _roll_sql(TMP, std=False), "grid")
def rolling_several_shifts(t):
    out = W.rolling(t.grid.select("id", "d", "sales"), ID, TMP, std=False, whole=True).drop("sales")
    return rounded(out, out.columns[2:])


@query(
    "rolling_of_lag",
    "WITH l AS (SELECT id, d, lag(sales, 7) OVER w AS a, lag(sales, 28) OVER w AS b FROM grid " + WN + ") SELECT id, d, "
    + ", ".join(rnd(f"CASE WHEN count({c}) OVER {_frame(0, n)} = {n} THEN avg({c}) OVER {_frame(0, n)} END", f"rmean_{l}_{n}")
                for c, l in (("a", 7), ("b", 28)) for n in (7, 28)) + " FROM l",
    "grid",
)
def rolling_of_lag(t):
    out = W.rolling(t.grid.select("id", "d", "sales"), ID, [(l, n) for l in (7, 28) for n in (7, 28)], std=False, name="r", whole=True).drop("sales")
    out = out.withColumnsRenamed({f"r_mean_{l}_{n}": f"rmean_{l}_{n}" for l in (7, 28) for n in (7, 28)})
    return rounded(out, out.columns[2:])


def _q(p, n=28):
    return rnd(f"CASE WHEN count(sales) OVER {_frame(0, n)} = {n} THEN quantile_cont(sales, {p}) OVER {_frame(0, n)} END", f"q{int(p * 100)}_{n}")


WIDTHS, TENTHS = [28, 60, 112], [0.1, 0.5, 0.9]


@query("rolling_quantiles", "SELECT id, d, " + ", ".join(_q(p, n) for n in WIDTHS for p in TENTHS) + " FROM grid", "grid")
def rolling_quantiles(t):
    """Nine columns from three widths: four, eight and a half and sixteen weeks."""
    out = W.rolling_quantiles(t.grid.select("id", "d", "sales"), ID, WIDTHS, TENTHS).drop("sales")
    return rounded(out, out.columns[2:])


@query(
    "rolling_shape",
    f"""SELECT id, d,
 {rnd(f"CASE WHEN count(sales) OVER {_frame(0, 15)} = 15 AND max(sales) OVER {_frame(0, 15)} > min(sales) OVER {_frame(0, 15)} THEN skewness(sales) OVER {_frame(0, 15)} END", "skew_15")},
 {rnd(f"CASE WHEN count(sales) OVER {_frame(0, 15)} = 15 AND max(sales) OVER {_frame(0, 15)} > min(sales) OVER {_frame(0, 15)} THEN kurtosis(sales) OVER {_frame(0, 15)} END", "kurt_15")}
 FROM grid""",
    "grid",
)
def rolling_shape(t):
    out = W.rolling_shape(t.grid.select("id", "d", "sales"), ID, 15).drop("sales")
    return rounded(out, out.columns[2:])


@query(
    "rolling_cv",
    f"SELECT id, d, {rnd(f'CASE WHEN count(sales) OVER {_frame(0, 28)} = 28 THEN stddev_samp(sales) OVER {_frame(0, 28)} / nullif(avg(sales) OVER {_frame(0, 28)}, 0) END', 'cv_28')} FROM grid",
    "grid",
)
def rolling_cv(t):
    return rounded(W.std_over_mean(t.grid.select("id", "d", "sales"), ID, 28, whole=True).drop("sales"), ["cv_28"])


NZ = [7, 28, 112]


@query(
    "nonzero_share",
    "SELECT id, d, " + ", ".join(
        rnd(f"CASE WHEN count(*) OVER {_frame(0, n)} = {n} THEN avg(CASE WHEN sales <> 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {_frame(0, n)} END", f"pct_nonzero_{n}")
        for n in NZ) + " FROM grid",
    "grid",
)
def nonzero_share(t):
    """Every day, sold or not."""
    out = W.pct_nonzero(t.grid.select("id", "d", "sales"), ID, NZ).drop("sales")
    return rounded(out, [f"pct_nonzero_{n}" for n in NZ])


@query(
    "age_counts",
    """WITH a AS (SELECT id, d, count(sales) OVER w AS days_since_first, CAST(sum(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nonzero_days
  FROM grid WINDOW w AS (PARTITION BY id ORDER BY d))
 SELECT *, least(nonzero_days, 30) AS nonzero_days_30, least(nonzero_days, 100) AS nonzero_days_100 FROM a""",
    "grid",
)
def age_counts(t):
    return W.age_counts(t.grid.select("id", "d", "sales"), ID, [30, 100]).drop("sales")


@query(
    "trailing_volatility",
    f"WITH j AS (SELECT id, d, abs(sales - lag(sales) OVER w) AS j FROM grid {WN}) SELECT id, d, {rnd('avg(j) OVER w', 'trailing_vol', nudge=1e-9)} FROM j {WN}",
    "grid",
)
def trailing_volatility(t):
    return rounded(W.trailing_vol(t.grid.select("id", "d", "sales"), ID).drop("sales"), ["trailing_vol"], nudge=1e-9)


PK = ["store_id", "item_id"]
PWN = "WINDOW w AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk)"


def _pf(n):
    return f"(PARTITION BY store_id, item_id ORDER BY wm_yr_wk ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "price_relative_position",
    f"SELECT store_id, item_id, wm_yr_wk, {rnd('(sell_price - min(sell_price) OVER w) / (1 + max(sell_price) OVER w - min(sell_price) OVER w)', 'price_cumrel')} FROM prices {PWN}",
    "prices",
)
def price_relative_position(t):
    return rounded(W.price_cumrel(t.prices, PK, "wm_yr_wk").drop("sell_price"), ["price_cumrel"])


@query(
    "price_change",
    f"""SELECT store_id, item_id, wm_yr_wk, {rnd('sell_price / lag(sell_price) OVER w - 1', 'price_rel_diff')},
 {rnd(f'CASE WHEN count(sell_price) OVER {_pf(7)} = 7 THEN stddev_samp(sell_price) OVER {_pf(7)} END', 'price_sd_7', 4)} FROM prices {PWN}""",
    "prices",
)
def price_change(t):
    out = rounded(W.price_change(t.prices, PK, "wm_yr_wk").drop("sell_price"), ["price_rel_diff"])
    return rounded(out, ["price_sd_7"], 4)


@query(
    "price_vs_rolling_mean",
    "SELECT store_id, item_id, wm_yr_wk, " + ", ".join(
        f"round_even((sell_price - CASE WHEN count(*) OVER {_pf(n)} = {n} THEN avg(sell_price) OVER {_pf(n)} END) / sell_price, 3) + 0.0::DOUBLE AS rm_diff_price_{n}"
        for n in (1, 2, 4, 8)) + " FROM prices",
    "prices",
)
def price_vs_rolling_mean(t):
    out = W.rm_diff_price(t.prices, PK, "wm_yr_wk", [1, 2, 4, 8]).drop("sell_price")
    return out.withColumns({f"rm_diff_price_{n}": F.col(f"rm_diff_price_{n}") + F.lit(0.0) for n in (1, 2, 4, 8)})


SPANS = {"ewm_3": 3, "ewm_7": 7, "ewm_30": 30, "ewm_100": 100}


def _ewm(name, span, x="sales", digits=6, nudge=0.0):
    r = 1 - 2.0 / (span + 1)
    return rnd(
        f"CASE WHEN count({x}) OVER w >= {W.min_periods(span)} THEN sum({x} * pow({r!r}, -i)) OVER w / sum(CASE WHEN {x} IS NOT NULL THEN pow({r!r}, -i) END) OVER w END", name, digits, nudge)


def _ewm_days(spans):
    """Every day of a series with its number and, for spans whose weights outgrow a double over a series, the sums of the day's
    block of 256 days and of the block before; older blocks weigh less than 1e-30."""
    short = {n: 1 - 2.0 / (k + 1) for n, k in spans.items() if k <= 7}
    sums = lambda r: f"sum(sales * pow({r!r}, -j)) {{0}} AS {{1}}n, sum(pow({r!r}, -j)) {{0}} AS {{1}}m"
    inside = ", ".join(sums(r).format("OVER b", n) for n, r in short.items())
    whole = ", ".join(sums(r).format("", f"p{n}") for n, r in short.items())
    return f"""x AS (SELECT id, d, sales, i, i // 256 AS k, i % 256 AS j FROM (SELECT id, d, sales, row_number() OVER w - 1 AS i FROM grid {WN})),
 i AS (SELECT x.*, {inside} FROM x WINDOW b AS (PARTITION BY id, k ORDER BY d)), z AS (SELECT id, k + 1 AS k, {whole} FROM x GROUP BY id, k),
 y AS (SELECT i.*, z.* EXCLUDE (id, k) FROM i LEFT JOIN z ON z.id = i.id AND z.k = i.k)"""


def _ewm_of(name, span, digits=6, nudge=0.0):
    if span > 7:
        return _ewm(name, span, digits=digits, nudge=nudge)
    far = f"pow({1 - 2.0 / (span + 1)!r}, 256)"
    ratio = f"({name}n + {far} * coalesce(p{name}n, 0)) / ({name}m + {far} * coalesce(p{name}m, 0))"
    return rnd(f"CASE WHEN count(sales) OVER w >= {W.min_periods(span)} THEN {ratio} END", name, digits, nudge)


@query(
    "ewm_means",
    f"WITH {_ewm_days(SPANS)} SELECT id, d, " + ", ".join(_ewm_of(n, s, nudge=1e-9) for n, s in SPANS.items()) + f" FROM y {WN}",
    "grid",
)
def ewm_means(t):
    out = W.ewm_mean(t.grid.select("id", "d", "sales"), ID, SPANS).drop("sales")
    return rounded(out, list(SPANS), nudge=1e-9)


@query(
    "ewm_recursive",
    f"""WITH i AS (SELECT id, d, sales, row_number() OVER w - 1 AS i FROM grid {WN})
 SELECT id, d, {rnd('pow(1 - 2.0::DOUBLE / 21, i) * sum(sales * CASE WHEN i = 0 THEN 1 ELSE 2.0::DOUBLE / 21 END * pow(1 - 2.0::DOUBLE / 21, -i)) OVER w', 'ewm_20')} FROM i {WN}""",
    "grid",
)
def ewm_recursive(t):
    out = W.ewm_recursive(t.grid.select("id", "d", "sales"), ["id"], {"ewm_20": 20}).drop("sales")
    return rounded(out, ["ewm_20"])


@query(
    "snap_nth_day",
    """WITH s AS (UNPIVOT (SELECT d, "snap_AFRICA" AS AFRICA, "snap_AMERICA" AS AMERICA, "snap_ASIA" AS ASIA FROM calendar) ON AFRICA, AMERICA, ASIA INTO NAME state VALUE snap)
 SELECT state, d, snap, CAST(coalesce(lag(snap, 1) OVER w, 0) AS INT) AS snap_lag_1, CAST(coalesce(lag(snap, 2) OVER w, 0) AS INT) AS snap_lag_2,
 CAST(sum(snap) OVER (PARTITION BY state ORDER BY d ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) * snap AS BIGINT) AS nth_snap_day
 FROM s WINDOW w AS (PARTITION BY state ORDER BY d)""",
    "calendar",
)
def snap_nth_day(t):
    from tidegrid.functions.calendar import snap_features

    return snap_features(t.calendar, {f"snap_{s}": s for s in ("AFRICA", "AMERICA", "ASIA")}, 15)


CROSS = {"a": 7, "b": 30}


@query(
    "ma_crosses",
    f"""WITH {_ewm_days(CROSS)}, e AS (SELECT id, d, {', '.join(_ewm_of(n, k, 12) for n, k in CROSS.items())} FROM y {WN})
 SELECT id, d, {rnd('a - b', 'a_minus_b', 5)}, {rnd('CASE WHEN b <> 0 THEN a / b END', 'a_over_b', 5)} FROM e""",
    "grid",
)
def ma_crosses(t):
    e = rounded(W.ewm_mean(t.grid.select("id", "d", "sales"), ID, CROSS).drop("sales"), list(CROSS), 12)
    return rounded(W.ma_crosses(e, list(CROSS)).drop(*CROSS), ["a_minus_b", "a_over_b"], 5)


@query(
    "rolling_group_ratio",
    f"""WITH s AS (SELECT store_id AS id, d, CAST(round(avg(sales) * 1000000) AS BIGINT) AS x FROM panel GROUP BY ALL)
 SELECT id, d, CASE WHEN count(*) OVER {_frame(0, 56)} = 56 THEN round(least(greatest((56 * sum(x) OVER {_frame(0, 28)})::DOUBLE / (28 * sum(x) OVER {_frame(0, 56)})::DOUBLE - 1, -0.5), 0.5), 6) + 0.0::DOUBLE END AS ratio_28_56 FROM s""",
    "panel",
)
def rolling_group_ratio(t):
    """Daily store means in whole millionths, so that every engine divides the same two numbers."""
    from tidegrid.operators.clean import clip

    millionths = F.round(F.avg("sales") * 1000000).cast("bigint")
    store = t.panel.groupBy(F.col("store_id").alias("id"), "d").agg(millionths.alias("sales"))
    out = W.rolling_ratio(store, ID, 28, 56).drop("sales")
    return rounded(out.withColumn("ratio_28_56", clip(F.col("ratio_28_56"), -0.5, 0.5)), ["ratio_28_56"])


@query(
    "naive_scale",
    """WITH s AS (SELECT id, d, sales - lag(sales) OVER w AS j, max(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started
  FROM grid WINDOW w AS (PARTITION BY id ORDER BY d))
 SELECT id, round(avg(CASE WHEN started = 1 THEN j * j END), 6) AS scale FROM s GROUP BY id""",
    "grid",
)
def naive_scale_query(t):
    return rounded(naive_scale(t.grid, ID), ["scale"])


@query(
    "seasonal_error",
    """WITH s AS (SELECT id, abs(sales - lag(sales, 7) OVER w) AS m, abs(sales - lag(sales, 1) OVER w) AS o FROM grid WINDOW w AS (PARTITION BY id ORDER BY d))
 SELECT id, round(CASE WHEN count(*) > 7 THEN avg(m) ELSE avg(o) END, 6) AS seasonal_error FROM s GROUP BY id""",
    "grid",
)
def seasonal_error_query(t):
    return rounded(seasonal_error(t.grid, ID, 7), ["seasonal_error"])


@query("lag_pca")
def lag_pca(t):
    return W.lag_pca(t.panel, "store_id", 14, 3)


@query(
    "between_store_dispersion",
    f"""WITH s AS (SELECT item_id AS id, d, stddev_samp(sales) AS sd, count(*) AS stores FROM panel GROUP BY ALL),
 i AS (SELECT *, row_number() OVER w - 1 AS i FROM s {WN})
 SELECT id AS item_id, d, stores, {rnd('sd', 'store_std')}, {_ewm('store_std_ewm', 28, 'sd')} FROM i {WN}""",
    "panel",
)
def between_store_dispersion(t):
    sd = encode.between_store_std(t.panel, ["item_id"])
    out = W.ewm_mean(sd, ["item_id"], {"store_std_ewm": 28}, value="store_std")
    return rounded(out, ["store_std", "store_std_ewm"])


@query(
    "trailing_weights",
    """WITH l AS (SELECT dept_id, id, d, sum(cents) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS t FROM grid)
 SELECT dept_id, id, d, CAST(t AS BIGINT) AS trailing, round(t / sum(t) OVER (PARTITION BY dept_id, d), 8) AS weight FROM l""",
    "grid",
)
def trailing_weights(t):
    out = encode.trailing_weights(t.grid.select("dept_id", "id", "d", "cents"), ID, ["dept_id"], 28, value="cents").drop("cents")
    return rounded(out, ["weight"], 8)


@query(
    "leading_zero_mask",
    """WITH b AS (SELECT DISTINCT id FROM panel), f AS (SELECT b.id, y.d, coalesce(p.sales, 0) AS sales FROM b CROSS JOIN days y LEFT JOIN panel p ON p.id = b.id AND p.d = y.d),
 m AS (SELECT id, d, CASE WHEN max(CASE WHEN sales > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY d) = 1 THEN sales END AS sales FROM f)
 SELECT id, count(*) AS days, count(sales) AS observed, sum(sales) AS total, min(CASE WHEN sales IS NOT NULL THEN d END) AS first_observed FROM m GROUP BY id""",
    "panel days",
)
def leading_zero_mask(t):
    masked = mask_leading_zeros(densify(t.panel, ["id"], "d", "sales"), ["id"])
    return masked.groupBy("id").agg(
        F.count("*").alias("days"), F.count("sales").alias("observed"), F.sum("sales").alias("total"),
        F.min(F.when(F.col("sales").isNotNull(), F.col("d"))).alias("first_observed"),
    )


@query(
    "last_rows",
    "SELECT id, d, sales, back FROM (SELECT id, d, sales, CAST(row_number() OVER (PARTITION BY id ORDER BY d DESC) AS INT) AS back FROM grid) WHERE back <= 30",
    "grid",
)
def last_rows(t):
    return _tail(t.grid.select("id", "d", "sales"), ID, "d", 30)
