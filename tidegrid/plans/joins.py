"""Queries over joins, group statistics and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import encode as E
from tidegrid.operators import joins as J
from tidegrid.plans.helpers import rnd, rounded
from tidegrid.plans.registry import query
from tidegrid.sources.retail import EVENTS, SERIES

WK = "(p.d - 1) // 7"


@query(
    "left_join_keep",
    f"SELECT p.id, p.item_id, p.store_id, p.d, p.sales, c.wm_yr_wk, c.wday FROM panel p LEFT JOIN calendar c ON c.d = p.d",
    "panel calendar",
)
def left_join_keep(t):
    """The calendar's own 'sales' column must not replace the left one."""
    cal = t.calendar.select("d", "wm_yr_wk", "wday", F.lit(0.0).alias("sales"))
    return J.left_join_keep(t.panel.select("id", "item_id", "store_id", "d", "sales"), cal, ["d"])


@query(
    "price_by_day",
    f"""SELECT p.id, p.d, p.sales, x.sell_price FROM panel p LEFT JOIN prices x
 ON x.store_id = p.store_id AND x.item_id = p.item_id AND x.wm_yr_wk = {WK}""",
    "panel prices",
)
def price_by_day(t):
    return J.price_to_day(t.panel, t.prices, t.calendar).select("id", "d", "sales", "sell_price")


@query(
    "inner_join_prices",
    f"""SELECT g.id, count(*) AS days, round(sum(g.sales * x.sell_price), 2) AS revenue FROM grid g JOIN prices x
 ON x.store_id = g.store_id AND x.item_id = g.item_id AND x.wm_yr_wk = (g.d - 1) // 7 GROUP BY g.id""",
    "grid prices",
)
def inner_join_prices(t):
    out = J.price_to_day(t.grid, t.prices, t.calendar, "inner")
    out = out.groupBy("id").agg(F.count("*").alias("days"), F.sum(F.col("sales") * F.col("sell_price")).alias("revenue"))
    return rounded(out, ["revenue"], 2)


@query(
    "checked_many_to_one_join",
    "SELECT p.id, p.d, p.sales, c.month, c.year FROM panel p LEFT JOIN calendar c ON c.d = p.d",
    "panel calendar",
)
def checked_many_to_one_join(t):
    return J.join_m1(t.panel.select("id", "d", "sales"), t.calendar.select("d", "month", "year"), ["d"])


@query(
    "semi_join",
    "SELECT id, d, sales FROM panel p WHERE EXISTS (SELECT 1 FROM calendar c WHERE c.d = p.d AND c.event_name_1 IS NOT NULL)",
    "panel calendar",
)
def semi_join(t):
    days = t.calendar.filter("event_name_1 is not null")
    return J.left_semi(t.panel.select("id", "d", "sales"), days, ["d"])


@query(
    "assemble_features",
    """SELECT id, d, sales, lag(sales, 1) OVER w AS lag_1, round(avg(sales) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING), 6) + 0.0::DOUBLE AS mean_so_far,
 count(*) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING) AS seen FROM panel WINDOW w AS (PARTITION BY id ORDER BY d)""",
    "panel",
)
def assemble_features(t):
    from pyspark.sql import Window

    from tidegrid.operators.windows import add_lags

    base = t.panel.select("id", "d", "sales")
    run = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    blocks = [
        base,
        add_lags(base, ["id"], [1]).drop("sales"),
        base.select("id", "d", F.avg("sales").over(run).alias("mean_so_far")),
        base.select("id", "d", F.count("*").over(run).alias("seen")),
    ]
    return rounded(J.assemble_features(blocks, ["id", "d"]), ["mean_so_far"])


@query(
    "base_and_target_day_calendar",
    """SELECT x.days_fwd, b.wday AS wday_d, a.wday AS wday_p, a.month AS month_p, count(*) AS n, sum(x.sales) AS sales
 FROM (SELECT d, sales, unnest(range(1, 29)) AS days_fwd FROM panel) x JOIN calendar b ON b.d = x.d LEFT JOIN calendar a ON a.d = x.d + x.days_fwd GROUP BY ALL""",
    "panel calendar",
)
def base_and_target_day_calendar(t):
    out = J.join_horizon(t.panel.select("d", "sales"), t.calendar, ["wday", "month"], 28)
    return out.groupBy("days_fwd", "wday_d", "wday_p", "month_p").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))


def _target_sql(join, y):
    return f"""SELECT x.id, x.days_fwd, count(*) AS n, round(avg({y}), 6) AS y FROM (SELECT id, d, unnest(range(1, 29)) AS days_fwd FROM panel) x
 {join} JOIN panel a ON a.id = x.id AND a.d = x.d + x.days_fwd GROUP BY ALL"""


@query("target_in_sample", _target_sql("", "a.sales"), "panel")
def target_in_sample(t):
    out = J.horizon_targets(t.panel.select("id", "d", "sales"), ["id"], 28, oos=False)
    return rounded(out.groupBy("id", "days_fwd").agg(F.count("*").alias("n"), F.avg("y").alias("y")), ["y"])


@query("target_out_of_sample", _target_sql("LEFT", "coalesce(a.sales, -1)"), "panel")
def target_out_of_sample(t):
    out = J.horizon_targets(t.panel.select("id", "d", "sales"), ["id"], 28, oos=True)
    return rounded(out.groupBy("id", "days_fwd").agg(F.count("*").alias("n"), F.avg("y").alias("y")), ["y"])


E1 = [e for _, _, e, _ in EVENTS]


def _countdown(name, col, event, off):
    return f"""coalesce((SELECT CAST(30 - (max(e.d) - {off} - c.d) AS INT) FROM calendar e WHERE e.{col} = '{event}' AND e.d - {off} - c.d BETWEEN 0 AND 29), 0) AS "{name}\""""


def _countdown_sql(off):
    names = [(f"event_name_1_{e}", "event_name_1", e) for e in E1] + [("event_name_2_Summer", "event_name_2", "Summer")]
    cols = ", ".join(_countdown(n, c, e, off) for n, c, e in names)
    return f"WITH x AS (SELECT d, {cols} FROM calendar c) SELECT *, " + " + ".join(f'"{n}"' for n, _, _ in names) + " AS event_sum FROM x"


@query("event_countdown", _countdown_sql(1), "calendar")
def event_countdown(t):
    return J.event_countdown(t.calendar, {"event_name_1": E1, "event_name_2": ["Summer"]})


@query("event_countdown_exact", _countdown_sql(0), "calendar")
def event_countdown_exact(t):
    return J.event_countdown(t.calendar, {"event_name_1": E1, "event_name_2": ["Summer"]}, exact=True)


@query(
    "days_since_last_sale",
    """WITH l AS (SELECT id, d, lag(CASE WHEN sales > 0 THEN 1 ELSE 0 END, 7) OVER (PARTITION BY id ORDER BY d) AS s FROM grid),
 c AS (SELECT id, d, coalesce(sum(s) OVER (PARTITION BY id ORDER BY d), -1) AS k FROM l)
 SELECT id, d, CAST(d - min(d) OVER (PARTITION BY id, k) AS INT) AS last_sale FROM c""",
    "grid",
)
def days_since_last_sale(t):
    return J.days_since_last_sale(t.grid.select("id", "d", "sales"), ["id"], 7).drop("sales")


@query(
    "expand_horizon",
    "SELECT id, days_fwd, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM (SELECT id, cents, unnest(range(1, 29)) AS days_fwd FROM panel) GROUP BY ALL",
    "panel",
)
def expand_horizon(t):
    return J.expand_horizon(t.panel, 28).groupBy("id", "days_fwd").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))


# --- group statistics ------------------------------------------------------------------

@query(
    "price_stats",
    f"""SELECT store_id, item_id, wm_yr_wk, max(sell_price) OVER w AS price_max, min(sell_price) OVER w AS price_min,
 {rnd('stddev_samp(sell_price) OVER w', 'price_std', 4)}, {rnd('avg(sell_price) OVER w', 'price_mean', 4)}, {rnd('sell_price / max(sell_price) OVER w', 'price_norm', 6)}
 FROM prices WINDOW w AS (PARTITION BY store_id, item_id)""",
    "prices",
)
def price_stats(t):
    out = E.price_stats(t.prices, ["store_id", "item_id"]).drop("sell_price")
    return rounded(rounded(out, ["price_std", "price_mean"], 4), ["price_norm"])


@query(
    "price_distinct_counts",
    """WITH p AS (SELECT store_id, item_id, wm_yr_wk, floor(sell_price / 100) AS sell_price FROM prices)
 SELECT p.*, a.n AS price_nunique, b.n AS item_nunique FROM p
 JOIN (SELECT store_id, item_id, count(DISTINCT sell_price) AS n FROM p GROUP BY ALL) a ON a.store_id = p.store_id AND a.item_id = p.item_id
 JOIN (SELECT store_id, sell_price, count(DISTINCT item_id) AS n FROM p GROUP BY ALL) b ON b.store_id = p.store_id AND b.sell_price = p.sell_price""",
    "prices",
)
def price_distinct_counts(t):
    return E.price_counts(t.prices.withColumn("sell_price", F.floor(F.col("sell_price") / 100).cast("double")))


@query(
    "price_momentum",
    f"""WITH c AS (SELECT wm_yr_wk, arg_min(month, d) AS month, arg_min(year, d) AS year FROM calendar GROUP BY wm_yr_wk),
 p AS (SELECT x.*, c.month, c.year FROM prices x LEFT JOIN c ON c.wm_yr_wk = x.wm_yr_wk)
 SELECT store_id, item_id, wm_yr_wk, {rnd('sell_price / lag(sell_price) OVER (PARTITION BY store_id, item_id ORDER BY wm_yr_wk)', 'price_momentum')},
 {rnd('sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, month)', 'price_momentum_m')},
 {rnd('sell_price / avg(sell_price) OVER (PARTITION BY store_id, item_id, year)', 'price_momentum_y')} FROM p""",
    "prices calendar",
)
def price_momentum(t):
    weeks = E.distinct_on(t.calendar.select("wm_yr_wk", "d", "month", "year"), ["wm_yr_wk"], ["d"]).drop("d")
    out = E.price_momentum(t.prices, weeks).drop("sell_price")
    return rounded(out, ["price_momentum", "price_momentum_m", "price_momentum_y"])


@query(
    "first_row_per_key",
    "SELECT DISTINCT ON (store_id, item_id) store_id, item_id, d, id, sales FROM panel ORDER BY store_id, item_id, d",
    "panel",
)
def first_row_per_key(t):
    return E.distinct_on(t.panel.select("store_id", "item_id", "d", "id", "sales"), ["store_id", "item_id"], ["d"])


GROUPS = [["state_id"], ["store_id"], ["cat_id"], ["dept_id"], ["state_id", "cat_id"], ["state_id", "dept_id"],
          ["store_id", "cat_id"], ["store_id", "dept_id"], ["item_id"], ["item_id", "state_id"], ["item_id", "store_id"]]


def _enc(g):
    by = ", ".join(g)
    x = "CASE WHEN d <= e - 28 THEN sales END"
    n = "_".join(g)
    return f"{rnd(f'avg({x}) OVER (PARTITION BY {by})', f'enc_{n}_mean')}, {rnd(f'stddev_samp({x}) OVER (PARTITION BY {by})', f'enc_{n}_std')}"


@query("target_encodings", f"SELECT id, d, {', '.join(_enc(g) for g in GROUPS)} FROM panel, lastday", "panel lastday")
def target_encodings(t):
    out = E.target_encode(t.panel, GROUPS, SERIES, F.col("d") <= t.last_day - 28, on=["id"])
    names = [c for c in out.columns if c.startswith("enc_")]
    return rounded(out.select("id", "d", *names), names)


@query(
    "encode_by_store",
    f"""WITH s AS (SELECT dept_id, store_id, avg(sales) AS m, stddev_samp(sales) AS v FROM panel WHERE d <= 2000 GROUP BY ALL)
 SELECT p.id, p.d, {rnd('s.m', 'enc_dept_id_store_id_mean')}, {rnd('s.v', 'enc_dept_id_store_id_std')} FROM panel p LEFT JOIN s ON s.dept_id = p.dept_id AND s.store_id = p.store_id""",
    "panel",
)
def encode_by_store(t):
    names = ["enc_dept_id_store_id_mean", "enc_dept_id_store_id_std"]
    return rounded(E.encode_by(t.panel, "dept_id", "store_id", F.col("d") <= 2000).select("id", "d", *names), names)


@query("divide_by_store_day", f"SELECT id, d, {rnd('sales / avg(sales) OVER (PARTITION BY store_id, d)', 'scaled')} FROM panel", "panel")
def divide_by_store_day(t):
    return rounded(E.divide_by_group(t.panel, ["store_id", "d"]).select("id", "d", "scaled"), ["scaled"])


@query(
    "divide_by_daily_total",
    f"""WITH t AS (SELECT d, sum(sales) AS s FROM panel GROUP BY d)
 SELECT p.id, p.d, {rnd('p.sales / (t.s / (SELECT avg(s) FROM t))', 'scaled')} FROM panel p JOIN t ON t.d = p.d""",
    "panel",
)
def divide_by_daily_total(t):
    return rounded(E.divide_by_total(t.panel).select("id", "d", "scaled"), ["scaled"])


@query(
    "dataset_statistics",
    """WITH s AS (SELECT id, count(*) AS n, sum(sales) AS s, min(sales) AS lo, max(sales) AS hi FROM panel GROUP BY id)
 SELECT count(*) AS num_series, CAST(sum(n) AS BIGINT) AS num_observations, CAST(0 AS BIGINT) AS num_missing, min(lo) AS min_target, max(hi) AS max_target,
 round(sum(s) / sum(n), 6) AS mean_target, round(sum(s) / sum(n), 6) AS mean_abs_target, TRUE AS integer_target, min(n) AS min_length, max(n) AS max_length, round(avg(n), 6) AS mean_length FROM s""",
    "panel",
)
def dataset_statistics(t):
    return rounded(E.dataset_stats(t.panel, ["id"]), ["mean_target", "mean_abs_target", "mean_length"])


@query(
    "scale_histogram",
    """WITH s AS (SELECT id, avg(abs(sales)) AS m FROM grid GROUP BY id) SELECT CAST(floor(ln(m + 1) / ln(2) + 1e-12) AS INT) AS bucket, count(*) AS series FROM s GROUP BY bucket""",
    "grid",
)
def scale_histogram(t):
    return E.scale_histogram(t.grid, ["id"])


@query(
    "bias_factors",
    """WITH a AS (SELECT id, dept_id, store_id, d, sales, lag(sales, 7) OVER (PARTITION BY id ORDER BY d) AS forecast FROM dgrid),
 x AS (SELECT dept_id, store_id, avg(m) AS a FROM (SELECT dept_id, store_id, d, avg(sales) AS m FROM a GROUP BY ALL) GROUP BY ALL),
 y AS (SELECT dept_id, store_id, avg(m) AS f FROM (SELECT dept_id, store_id, d, avg(forecast) AS m FROM a WHERE forecast IS NOT NULL GROUP BY ALL) GROUP BY ALL)
 SELECT x.dept_id, x.store_id, round(x.a / y.f, 6) AS factor FROM x JOIN y ON x.dept_id = y.dept_id AND x.store_id = y.store_id""",
    "dgrid",
)
def bias_factors(t):
    from tidegrid.operators.windows import add_lags

    base = add_lags(t.dept_grid.select("id", "dept_id", "store_id", "d", "sales"), ["id"], [7]).withColumnRenamed("lag_7", "forecast")
    out = E.bias_factors(base, base.filter("forecast is not null"), ["dept_id", "store_id"])
    return rounded(out, ["factor"])


@query(
    "importance_summary",
    """WITH c AS (SELECT store_id, 'price' AS feature, abs(corr(sales, cents / sales)) AS i FROM panel GROUP BY store_id
  UNION ALL SELECT store_id, 'day', abs(corr(sales, d)) FROM panel GROUP BY store_id UNION ALL SELECT store_id, 'weekday', abs(corr(sales, d % 7)) FROM panel GROUP BY store_id)
 SELECT feature, round(avg(i), 6) AS mean, round(stddev_samp(i), 6) AS std, count(*) AS groups FROM c GROUP BY feature""",
    "panel",
)
def importance_summary(t):
    feats = {"price": F.col("cents") / F.col("sales"), "day": F.col("d"), "weekday": F.col("d") % 7}
    wide = t.panel.groupBy("store_id").agg(*[F.abs(F.corr("sales", c)).alias(n) for n, c in feats.items()])
    long = wide.unpivot(["store_id"], list(feats), "feature", "importance")
    return rounded(E.agg_importance(long), ["mean", "std"])


@query(
    "mean_predictions",
    "SELECT item_id, d % 28 AS step, round(avg(sales), 6) AS sales, round(avg(cents), 4) AS cents, count(*) AS ct FROM panel GROUP BY ALL",
    "panel",
)
def mean_predictions(t):
    out = E.mean_predictions(t.panel.withColumn("step", F.col("d") % 28), ["item_id", "step"], ["sales", "cents"])
    return rounded(rounded(out, ["sales"]), ["cents"], 4)


COLS = ["id", "dept_id", "cat_id", "store_id", "state_id"]


@query("cardinalities", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM panel" for c in COLS), "panel")
def cardinalities(t):
    return E.n_unique(t.panel, COLS)


@query(
    "mean_by_event",
    """WITH t AS (SELECT c.*, s.total FROM (SELECT d, sum(sales) AS total FROM panel GROUP BY d) s JOIN calendar c ON c.d = s.d),
 l AS (SELECT 'event_name_1' AS kind, event_name_1 AS name, total FROM t UNION ALL SELECT 'event_type_1', event_type_1, total FROM t UNION ALL SELECT 'wday', CAST(wday AS VARCHAR), total FROM t)
 SELECT kind, name, round(avg(total), 6) AS mean_total, count(*) AS days FROM l GROUP BY kind, name""",
    "panel calendar",
)
def mean_by_event(t):
    return rounded(E.mean_by_event(t.panel, t.calendar, ["event_name_1", "event_type_1", "wday"]), ["mean_total"])


@query(
    "ordinal_codes",
    """SELECT id, d, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS INT) AS item_code, CAST(CASE WHEN ev IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY ev NULLS LAST) END AS INT) AS event_code
 FROM (SELECT p.id, p.d, p.item_id, c.event_name_1 AS ev FROM panel p JOIN calendar c ON c.d = p.d)""",
    "panel calendar",
)
def ordinal_codes(t):
    df = t.panel.select("id", "d", "item_id").join(t.calendar.select("d", "event_name_1"), "d")
    out = E.encode_ordinal(E.encode_ordinal(df, "item_id", "item_code"), "event_name_1", "event_code")
    return out.select("id", "d", "item_code", "event_code")


@query(
    "one_hot_events",
    "SELECT d, " + ", ".join(f"CAST(coalesce(event_name_1 = '{e}', FALSE) AS INT) AS \"event_name_1_{e}\"" for e in E1)
    + ", " + ", ".join(f"CAST(wday = {w} AS INT) AS wday_{w}" for w in range(1, 8)) + " FROM calendar",
    "calendar",
)
def one_hot_events(t):
    cal = t.calendar.select("d", "event_name_1", "wday")
    return E.one_hot(E.one_hot(cal, "event_name_1", E1), "wday", list(range(1, 8))).drop("event_name_1", "wday")


@query("sorted_prices", "SELECT item_id, store_id, wm_yr_wk, sell_price FROM prices ORDER BY item_id, store_id, wm_yr_wk", "prices")
def sorted_prices(t):
    return E.sort_panel(t.prices, ["item_id", "store_id", "wm_yr_wk"])


@query("top_series", "SELECT id, sum(sales) AS total FROM panel GROUP BY id ORDER BY total DESC, id LIMIT 20", "panel")
def top_series(t):
    return E.top_k(t.panel.groupBy("id").agg(F.sum("sales").alias("total")), "total", 20, "id")


@query(
    "every_kth_series",
    "SELECT id, total FROM (SELECT id, CAST(sum(cents) AS BIGINT) AS total, row_number() OVER (ORDER BY sum(cents) DESC, id) AS r FROM panel GROUP BY id) WHERE (r - 1) % 10 = 0",
    "panel",
)
def every_kth_series(t):
    return E.every_kth(t.panel.groupBy("id").agg(F.sum("cents").alias("total")), "total", "id", 10)
