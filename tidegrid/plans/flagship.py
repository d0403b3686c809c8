"""End-to-end: grid, seasonal-naive forecast, 12-level weighted scaled error."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators.forecast import seasonal_naive
from tidegrid.operators.metrics import recent_revenue, revenue_shares, wrmsse_levels
from tidegrid.plans.registry import query
from tidegrid.sources.retail import SERIES

HORIZON = 28

# Level table as plain SQL, shared by several equivalents.
GSETS = """GROUPING SETS (({x}), (state_id{c}), (store_id{c}), (cat_id{c}), (dept_id{c}), (state_id, cat_id{c}),
 (state_id, dept_id{c}), (store_id, cat_id{c}), (store_id, dept_id{c}), (item_id{c}), (state_id, item_id{c}), (item_id, store_id{c}))"""
LEVEL_CASE = """CASE {g} WHEN 31 THEN 1 WHEN 15 THEN 2 WHEN 23 THEN 3 WHEN 27 THEN 4 WHEN 29 THEN 5 WHEN 11 THEN 6
 WHEN 13 THEN 7 WHEN 19 THEN 8 WHEN 21 THEN 9 WHEN 30 THEN 10 WHEN 14 THEN 11 WHEN 22 THEN 12 END"""
GID = "grouping(state_id, store_id, cat_id, dept_id, item_id)"
LEVEL = LEVEL_CASE.format(g=GID)


def gsets(by: str = "") -> str:
    return GSETS.format(x=by, c=f", {by}" if by else "")


NAIVE_SQL = """tail AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS back FROM grid, lastday WHERE d <= e - 28),
 fc AS (SELECT item_id, store_id, 8 - back + 7 * k AS step, sales AS forecast FROM tail, (SELECT unnest(range(0, 4)) AS k) WHERE back <= 7)"""


def naive_forecast(t, horizon: int = HORIZON, m: int = 7):
    t = t.staged
    cut = t.last_day - horizon
    return seasonal_naive(t.grid_between(cut - m, cut), SERIES, horizon, m)


def wrmsse_sql(fc: str, name: str = "") -> str:
    """Views base, lv, st and per (with a suffix) of a forecast view: item_id, store_id, step, forecast."""
    return f"""base{name} AS (SELECT g.state_id, g.store_id, g.cat_id, g.dept_id, g.item_id, g.d, g.sales, e,
   CASE WHEN g.d > e - 28 THEN coalesce(f.forecast, 0) ELSE 0 END AS fc,
   CASE WHEN g.d > e - 56 AND g.d <= e - 28 THEN g.sales * coalesce(p.sell_price, 0) ELSE 0 END AS revenue
   FROM grid g CROSS JOIN lastday LEFT JOIN {fc} f ON f.item_id = g.item_id AND f.store_id = g.store_id AND f.step = g.d - (e - 28)
   LEFT JOIN prices p ON p.item_id = g.item_id AND p.store_id = g.store_id AND p.wm_yr_wk = (g.d - 1) // 7),
 lv{name} AS (SELECT {LEVEL} AS level, state_id, store_id, cat_id, dept_id, item_id, d, sum(sales) AS sales, sum(fc) AS fc, sum(revenue) AS revenue,
   max(e) AS e FROM base{name} GROUP BY {gsets('d')}),
 st{name} AS (SELECT *, sales - lag(sales) OVER w AS step,
   max(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY level, state_id, store_id, cat_id, dept_id, item_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started
   FROM lv{name} WINDOW w AS (PARTITION BY level, state_id, store_id, cat_id, dept_id, item_id ORDER BY d)),
 per{name} AS (SELECT level, avg(CASE WHEN d <= e - 28 AND started = 1 THEN step * step END) AS scale,
   avg(CASE WHEN d > e - 28 THEN (sales - fc) * (sales - fc) END) AS mse, sum(revenue) AS revenue
   FROM st{name} GROUP BY level, state_id, store_id, cat_id, dept_id, item_id)"""


WRMSSE = "sum(CASE WHEN scale > 0 THEN revenue * sqrt(mse / scale) END) / sum(revenue)"


@query(
    "wrmsse_by_level",
    f"WITH {NAIVE_SQL}, {wrmsse_sql('fc')} SELECT level, count(*) AS series, round({WRMSSE}, 6) AS wrmsse FROM per GROUP BY level",
    "grid prices lastday",
)
def wrmsse_by_level(t):
    t = t.staged
    cut = t.last_day - HORIZON
    revenue = recent_revenue(t.panel, t.prices, t.calendar, cut, HORIZON)
    out = wrmsse_levels(t.panel, naive_forecast(t), revenue, cut)
    return out.withColumn("wrmsse", F.round("wrmsse", 6))


@query(
    "revenue_weights",
    f"""WITH base AS (SELECT g.state_id, g.store_id, g.cat_id, g.dept_id, g.item_id, g.sales * p.sell_price AS revenue
   FROM panel g CROSS JOIN lastday JOIN prices p ON p.item_id = g.item_id AND p.store_id = g.store_id AND p.wm_yr_wk = (g.d - 1) // 7
   WHERE g.d > e - 28),
 lv AS (SELECT {LEVEL} AS level, state_id, store_id, cat_id, dept_id, item_id, sum(revenue) AS revenue FROM base GROUP BY {gsets()})
 SELECT level, state_id, store_id, cat_id, dept_id, item_id, round(revenue, 4) AS revenue,
  round(revenue / sum(revenue) OVER (PARTITION BY level), 8) AS weight FROM lv""",
    "panel prices lastday",
)
def revenue_weights(t):
    out = revenue_shares(recent_revenue(t.panel, t.prices, t.calendar, t.last_day, HORIZON))
    return out.withColumn("revenue", F.round("revenue", 4)).withColumn("weight", F.round("weight", 8))
