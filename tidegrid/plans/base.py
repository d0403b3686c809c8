"""Shared SQL views for the plain-SQL equivalents (same data as sources.retail)."""

from __future__ import annotations

VIEWS = {
    "panel": (
        [],
        """SELECT p.p_brand || '_' || n.n_name AS id, p.p_brand AS item_id,
 'D' || (CAST(substr(p.p_brand, 7) AS INT) % 3) || '_' || (CAST(substr(p.p_brand, 7) AS INT) % 2) AS dept_id,
 'C' || (CAST(substr(p.p_brand, 7) AS INT) % 3) AS cat_id,
 n.n_name AS store_id, r.r_name AS state_id,
 CAST(date_diff('day', DATE '1995-01-02', CAST(l.l_shipdate AS DATE)) + 1 AS INT) AS d,
 SUM(l.l_quantity) AS sales, CAST(SUM(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
 JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""",
    ),
    "lastday": (
        [],
        "SELECT CAST(max(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE))) + 1 AS INT) AS e FROM lineitem",
    ),
    "days": (["lastday"], "SELECT CAST(unnest(range(1, e + 1)) AS INT) AS d FROM lastday"),
    "grid": (
        ["panel", "days"],
        """SELECT s.id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id, y.d,
 coalesce(p.sales, 0) AS sales, coalesce(p.cents, 0) AS cents
 FROM (SELECT id, item_id, dept_id, cat_id, store_id, state_id, min(d) AS f FROM panel GROUP BY ALL) s
 JOIN days y ON y.d >= s.f LEFT JOIN panel p ON p.id = s.id AND p.d = y.d""",
    ),
    "dpanel": (
        ["panel"],
        """SELECT dept_id || '_' || store_id AS id, dept_id, cat_id, store_id, state_id, d,
 sum(sales) AS sales, CAST(sum(cents) AS BIGINT) AS cents FROM panel GROUP BY ALL""",
    ),
    "dgrid": (
        ["dpanel", "days"],
        """SELECT s.id, s.dept_id, s.cat_id, s.store_id, s.state_id, y.d,
 coalesce(p.sales, 0) AS sales, coalesce(p.cents, 0) AS cents
 FROM (SELECT id, dept_id, cat_id, store_id, state_id, min(d) AS f FROM dpanel GROUP BY ALL) s
 JOIN days y ON y.d >= s.f LEFT JOIN dpanel p ON p.id = s.id AND p.d = y.d""",
    ),
    "prices": (
        ["panel"],
        """SELECT store_id, item_id, CAST((d - 1) // 7 AS INT) AS wm_yr_wk,
 CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / sum(sales) AS sell_price FROM panel GROUP BY ALL""",
    ),
    "calendar": (
        ["days"],
        """SELECT d, dt AS date, CAST((d - 1) // 7 AS INT) AS wm_yr_wk, CAST(isodow(dt) AS INT) AS wday,
 CAST(month(dt) AS INT) AS month, CAST(year(dt) AS INT) AS year,
 CASE WHEN month(dt) = 1 AND day(dt) = 1 THEN 'NewYear' WHEN month(dt) = 2 AND day(dt) = 14 THEN 'Valentine'
  WHEN month(dt) = 7 AND day(dt) = 4 THEN 'Independence' WHEN month(dt) = 12 AND day(dt) = 25 THEN 'Christmas' END AS event_name_1,
 CASE WHEN month(dt) = 1 AND day(dt) = 1 THEN 'National' WHEN month(dt) = 2 AND day(dt) = 14 THEN 'Cultural'
  WHEN month(dt) = 7 AND day(dt) = 4 THEN 'National' WHEN month(dt) = 12 AND day(dt) = 25 THEN 'Religious' END AS event_type_1,
 CASE WHEN month(dt) = 7 AND day(dt) = 4 THEN 'Summer' END AS event_name_2,
 CASE WHEN month(dt) = 7 AND day(dt) = 4 THEN 'Cultural' END AS event_type_2,
 CAST(day(dt) % 3 = 0 AS INT) AS "snap_AFRICA", CAST((day(dt) + 1) % 3 = 0 AS INT) AS "snap_AMERICA",
 CAST((day(dt) + 2) % 3 = 0 AS INT) AS "snap_ASIA"
 FROM (SELECT d, CAST(DATE '1995-01-02' + (d - 1) AS DATE) AS dt FROM days)""",
    ),
    "fc7": (
        ["grid", "lastday"],
        """SELECT id, item_id, dept_id, cat_id, store_id, state_id, CAST(step AS INT) AS step, forecast FROM (
 SELECT t.*, unnest(CASE WHEN n = 7 THEN range(8 - back, 29, 7) WHEN back = 1 THEN range(1, 29) ELSE [] END) AS step, CASE WHEN n = 7 THEN sales ELSE m END AS forecast FROM (
 SELECT *, count(*) OVER (PARTITION BY id) AS n, avg(sales) OVER (PARTITION BY id) AS m, row_number() OVER (PARTITION BY id ORDER BY d DESC) AS back
 FROM grid, lastday WHERE d > e - 35 AND d <= e - 28) t)""",
    ),
    "hist": (
        ["grid", "lastday"],
        """SELECT id, item_id, dept_id, cat_id, store_id, state_id, avg(sales) AS mean, quantile_cont(sales, 0.1) AS q10, quantile_cont(sales, 0.5) AS q50, quantile_cont(sales, 0.9) AS q90
 FROM grid, lastday WHERE d > e - 56 AND d <= e - 28 GROUP BY ALL""",
    ),
    "fcm": (["hist"], "SELECT id, item_id, dept_id, cat_id, store_id, state_id, CAST(unnest(range(1, 29)) AS INT) AS step, mean AS forecast FROM hist"),
    "ev": (
        ["grid", "lastday", "fc7", "hist"],
        """SELECT g.id, g.item_id, g.dept_id, g.cat_id, g.store_id, g.state_id, f.step, g.sales AS y, f.forecast, h.mean, h.q10, h.q50, h.q90
 FROM grid g CROSS JOIN lastday JOIN fc7 f ON f.id = g.id AND f.step = g.d - (e - 28) JOIN hist h ON h.id = g.id""",
    ),
    "serr": (
        ["grid", "lastday"],
        """SELECT id, CASE WHEN count(*) > 7 THEN avg(m) ELSE avg(o) END AS seasonal_error FROM (
 SELECT id, abs(sales - lag(sales, 7) OVER w) AS m, abs(sales - lag(sales, 1) OVER w) AS o FROM grid, lastday WHERE d <= e - 28 WINDOW w AS (PARTITION BY id ORDER BY d)) GROUP BY id""",
    ),
}


def with_views(body: str, names: list[str]) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
