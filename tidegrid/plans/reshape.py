"""Queries over reshaping, id handling, cleaning and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import clean, encode, reshape as R
from tidegrid.operators.ensemble import union_all
from tidegrid.operators.hierarchy import KEYS, label_levels, level_scale, rollup_hierarchy, rollup_top
from tidegrid.plans.flagship import LEVEL, gsets
from tidegrid.plans.helpers import rounded
from tidegrid.plans.registry import query
from tidegrid.sources.files import checkpoint_table

CYCLE = 28
FS = ", ".join(f'sum(sales) FILTER ((d - 1) % 28 = {i - 1}) AS "F{i}"' for i in range(1, CYCLE + 1))


def cycle_wide(t):
    """Sales by position in a 28-day cycle, wide: id, F1..F28, over all days."""
    steps = t.panel.groupBy("id", ((F.col("d") - 1) % CYCLE + 1).alias("step")).agg(F.sum("sales").alias("value"))
    return R.pivot_horizon(steps, ["id"], "step", "value", CYCLE)


@query("pivot_to_horizon", f"SELECT id, {FS} FROM panel GROUP BY id", "panel")
def pivot_to_horizon(t):
    return cycle_wide(t)


def day_columns(t):
    """The sales table as it is first read: one row a series, one column a day (2,499 here), stored."""
    (days,) = t.panel.agg(F.max("d")).first()
    return checkpoint_table(R.pivot_days(t.panel, ["id", "store_id"], days), "wide")


@query("unpivot_days", "SELECT s.id, y.d, p.sales FROM (SELECT DISTINCT id FROM panel) s CROSS JOIN days y LEFT JOIN panel p ON p.id = s.id AND p.d = y.d", "panel days")
def unpivot_days(t):
    return R.unpivot_days(day_columns(t), ["id"])


@query(
    "unpivot_quantiles",
    """WITH q AS (SELECT id, quantile_cont(sales, 0.025) AS a, median(sales) AS b, quantile_cont(sales, 0.975) AS c FROM panel GROUP BY id),
 u AS (SELECT id, 0.025 AS q, a AS value FROM q UNION ALL SELECT id, 0.5, b FROM q UNION ALL SELECT id, 0.975, c FROM q)
 SELECT id, CAST(q AS DOUBLE) AS q, id || '_' || printf('%.3f', CAST(q AS DOUBLE)) || '_evaluation' AS name, round(value, 6) AS value FROM u""",
    "panel",
)
def unpivot_quantiles(t):
    probs = {"q0": 0.025, "q1": 0.5, "q2": 0.975}
    wide = t.panel.groupBy("id").agg(*[F.percentile("sales", p).alias(n) for n, p in probs.items()])
    return rounded(R.unpivot_quantiles(wide, ["id"], probs, "evaluation"), ["value"])


@query(
    "extend_horizon",
    """SELECT id, d, sales FROM panel UNION ALL
 SELECT id, CAST(e + k AS INT), NULL FROM (SELECT DISTINCT id FROM panel), lastday, (SELECT unnest(range(1, 29)) AS k)""",
    "panel lastday",
)
def extend_horizon(t):
    return R.extend_horizon(t.panel, ["id"], 28)


@query(
    "densify_mean_fill",
    """WITH s AS (SELECT id, avg(sales) AS m FROM panel GROUP BY id), b AS (SELECT min(d) AS a, max(d) AS z FROM panel)
 SELECT s.id, y.d, round(coalesce(p.sales, s.m), 6) AS sales FROM s CROSS JOIN b JOIN days y ON y.d BETWEEN b.a AND b.z
 LEFT JOIN panel p ON p.id = s.id AND p.d = y.d""",
    "panel days",
)
def densify_mean_fill(t):
    return rounded(R.densify(t.panel, ["id"], "d", "sales", "mean"), ["sales"])


@query(
    "grid_by_series",
    "SELECT id, count(*) AS days, min(d) AS first_day, max(d) AS final_day, sum(sales) AS total, count(*) FILTER (sales = 0) AS zero_days FROM grid GROUP BY id",
    "grid",
)
def grid_by_series(t):
    return t.grid.groupBy("id").agg(
        F.count("*").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("final_day"),
        F.sum("sales").alias("total"), F.sum((F.col("sales") == 0).cast("bigint")).alias("zero_days"),
    )


@query(
    "group_multivariate",
    """WITH s AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT id FROM panel)), b AS (SELECT min(d) AS a FROM panel),
 f AS (SELECT s.id, s.k, y.d, coalesce(p.sales, 0) AS sales FROM s JOIN days y ON y.d >= (SELECT a FROM b) LEFT JOIN panel p ON p.id = s.id AND p.d = y.d)
 SELECT id, CAST(k - (SELECT max(k) + 1 - 100 FROM s) AS BIGINT) AS dim, min(d) AS start, count(*) AS length, round(sum(sales * (d % 97)), 2) AS fingerprint
 FROM f WHERE k >= (SELECT max(k) + 1 - 100 FROM s) GROUP BY id, k""",
    "panel days",
)
def group_multivariate(t):
    """Last 100 dimensions, aligned; the array is reduced to its length and a position-weighted sum."""
    out = R.group_multivariate(t.panel, "id", "d", "sales", 100)
    weights = F.transform("target", lambda x, i: x * ((F.col("start") + i) % 97))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return out.select("id", "dim", "start", F.size("target").cast("bigint").alias("length"), F.round(total, 2).alias("fingerprint"))


@query(
    "group_test_dates",
    """WITH c AS (SELECT CAST(k AS INT) AS block, e - 28 * (2 - k) AS z FROM lastday, (SELECT unnest(range(0, 3)) AS k)),
 s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS dim FROM panel, lastday GROUP BY id HAVING min(d) <= any_value(e) - 56)
 SELECT c.block, s.id, s.dim, c.z - (SELECT min(d) FROM panel JOIN s USING (id)) + 1 AS length, (SELECT min(d) FROM panel JOIN s USING (id)) AS start, sum(p.sales) AS total
 FROM c CROSS JOIN s JOIN panel p ON p.id = s.id AND p.d <= c.z GROUP BY ALL""",
    "panel lastday",
)
def group_test_dates(t):
    """A rolling test set: every series up to three dates, four weeks apart."""
    early = t.grid.groupBy("id").agg(F.min("d").alias("f")).filter(F.col("f") <= t.last_day - 56).select("id")
    cuts = F.explode(F.array(*[t.last_day - 28 * k for k in (2, 1, 0)])).alias("final_day")
    rows = t.grid.select("id", "d", "sales").join(early, "id").select("id", "d", "sales", cuts).filter("d <= final_day")
    out = R.group_test_dates(rows, "id", "d", "sales", "final_day", 3)
    return out.groupBy("block", "id", "dim").agg(F.count("*").alias("length"), F.min("d").alias("start"), F.sum("sales").alias("total"))


@query(
    "entries_to_rows",
    "SELECT id, d, sales FROM grid",
    "grid",
)
def entries_to_rows(t):
    entries = R.collect_series(t.grid, ["id"], "d", {"sales": "sales"})
    return R.explode_entries(entries, ["id"], ["sales"])


@query(
    "rows_to_entries",
    "SELECT id, min(d) AS start, list(sales ORDER BY d) AS target FROM panel GROUP BY id",
    "panel",
)
def rows_to_entries(t):
    return R.collect_series(t.panel, ["id"], "d", {"target": "sales"})


@query(
    "resample_hourly",
    """WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bucket, round(sum(value), 4) AS value, count(value) AS n FROM events GROUP BY ALL)
 SELECT * FROM b QUALIFY bucket BETWEEN min(CASE WHEN n > 0 THEN bucket END) OVER (PARTITION BY user_id) AND max(CASE WHEN n > 0 THEN bucket END) OVER (PARTITION BY user_id)""",
)
def resample_hourly(t):
    return rounded(R.resample(t.table("events"), ["user_id"], "ts", "value", "hour"), ["value"], 4)


@query("drop_first_days", "SELECT id, d, sales FROM panel WHERE d > 1000", "panel")
def drop_first_days(t):
    return R.drop_first_days(t.panel.select("id", "d", "sales"), 1000)


NAME = "cat_id || '_' || substr(dept_id, 4) || '_' || replace(item_id, '#', '') || '_' || state_id || '_' || replace(store_id, '_', '') || '_validation'"


@query(
    "parse_series_names",
    f"""WITH s AS (SELECT DISTINCT {NAME} AS series_name FROM panel), p AS (SELECT series_name, string_split(series_name, '_') AS x FROM s)
 SELECT series_name, x[1] AS cat, x[1] || '_' || x[2] AS dept, x[1] || '_' || x[2] || '_' || x[3] AS item, x[4] AS state, x[4] || '_' || x[5] AS store, x[6] AS split FROM p""",
    "panel",
)
def parse_series_names(t):
    name = F.concat_ws(
        "_", "cat_id", F.substring("dept_id", 4, 9), F.translate("item_id", "#", ""), "state_id",
        F.translate("store_id", "_", ""), F.lit("validation"),
    )
    return R.parse_id(t.panel.select(name.alias("series_name")).distinct())


@query(
    "quantile_ids",
    """WITH s AS (SELECT state_id, dept_id, quantile_cont(sales, 0.25) AS a, quantile_cont(sales, 0.75) AS b FROM panel GROUP BY ALL)
 SELECT state_id || '_' || dept_id || '_0.250_validation' AS pair_id, dept_id || '_X_0.750_validation' AS single_id, round(a, 6) AS low, round(b, 6) AS high FROM s""",
    "panel",
)
def quantile_ids(t):
    """(state, department) holds many rows, so its quantiles use the range-partitioned exact form."""
    from tidegrid.operators.ranking import exact_quantiles

    stats = exact_quantiles(t.panel, "sales", [0.25, 0.75], ["state_id", "dept_id"])
    out = stats.select(
        R.quantile_id(F.col("state_id"), F.lit(0.25), "validation", F.col("dept_id")).alias("pair_id"),
        R.quantile_id(F.col("dept_id"), F.lit(0.75), "validation").alias("single_id"),
        F.col("q0").alias("low"), F.col("q1").alias("high"),
    )
    return rounded(out, ["low", "high"])


@query(
    "relabel_split",
    """WITH s AS (SELECT id || '_validation' AS name, sum(sales) AS total FROM panel GROUP BY id)
 SELECT name, total FROM s UNION ALL SELECT replace(name, '_validation', '_evaluation'), total FROM s""",
    "panel",
)
def relabel_split(t):
    totals = t.panel.groupBy(F.concat("id", F.lit("_validation")).alias("name")).agg(F.sum("sales").alias("total"))
    return R.relabel_split(totals, "name", "_validation", "_evaluation")


# --- hierarchy -----------------------------------------------------------------------

@query(
    "hierarchy_rollup",
    f"SELECT {LEVEL} AS level, {', '.join(KEYS)}, d, sum(sales) AS sales, CAST(sum(cents) AS BIGINT) AS cents FROM panel GROUP BY {gsets('d')}",
    "panel",
)
def hierarchy_rollup(t):
    return rollup_hierarchy(t.panel, ["sales", "cents"], ["d"])


NAME_CASE = """CASE level WHEN 1 THEN 'Total_X' WHEN 2 THEN state_id || '_X' WHEN 3 THEN store_id || '_X' WHEN 4 THEN cat_id || '_X' WHEN 5 THEN dept_id || '_X'
 WHEN 6 THEN state_id || '_' || cat_id WHEN 7 THEN state_id || '_' || dept_id WHEN 8 THEN store_id || '_' || cat_id WHEN 9 THEN store_id || '_' || dept_id
 WHEN 10 THEN item_id || '_X' WHEN 11 THEN state_id || '_' || item_id WHEN 12 THEN item_id || '_' || store_id END"""


@query(
    "hierarchy_labels",
    f"""WITH r AS (SELECT {LEVEL} AS level, state_id, store_id, cat_id, dept_id, item_id, sum(sales) AS sales,
   any_value(state_id) AS fs FROM panel GROUP BY {gsets()}),
 i AS (SELECT DISTINCT item_id, dept_id AS dd, cat_id AS cc FROM panel), s AS (SELECT DISTINCT store_id, state_id AS ss FROM panel)
 SELECT level, {NAME_CASE.replace("state_id", "r.state_id").replace("store_id", "r.store_id").replace("cat_id", "r.cat_id").replace("dept_id", "r.dept_id").replace("item_id", "r.item_id")} AS series, sales, coalesce(r.state_id, s.ss, 'All') AS state_id, coalesce(r.store_id, 'All') AS store_id,
  coalesce(r.cat_id, i.cc, CASE WHEN r.dept_id IS NOT NULL THEN 'C' || substr(r.dept_id, 2, 1) END, 'All') AS cat_id,
  coalesce(r.dept_id, i.dd, 'All') AS dept_id, coalesce(r.item_id, 'All') AS item_id
 FROM r LEFT JOIN i ON i.item_id = r.item_id LEFT JOIN s ON s.store_id = r.store_id""",
    "panel",
)
def hierarchy_labels(t):
    return label_levels(rollup_hierarchy(t.panel, ["sales"], parents=True))


@query(
    "top_levels_rollup",
    """SELECT coalesce(state_id, store_id, cat_id, dept_id, 'all') AS id_str, d, sum(sales) AS sales FROM panel
 GROUP BY GROUPING SETS ((d), (state_id, d), (store_id, d), (cat_id, d), (dept_id, d))""",
    "panel",
)
def top_levels_rollup(t):
    return rollup_top(t.panel, ["sales"], ["d"])


@query(
    "level_multipliers",
    f"""WITH r AS (SELECT {LEVEL} AS level FROM (SELECT DISTINCT {', '.join(KEYS)} FROM panel) GROUP BY {gsets()})
 SELECT level, count(*) AS series_count, count(*) / (SELECT count(*)::DOUBLE FROM r WHERE level = 12) AS multiplier FROM r GROUP BY level""",
    "panel",
)
def level_multipliers(t):
    return level_scale(t.panel)


# --- cleaning ------------------------------------------------------------------------

@query(
    "release_filter",
    """WITH f AS (SELECT store_id, item_id, min(wm_yr_wk) AS release FROM prices GROUP BY ALL), s AS (SELECT DISTINCT item_id, store_id FROM panel),
 g AS (SELECT s.item_id, s.store_id, y.d, (y.d - 1) // 7 AS wk FROM s CROSS JOIN days y)
 SELECT g.item_id, g.store_id, count(*) AS days, min(g.d) AS first_day, CAST(min(f.release) - (SELECT min(release) FROM f) AS INT) AS release
 FROM g JOIN f ON f.store_id = g.store_id AND f.item_id = g.item_id WHERE g.wk >= f.release GROUP BY g.item_id, g.store_id""",
    "panel prices days",
)
def release_filter(t):
    days = t.panel.select("item_id", "store_id").distinct().select(
        "item_id", "store_id", F.explode(F.sequence(F.lit(1), t.last_day)).alias("d")
    ).withColumn("wm_yr_wk", F.expr("(d - 1) div 7").cast("int"))
    out = clean.release_filter(days, t.prices)
    return out.groupBy("item_id", "store_id").agg(
        F.count("*").alias("days"), F.min("d").alias("first_day"), F.min("release").alias("release")
    )


@query("first_nonzero_day", "SELECT id, min(d) FILTER (sales <> 0) AS first_day FROM grid GROUP BY id", "grid")
def first_nonzero_day(t):
    return clean.first_nonzero(t.grid, ["id"])


@query(
    "split_masks",
    """SELECT id, d, d <= e - 28 AS is_train, d <= e - 28 AND d > e - 56 AS is_valid, d > e - 128 AND d <= e AS is_predict FROM panel, lastday""",
    "panel lastday",
)
def split_masks(t):
    return clean.split_masks(t.panel.select("id", "d"), t.last_day - 28, 28, 100)


FOLDS = {"a": (0, 1800), "b": (1700, 2100), "c": (2000, 2499), "d": (2471, 2499)}


@query(
    "cv_windows",
    f"""WITH f AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in FOLDS.items())}) v(fold, a, b))
 SELECT p.id, p.d, p.sales, f.fold FROM panel p JOIN f ON p.d > f.a AND p.d <= f.b""",
    "panel",
)
def cv_windows(t):
    return clean.cv_windows(t.panel.select("id", "d", "sales"), FOLDS)


@query("mask_after_cutoff", "SELECT id, d, CASE WHEN d <= 2000 THEN sales END AS sales FROM panel", "panel")
def mask_after_cutoff(t):
    return clean.mask_after(t.panel.select("id", "d", "sales"), F.lit(2000))


@query(
    "exclude_periods",
    """SELECT p.id, p.d, p.sales FROM panel p JOIN calendar c ON c.d = p.d WHERE p.d >= 300 AND c.month NOT IN (10, 11, 12, 1)
 AND c.event_name_1 IS NULL""",
    "panel calendar",
)
def exclude_periods(t):
    dated = t.panel.select("id", "d", "sales").join(t.calendar.select("d", "date"), "d")
    holidays = t.calendar.filter("event_name_1 is not null").select("d")
    return clean.exclude_periods(dated, 300, [10, 11, 12, 1], holidays=holidays).select("id", "d", "sales")


@query(
    "new_item_weights",
    "SELECT id, d, CASE WHEN count(sales) OVER (PARTITION BY id ORDER BY d) < 30 THEN 0 ELSE CAST(cents AS DOUBLE) END AS weight FROM panel",
    "panel",
)
def new_item_weights(t):
    df = t.panel.select("id", "d", "sales", F.col("cents").cast("double").alias("weight"))
    return clean.zero_new_items(df, ["id"], 30).select("id", "d", "weight")


@query(
    "fill_nulls",
    """WITH m AS (SELECT id, d, CASE WHEN d % 3 <> 0 THEN sales END AS x, CASE WHEN d % 5 = 0 THEN store_id END AS s FROM panel)
 SELECT id, d, coalesce(x, -10) AS x_const, coalesce(x, (SELECT median(x) FROM m)) AS x_median,
  last_value(x IGNORE NULLS) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING) AS x_ffill, coalesce(s, 'missing') AS s FROM m""",
    "panel",
)
def fill_nulls(t):
    x = F.when(F.col("d") % 3 != 0, F.col("sales"))
    df = t.panel.select(
        "id", "d", x.alias("x_const"), x.alias("x_median"), x.alias("x_ffill"),
        F.when(F.col("d") % 5 == 0, F.col("store_id")).alias("s"),
    )
    out = clean.fill_constant(df, {"x_const": -10.0, "s": "missing"})
    return clean.fill_median(clean.fill_forward(out, ["id"], ["x_ffill"]), ["x_median"])


@query(
    "observed_indicator",
    """SELECT s.id, y.d, CAST(p.sales IS NOT NULL AS INT) AS observed, coalesce(p.sales, 0) AS sales
 FROM (SELECT id, min(d) AS f FROM panel GROUP BY id) s JOIN days y ON y.d >= s.f LEFT JOIN panel p ON p.id = s.id AND p.d = y.d""",
    "panel days",
)
def observed_indicator(t):
    gaps = R.fill_gaps(t.panel, ["id"], "d", {"sales": None}, end=t.last_day)
    return clean.observed_indicator(gaps, "sales")


@query("clip_values", "SELECT id, d, least(greatest(sales, 5), 40) AS sales FROM panel", "panel")
def clip_values(t):
    return t.panel.select("id", "d", clean.clip(F.col("sales"), 5.0, 40.0).alias("sales"))


@query(
    "clip_by_quantiles",
    """WITH b AS (SELECT quantile_cont(cents, 0.01) AS lo, quantile_cont(cents, 0.99) AS hi FROM panel)
 SELECT id, d, round(least(greatest(cents, lo), hi), 4) AS cents FROM panel, b""",
    "panel",
)
def clip_by_quantiles(t):
    df = t.panel.select("id", "d", F.col("cents").cast("double").alias("cents"))
    return rounded(clean.clip_quantile(df, "cents", 0.01, 0.99), ["cents"], 4)


@query(
    "keep_seen_events",
    """WITH s AS (SELECT DISTINCT event_name_1 AS n FROM calendar WHERE d BETWEEN 100 AND 300)
 SELECT d, CASE WHEN event_name_1 IN (SELECT n FROM s WHERE n IS NOT NULL) THEN event_name_1 END AS event_name_1 FROM calendar""",
    "calendar",
)
def keep_seen_events(t):
    return clean.keep_events(t.calendar.select("d", "event_name_1"), "event_name_1", F.lit(100), F.lit(300))


@query("sample_series")
def sample_series(t):
    sales, prices = clean.sample_series(
        [t.panel, t.prices.withColumn("id", F.concat_ws("_", "item_id", "store_id"))], "id", 0.2, 7
    )
    return sales.groupBy("id").agg(F.sum("sales").alias("sales")).join(
        prices.groupBy("id").agg(F.count("*").alias("weeks")), "id"
    )


@query("narrow_types", "SELECT id, d, CAST(cents AS BIGINT) AS cents, sales FROM panel", "panel")
def narrow_types(t):
    return clean.narrow_types(t.panel.select("id", "d", "cents", "sales"))


# --- set operations ------------------------------------------------------------------

@query(
    "union_by_name",
    """SELECT id, d, sales, NULL AS state_id FROM panel WHERE d <= 1200 UNION ALL SELECT id, d, sales, state_id FROM panel WHERE d > 1200""",
    "panel",
)
def union_by_name(t):
    return union_all([
        t.panel.filter("d <= 1200").select("id", "d", "sales"),
        t.panel.filter("d > 1200").select("state_id", "sales", "d", "id"),
    ])


@query("distinct_series", "SELECT DISTINCT item_id, dept_id, store_id FROM panel", "panel")
def distinct_series(t):
    return t.panel.select("item_id", "dept_id", "store_id").distinct()


@query(
    "id_set_check",
    """WITH f AS (SELECT DISTINCT id FROM panel WHERE d <= 1500), e AS (SELECT DISTINCT id FROM panel WHERE d > 500)
 SELECT (SELECT count(*) FROM (SELECT id FROM e EXCEPT SELECT id FROM f)) AS missing, (SELECT count(*) FROM (SELECT id FROM f EXCEPT SELECT id FROM e)) AS unexpected,
  (SELECT count(*) FROM (SELECT id FROM f INTERSECT SELECT id FROM e)) AS common""",
    "panel",
)
def id_set_check(t):
    return encode.check_ids(t.panel.filter("d <= 1500").select("id"), t.panel.filter("d > 500").select("id"), "id")
