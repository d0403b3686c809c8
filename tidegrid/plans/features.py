"""Queries over date features, holidays, scaling and binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import binning as B
from tidegrid.functions import calendar as C
from tidegrid.functions import holidays as H
from tidegrid.functions import scaling as S
from tidegrid.plans.helpers import rnd, rounded
from tidegrid.plans.registry import query


@query(
    "calendar_parts",
    """SELECT d, CAST(day(date) AS INT) AS tm_d, CAST(weekofyear(date) AS INT) AS tm_w, CAST(month(date) AS INT) AS tm_m,
 CAST(year(date) - (SELECT min(year) FROM calendar) AS INT) AS tm_y, CAST(ceil(day(date) / 7.0) AS INT) AS tm_wm, CAST(isodow(date) - 1 AS INT) AS tm_dw, CAST(isodow(date) >= 6 AS INT) AS tm_w_end FROM calendar""",
    "calendar",
)
def calendar_parts(t):
    return C.with_calendar_parts(t.calendar.select("d", "date"), "date").drop("date")


@query("day_group", "SELECT d, CAST(least(6, ceil(day(date) / 5.0)) AS INT) AS group_day FROM calendar", "calendar")
def day_group(t):
    return t.calendar.select("d", C.day_group("date").alias("group_day"))


@query(
    "hourly_time_features",
    f"""SELECT event_id, {rnd('hour(ts) / 23.0::DOUBLE - 0.5', 'hour_of_day')}, {rnd('(isodow(ts) - 1) / 6.0::DOUBLE - 0.5', 'day_of_week')},
 {rnd('day(ts) / 30.0::DOUBLE - 0.5', 'day_of_month')}, {rnd('dayofyear(ts) / 364.0::DOUBLE - 0.5', 'day_of_year')} FROM events""",
)
def hourly_time_features(t):
    out = C.time_features(t.table("events").select("event_id", "ts"), "ts", "hour").drop("ts")
    return rounded(out, out.columns[1:])


@query(
    "weekly_time_features",
    f"SELECT d, {rnd('day(date) / 30.0::DOUBLE - 0.5', 'day_of_month')}, {rnd('weekofyear(date) / 51.0::DOUBLE - 0.5', 'week_of_year')} FROM calendar",
    "calendar",
)
def weekly_time_features(t):
    out = C.time_features(t.calendar.select("d", "date"), "date", "week").drop("date")
    return rounded(out, out.columns[1:])


def _four(expr, n, src):
    a = f"2 * pi() * ({expr}) / ((SELECT max({expr}) FROM {src}) + 1)"
    return f"{rnd(f'cos({a})', f'{n}_cos')}, {rnd(f'sin({a})', f'{n}_sin')}"


@query("fourier_features", f"SELECT event_id, {_four('hour(ts)', 'hour_of_day', 'events')}, {_four('isodow(ts) - 1', 'day_of_week', 'events')} FROM events")
def fourier_features(t):
    out = C.fourier_features(t.table("events").select("event_id", "ts"), "ts", "hour").drop("ts")
    return rounded(out, out.columns[1:])


DAY_LAGS = [1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 15, 20, 21, 22, 27, 28, 29, 30, 31, 56, 84, 363, 364, 365, 727, 728, 729, 1091, 1092, 1093]


@query(
    "lags_for_frequency",
    "WITH s AS (SELECT store_id, d, sum(sales) AS sales FROM grid GROUP BY ALL) SELECT store_id, d, " + ", ".join(f"lag(sales, {n}) OVER w AS lag_{n}" for n in DAY_LAGS)
    + " FROM s WINDOW w AS (PARTITION BY store_id ORDER BY d)",
    "grid",
)
def lags_for_frequency(t):
    """Every lag of the daily list, of the stores' gap-free days."""
    from tidegrid.operators.windows import add_lags

    stores = t.grid.groupBy("store_id", "d").agg(F.sum("sales").alias("sales"))
    return add_lags(stores, ["store_id"], C.lags_for("day")).drop("sales")


# Known Easter Sundays, as an independent check of the rule.
EASTERS = ["1994-04-03", "1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23", "2001-04-15", "2002-03-31"]


def _near(cond, name):
    return f"(SELECT CAST(date_diff('day', min(h.date), c.date) AS INT) FROM h WHERE {cond} AND abs(date_diff('day', h.date, c.date)) <= 187) AS {name}"


@query(
    "holiday_distances",
    f"""WITH h AS (SELECT CAST(x AS DATE) AS date FROM (SELECT unnest(range(TIMESTAMP '1993-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS x))
 SELECT c.d, {_near("month(h.date) = 12 AND day(h.date) = 25", 'christmas_day')},
 {_near("month(h.date) = 11 AND isodow(h.date) = 4 AND day(h.date) BETWEEN 22 AND 28", 'thanksgiving')},
 {_near("month(h.date) = 5 AND isodow(h.date) = 1 AND day(h.date) > 24", 'memorial_day')},
 {_near("month(h.date) = 1 AND isodow(h.date) = 1 AND day(h.date) BETWEEN 15 AND 21", 'martin_luther_king_day')},
 {_near("month(h.date) = 2 AND isodow(h.date) = 7 AND day(h.date) <= 7", 'superbowl')},
 {_near("CAST(h.date AS VARCHAR) IN (" + ", ".join(f"'{e}'" for e in EASTERS) + ")", 'easter_sunday')} FROM calendar c""",
    "calendar",
)
def holiday_distances(t):
    names = ["christmas_day", "thanksgiving", "memorial_day", "martin_luther_king_day", "superbowl", "easter_sunday"]
    return t.calendar.select("d", *[H.distance_to_holiday("date", n).alias(n) for n in names])


@query(
    "holiday_kernels",
    """WITH x AS (SELECT d, date, CAST(date_diff('day', make_date(CAST(CASE WHEN month(date) <= 6 THEN year(date) - 1 ELSE year(date) END AS BIGINT), 12, 25), date) AS DOUBLE) AS g FROM calendar)
 SELECT d, CAST(month(date) = 12 AND day(date) = 25 AS DOUBLE) AS ind, round(CASE WHEN exp(-0.5 * abs(g)) > 1e-9 THEN exp(-0.5 * abs(g)) ELSE 0 END, 8) AS expo, round(CASE WHEN exp(-g * g) > 1e-9 THEN exp(-g * g) ELSE 0 END, 8) AS squared FROM x""",
    "calendar",
)
def holiday_kernels(t):
    g = H.distance_to_holiday("date", "christmas_day")
    out = t.calendar.select(
        "d", H.indicator(g).alias("ind"), H.exponential_kernel(0.5)(g).alias("expo"), H.squared_exponential_kernel()(g).alias("squared")
    )
    return rounded(out, ["expo", "squared"], 8)


@query(
    "moon_phase",
    """WITH x AS (SELECT d, 0.20439731::DOUBLE + date_diff('day', DATE '2001-01-01', date) * 0.03386319269::DOUBLE AS l FROM calendar)
 SELECT d, CAST(CAST(floor((l - floor(l)) * 8 + 0.5) AS INT) % 8 AS INT) AS moon FROM x""",
    "calendar",
)
def moon_phase(t):
    return t.calendar.select("d", C.moon_phase("date").alias("moon"))


@query(
    "price_cents",
    f"""SELECT store_id, item_id, wm_yr_wk, {rnd('sell_price - floor(sell_price)', 'cents')}, {rnd('max(sell_price) OVER w - floor(max(sell_price) OVER w)', 'cents_max')} FROM prices WINDOW w AS (PARTITION BY store_id, item_id)""",
    "prices",
)
def price_cents(t):
    top = t.prices.groupBy("store_id", "item_id").agg(F.max("sell_price").alias("m"))
    out = t.prices.join(top, ["store_id", "item_id"]).select(
        "store_id", "item_id", "wm_yr_wk", C.cents(F.col("sell_price")).alias("cents"), C.cents(F.col("m")).alias("cents_max")
    )
    return rounded(out, ["cents", "cents_max"])


@query(
    "event_type_columns",
    "SELECT d, " + ", ".join(f"CASE WHEN event_type_1 = '{k}' THEN event_name_1 WHEN event_type_2 = '{k}' THEN event_name_2 ELSE 'None' END AS {k.lower()}_holiday" for k in ("National", "Cultural", "Religious")) + " FROM calendar",
    "calendar",
)
def event_type_columns(t):
    return C.event_type_columns(t.calendar, ["National", "Cultural", "Religious"]).select("d", "national_holiday", "cultural_holiday", "religious_holiday")


@query(
    "age_feature",
    f"SELECT id, d, {rnd('log10(2.0::DOUBLE + row_number() OVER (PARTITION BY id ORDER BY d) - 1)', 'age')} FROM grid",
    "grid",
)
def age_feature(t):
    return rounded(C.age_feature(t.grid.select("id", "d"), ["id"], "d"), ["age"])


@query(
    "constant_feature",
    "SELECT id, len(list(sales)) + 28 AS length, (len(list(sales)) + 28) * 3.0::DOUBLE AS total FROM panel GROUP BY id",
    "panel",
)
def constant_feature(t):
    from tidegrid.operators.reshape import collect_series

    out = C.const_feature(collect_series(t.panel, ["id"], "d", {"target": "sales"}), 3.0, 28)
    return out.select("id", F.size("feat_const").cast("bigint").alias("length"), F.aggregate("feat_const", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("log_trend", f"SELECT id, d, {rnd('ln(1.0::DOUBLE + d - (SELECT min(d) FROM panel))', 'logd')} FROM panel", "panel")
def log_trend(t):
    return rounded(C.log_trend(t.panel.select("id", "d")), ["logd"])


@query(
    "minmax_scaling",
    f"""WITH f AS (SELECT min(sales) AS a, max(sales) AS b, min(cents) AS c, max(cents) AS e FROM panel WHERE d <= 2000)
 SELECT id, d, {rnd('(sales - a) / (b - a)', 'sales')}, {rnd('(CAST(cents AS DOUBLE) - c) / (e - c)', 'cents')} FROM panel, f""",
    "panel",
)
def minmax_scaling(t):
    df = t.panel.select("id", "d", "sales", F.col("cents").cast("double").alias("cents"))
    fit = S.minmax_fit(df.filter("d <= 2000"), ["sales", "cents"])
    return rounded(S.minmax_apply(df, fit, ["sales", "cents"]), ["sales", "cents"])


@query(
    "mean_abs_scaling",
    f"""WITH x AS (SELECT id, d, CASE WHEN store_id <> 'NATION_3' THEN sales ELSE 0 END AS sales FROM panel), p AS (SELECT id, sum(abs(sales)) AS s, count(sales) AS n FROM x GROUP BY id),
 c AS (SELECT id, CASE WHEN s > 0 THEN s / n ELSE (SELECT sum(s) / sum(n) FROM p) END AS scale FROM p)
 SELECT x.id, x.d, {rnd('c.scale', 'scale')}, {rnd('least(greatest(x.sales / c.scale, -2), 2)', 'scaled')}, {rnd('x.sales', 'back')} FROM x JOIN c ON c.id = x.id""",
    "panel",
)
def mean_abs_scaling(t):
    """One store's series are all zero here, so they take the global scale."""
    df = t.panel.select("id", "d", F.when(F.col("store_id") != "NATION_3", F.col("sales")).otherwise(0.0).alias("sales"))
    scale = S.mean_scale(df, ["id"], "sales")
    out = S.apply_scale(df, scale, ["id"], "sales", "scaled", clip=2.0).withColumn("_raw", F.col("sales") / F.col("scale"))
    out = S.unscale(out, "_raw", "back").drop("_raw", "sales")
    return rounded(out, ["scale", "scaled", "back"])


EDGES = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query(
    "digitize_scaled",
    "WITH m AS (SELECT id, avg(abs(sales)) AS m FROM panel GROUP BY id) SELECT p.id, p.d, CAST(" + " + ".join(f"CAST(p.sales / m.m >= {e} AS INT)" for e in EDGES) + " AS INT) AS bin FROM panel p JOIN m ON m.id = p.id",
    "panel",
)
def digitize_scaled(t):
    return B.digitize_scaled(t.panel.select("id", "d", "sales"), ["id"], "sales", EDGES).select("id", "d", "bin")


NB = 8
P_GLOBAL = ", ".join(str(p) for p in B.linspace(0.0, 0.99, NB))
P_LOCAL = ", ".join(str(p) for p in B.linspace(0.0, 1.0, NB))


def _bin_expr(x):
    return "1 + " + " + ".join(f"CAST({x} >= (c[{i}] + c[{i + 1}]) / 2 AS INT)" for i in range(1, NB))


@query(
    "bin_global",
    f"""WITH m AS (SELECT id, avg(sales) AS m FROM panel GROUP BY id), r AS (SELECT p.id, p.d, m.m, p.sales / m.m AS x FROM panel p JOIN m ON m.id = p.id),
 q AS (SELECT quantile_cont(x, [{P_GLOBAL}]) AS c FROM r), b AS (SELECT id, d, m, c, CAST({_bin_expr('x')} AS INT) AS bin FROM r, q)
 SELECT id, d, bin, {rnd('c[bin] * m', 'decoded')} FROM b""",
    "panel",
)
def bin_global(t):
    out = B.bin_global(t.panel.select("id", "d", "sales"), ["id"], "sales", NB)
    return rounded(out.select("id", "d", "bin", "decoded"), ["decoded"])


@query(
    "bin_global_linear",
    f"""WITH m AS (SELECT id, avg(sales) AS m FROM panel GROUP BY id), r AS (SELECT p.id, p.d, m.m, p.sales / m.m AS x, [{", ".join(str(x) for x in B.linspace(0.0, 10.0, NB))}]::DOUBLE[] AS c FROM panel p JOIN m ON m.id = p.id),
 b AS (SELECT id, d, m, c, CAST({_bin_expr('x')} AS INT) AS bin FROM r) SELECT id, d, bin, {rnd('c[bin] * m', 'decoded')} FROM b""",
    "panel",
)
def bin_global_linear(t):
    out = B.bin_global(t.panel.select("id", "d", "sales"), ["id"], "sales", NB, quantile=False)
    return rounded(out.select("id", "d", "bin", "decoded"), ["decoded"])


@query(
    "bin_local",
    f"""WITH q AS (SELECT id, quantile_cont(sales, [{P_LOCAL}]) AS c FROM panel GROUP BY id), b AS (SELECT p.id, p.d, c, CAST({_bin_expr('p.sales')} AS INT) AS bin FROM panel p JOIN q ON q.id = p.id)
 SELECT id, d, bin, {rnd('c[bin]', 'decoded')} FROM b""",
    "panel",
)
def bin_local(t):
    out = B.bin_local(t.panel.select("id", "d", "sales"), ["id"], "sales", NB)
    return rounded(out.select("id", "d", "bin", "decoded"), ["decoded"])


@query(
    "bin_custom_and_chain",
    """SELECT id, d, CAST(1 + CAST(sales >= 5.5 AS INT) + CAST(sales >= 20.5 AS INT) + CAST(sales >= 40.5 AS INT) AS INT) AS custom,
 (1 + CAST(sales >= 5.5 AS INT) + CAST(sales >= 20.5 AS INT) + CAST(sales >= 40.5 AS INT)) / 4.0::DOUBLE AS share,
 CAST(least(4, floor((1 + CAST(sales >= 5.5 AS INT) + CAST(sales >= 20.5 AS INT) + CAST(sales >= 40.5 AS INT)) / 4.0 * 4) + 1) AS INT) AS restored FROM panel""",
    "panel",
)
def bin_custom_and_chain(t):
    steps = [lambda x: B.bin_custom(x, [1.0, 10.0, 31.0, 50.0]), lambda b: B.pit(b, 4)]
    share = B.chain(F.col("sales"), steps)
    encodings = {"custom": steps[0](F.col("sales")), "share": share, "restored": B.unpit(share, 4)}
    return B.hybrid(t.panel.select("id", "d", "sales"), encodings).drop("sales")


@query(
    "empirical_cdf_scores",
    """WITH r AS (SELECT id, d, sales, rank() OVER (PARTITION BY id ORDER BY sales) - 1 AS l, count(*) OVER (PARTITION BY id, sales) AS c, count(*) OVER (PARTITION BY id) AS m FROM panel),
 s AS (SELECT id, d, m, CASE WHEN c = 1 THEN l / m::DOUBLE ELSE (l + c // 2 - 1) / m::DOUBLE END AS q, 1 / (4 * pow(m, 0.25) * sqrt(3.14 * ln(m))) AS cut FROM r)
 SELECT id, d, round(least(greatest(q, cut), 1 - cut), 8) AS cdf FROM s""",
    "panel",
)
def empirical_cdf_scores(t):
    out = S.cdf_transform(t.panel.select("id", "d", "sales"), None, ["id"], "sales")
    return rounded(out.select("id", "d", "cdf"), ["cdf"], 8)


@query("empirical_cdf_round_trip")
def empirical_cdf_round_trip(t):
    """History up to a day, later rows scored by it and brought back."""
    past, later = t.panel.filter("d <= 2000"), t.panel.filter("d > 2000").select("id", "d", "sales")
    scored = S.cdf_transform(past, later, ["id"], "sales").withColumnRenamed("sales", "original")
    return S.cdf_inverse(past, scored, ["id"], "sales", "score")


@query(
    "boxcox",
    f"SELECT id, d, {rnd('(pow(sales + 1, 0.3) - 1) / 0.3', 'y')}, {rnd('ln(sales + 1)', 'y_log')}, {rnd('sales', 'back', 4)} FROM panel",
    "panel",
)
def boxcox(t):
    df = t.panel.select("id", "d", S.boxcox(F.col("sales"), 0.3, 1.0).alias("y"), S.boxcox(F.col("sales"), 0.0, 1.0).alias("y_log"))
    out = df.withColumn("back", S.boxcox_inverse(F.col("y"), 0.3, 1.0))
    return rounded(rounded(out, ["y", "y_log"]), ["back"], 4)


@query(
    "entry_fields",
    """WITH e AS (SELECT id, list(sales ORDER BY d) AS target, list(CAST(d AS DOUBLE) ORDER BY d) AS days FROM panel GROUP BY id)
 SELECT id AS item, 'D' AS freq, [target, days] AS matrix, [0, 1] AS dims, list_concat(target, days) AS joined, [days] AS expanded FROM e""",
    "panel",
)
def entry_fields(t):
    """Rename, set, stack, index, concat, expand and select fields of array entries."""
    from tidegrid.operators.reshape import collect_series

    e = collect_series(t.panel.withColumn("day", F.col("d").cast("double")), ["id"], "d", {"target": "sales", "days": "day"})
    e = S.set_field(S.rename_fields(e, {"id": "item"}), "freq", F.lit("D"), only_if_absent=True)
    e = e.withColumns({"a": F.col("target"), "b": F.col("days"), "expanded": F.col("days")})
    e = S.add_dim_index(S.stack_fields(e, ["target", "days"], "matrix"), "matrix", "dims")
    e = S.expand_dims(S.concat_fields(e, ["a", "b"], "joined"), "expanded")
    return S.select_fields(e, ["item", "freq", "matrix", "dims", "joined", "expanded", "absent"])


@query("noise_features")
def noise_features(t):
    """Sales with added noise; each series' volatility, which is positive, with a random factor."""
    from tidegrid.operators.windows import trailing_vol

    df = trailing_vol(t.grid.select("id", "d", "sales"), ["id"]).withColumnRenamed("trailing_vol", "scaler")
    return S.scale_noise(S.add_noise(df, {"sales": 0.5}, ["id", "d"], 11), {"scaler": 0.5}, ["id", "d"], 12)


@query(
    "scale_by_volatility",
    f"""WITH j AS (SELECT id, d, sales, abs(sales - lag(sales) OVER w) AS j FROM grid WINDOW w AS (PARTITION BY id ORDER BY d)), v AS (SELECT id, d, CASE WHEN d % 10 = 0 THEN -10 ELSE sales END AS sales, avg(j) OVER (PARTITION BY id ORDER BY d) AS v FROM j)
 SELECT id, d, {rnd('CASE WHEN sales = -10 THEN sales WHEN v <> 0 THEN sales / v END', 'sales')} FROM v""",
    "grid",
)
def scale_by_volatility(t):
    from tidegrid.operators.windows import trailing_vol

    df = trailing_vol(t.grid.select("id", "d", "sales"), ["id"])
    df = df.withColumn("sales", F.when(F.col("d") % 10 == 0, F.lit(-10.0)).otherwise(F.col("sales")))
    return rounded(S.scale_by_vol(df, ["sales"], "trailing_vol").select("id", "d", "sales"), ["sales"])
