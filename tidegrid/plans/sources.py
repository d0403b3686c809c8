"""Queries that write derived tables in each format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.reshape import collect_series
from tidegrid.plans.registry import query
from tidegrid.sources import entries as N
from tidegrid.sources import files as S
from tidegrid.sources.retail import day_to_date


@query("csv_scan", "SELECT store_id, item_id, wm_yr_wk, round(sell_price, 2) AS sell_price FROM (SELECT store_id, item_id, wm_yr_wk, floor(sell_price) + 0.25 AS sell_price FROM prices)", "prices")
def csv_scan(t):
    path = S.new_path(t.spark, "prices") + ".csv"
    t.prices.select("store_id", "item_id", "wm_yr_wk", (F.floor("sell_price") + 0.25).alias("sell_price")).write.option("header", "true").csv(path)
    return S.read_table(t.spark, path, S.PRICES_SCHEMA)


def _back(i):
    return f"max(CASE WHEN d = e - {i} THEN sales END) AS back_{i}"


@query("pruned_scan", f"SELECT id, {', '.join(_back(i) for i in range(7))} FROM panel, lastday GROUP BY id", "panel lastday")
def pruned_scan(t):
    """Only the last seven of the stored table's day columns are read."""
    from tidegrid.plans.reshape import day_columns

    recent = S.last_days(day_columns(t), ["id"], 7)
    return recent.select("id", *[F.col(c).alias(f"back_{i}") for i, c in enumerate(reversed(recent.columns[1:]))])


def series_entries(t):
    e = collect_series(t.panel, ["id"], "d", {"target": "sales"})
    return e.select(F.col("id").alias("item_id"), day_to_date(F.col("start")).cast("string").alias("start"), "target")


@query(
    "jsonl_scan",
    """SELECT id AS item_id, CAST(DATE '1995-01-02' + (min(d) - 1) AS DATE)::VARCHAR AS start, list(sales ORDER BY d) AS target, any_value(store_id) AS store_id,
 row_number() OVER (PARTITION BY any_value(store_id) ORDER BY id) - 1 AS source_line FROM panel GROUP BY id""",
    "panel",
)
def jsonl_scan(t):
    """One file a store, its series in order: the line is the series' place."""
    path = S.new_path(t.spark, "entries")
    stores = t.panel.groupBy(F.col("id").alias("item_id")).agg(F.min("store_id").alias("store_id"))
    entries = series_entries(t).join(stores, "item_id").repartition("store_id").sortWithinPartitions("store_id", "item_id")
    entries.write.partitionBy("store_id").json(path)
    store = F.regexp_extract("source_file", "store_id=([^/]+)/", 1)
    return S.read_jsonl(t.spark, f"{path}/*").select("item_id", "start", "target", store.alias("store_id"), "source_line")


@query(
    "validate_entries",
    """WITH e AS (SELECT id AS item_id, CASE WHEN substr(id, -1) = '7' THEN NULL ELSE CAST(DATE '1995-01-02' + (min(d) - 1) AS DATE) END AS start, list(sales) FILTER (sales > 45) AS target FROM panel GROUP BY id)
 SELECT item_id, CASE WHEN start IS NULL THEN 'missing start' WHEN len(coalesce(target, [])) = 0 THEN 'empty target' WHEN isodow(start) <> 1 THEN 'start is not aligned to week' END AS problem FROM e""",
    "panel",
)
def validate_entries(t):
    e = t.panel.groupBy(F.col("id").alias("item_id")).agg(
        F.min("d").alias("first"), F.collect_list(F.when(F.col("sales") > 45, F.col("sales"))).alias("target")
    )
    start = F.when(~F.col("item_id").endswith("7"), day_to_date(F.col("first")).cast("timestamp_ntz"))
    return N.validate_entries(e.withColumn("start", start), "week", ["item_id", "start"], {"target": 1}).select("item_id", "problem")


@query(
    "start_time_zones",
    """SELECT event_id, date_trunc('second', ts) AS ignored, date_trunc('second', ts) - to_minutes(CASE event_id % 3 WHEN 1 THEN 120 WHEN 2 THEN -330 ELSE 0 END) AS utc FROM events""",
)
def start_time_zones(t):
    """Times as text, two in three with an offset, under two of the rules."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 3 == 1, "+02:00").when(F.col("event_id") % 3 == 2, "-0530").otherwise("")
    e = t.table("events").select("event_id", F.concat(text, zone).alias("ignored"), F.concat(text, zone).alias("utc"))
    return N.utc_start(N.utc_start(e, "ignore", "ignored"), "utc", "utc")


@query(
    "dataset_round_trip",
    """WITH c AS (SELECT store_id, CAST(dense_rank() OVER (ORDER BY store_id) - 1 AS INT) AS code FROM (SELECT DISTINCT store_id FROM panel)),
 e AS (SELECT id AS item_id, CASE WHEN d <= 2000 THEN 'train' ELSE 'test' END AS split, list(CASE WHEN d % 9 <> 0 THEN sales END ORDER BY d) AS target,
  [any_value(code)] AS feat_static_cat, [list(CASE WHEN d % 5 <> 0 THEN CAST(d % 7 AS DOUBLE) END ORDER BY d)] AS feat_dynamic_real FROM panel JOIN c USING (store_id) GROUP BY ALL)
 SELECT *, 'D' AS freq, CAST((SELECT count(*) FROM c) AS INT) AS stores FROM e""",
    "panel",
)
def dataset_round_trip(t):
    """Target, a static code and a dynamic feature, with missing values, in two splits; the manifest's metadata beside them."""
    from tidegrid.operators.encode import encode_ordinal

    split = F.when(F.col("d") <= 2000, "train").otherwise("test")
    codes = S.checkpoint_table(encode_ordinal(t.panel.select("store_id").distinct(), "store_id", "code"), "codes")
    gaps = t.panel.select(
        "id", "store_id", "d", split.alias("split"), F.when(F.col("d") % 9 != 0, F.col("sales")).alias("sales"),
        F.when(F.col("d") % 5 != 0, (F.col("d") % 7).cast("double")).alias("weekday"),
    ).join(codes, "store_id")
    e = collect_series(gaps, ["id", "split", "code"], "d", {"target": "sales", "weekday": "weekday"}).select(
        F.col("id").alias("item_id"), F.col("start").cast("string").alias("start"), "target", "split",
        F.array("code").alias("feat_static_cat"), F.array("weekday").alias("feat_dynamic_real"),
    )
    path = S.new_path(t.spark, "dataset")
    S.write_dataset(e, path, freq="D", prediction_length=28, cardinality={"store": codes.count()})
    known = S.read_manifest(t.spark, path)["metadata"]
    return S.read_dataset(t.spark, path).select(
        "item_id", "split", "target", "feat_static_cat", "feat_dynamic_real", F.lit(known["freq"]).alias("freq"), F.lit(known["cardinality"]["store"]).alias("stores"),
    )


@query("stage_table", "SELECT id, store_id, d, sales FROM panel", "panel")
def stage_table(t):
    return S.checkpoint_table(t.panel.select("id", "store_id", "d", "sales"), "stage", ["store_id"]).select("id", "store_id", "d", "sales")


@query("files_by_key", "SELECT id, d, sales, store_id, cat_id FROM panel WHERE store_id = 'NATION_3'", "panel")
def files_by_key(t):
    path = S.new_path(t.spark, "by-key")
    S.write_by_key(t.panel.select("id", "d", "sales", "store_id", "cat_id"), path, ["store_id", "cat_id"])
    return S.read_by_key(t.spark, path, store_id="NATION_3").select("id", "d", "sales", "store_id", "cat_id")


POINT = T.StructType([T.StructField("id", T.StringType()), T.StructField("mean_sales", T.DoubleType())])


@query("forecast_csv", "SELECT id, round(avg(sales), 3) AS mean_sales FROM panel GROUP BY id", "panel")
def forecast_csv(t):
    path = S.new_path(t.spark, "forecast") + ".csv"
    S.write_forecast(t.panel.groupBy("id").agg(F.avg("sales").alias("mean_sales")), path, 3)
    return S.read_table(t.spark, path, POINT)


@query(
    "many_files_scan",
    "SELECT id, sum(sales) AS mean_sales FROM panel WHERE d <= 1000 GROUP BY id UNION ALL SELECT id, sum(sales) FROM panel WHERE d > 1000 GROUP BY id",
    "panel",
)
def many_files_scan(t):
    root = S.new_path(t.spark, "many")
    for name, part in (("sub_a", t.panel.filter("d <= 1000")), ("sub_b", t.panel.filter("d > 1000"))):
        S.write_forecast(part.groupBy("id").agg(F.sum("sales").alias("mean_sales")), f"{root}/{name}")
    return S.read_many(t.spark, f"{root}/sub_*", POINT).drop("source_file")


@query(
    "table_to_entries",
    """WITH s AS (SELECT id, list(sales ORDER BY p.d) AS target, list(CAST(c.wday AS DOUBLE) ORDER BY p.d) AS a, list(CAST(c.month AS DOUBLE) ORDER BY p.d) AS b, min(p.d) AS start,
  any_value(dept_id) AS dept_id, any_value(store_id) AS store_id FROM panel p JOIN calendar c ON c.d = p.d GROUP BY id)
 SELECT id, CAST(start AS INT) AS start, target, [a, b] AS feat_dynamic_real, [CAST(dense_rank() OVER (ORDER BY dept_id) - 1 AS INT), CAST(dense_rank() OVER (ORDER BY store_id) - 1 AS INT)] AS feat_static_cat,
  [CAST((SELECT count(DISTINCT dept_id) FROM s) AS INT), CAST((SELECT count(DISTINCT store_id) FROM s) AS INT)] AS cardinalities FROM s""",
    "panel calendar",
)
def table_to_entries(t):
    return N.to_entries(t.panel.select("id", "dept_id", "store_id", "d", "sales"), t.calendar, "id", ["dept_id", "store_id"], ["wday", "month"])


@query(
    "ragged_to_entries",
    """WITH w AS (SELECT id, list(sales ORDER BY d) FILTER (d <= 2000) AS a, list(sales ORDER BY d) FILTER (d > 2000) AS b FROM panel GROUP BY id), j AS (SELECT id, list_concat(coalesce(a, []), coalesce(b, [])) AS t, len(coalesce(a, [])) AS n FROM w)
 SELECT id, t[greatest(1, len(t) - 59):] AS target, CAST(n AS INT) AS train_length FROM j""",
    "panel",
)
def ragged_to_entries(t):
    """Train and test arrays padded with nulls on the right to one common width, as in a wide file."""
    halves = t.panel.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("d") <= 2000, F.struct("d", "sales")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("d") > 2000, F.struct("d", "sales")))).alias("b"),
    )
    pad = F.array_repeat(F.lit(None).cast("double"), 40)
    wide = halves.select("id", F.concat(F.col("a")["sales"], pad).alias("a"), F.concat(F.col("b")["sales"], pad).alias("b"))
    return N.ragged_to_entries(wide, "id", "a", "b", 60)
