"""Queries over splits, instances and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import splits as X
from tidegrid.plans.helpers import rounded
from tidegrid.plans.registry import query
from tidegrid.sources.retail import day_to_date

ID = ["id"]


def base(t):
    return t.panel.select("id", "d", "sales")


def days(t):
    """Every day of every series."""
    return t.grid.select("id", "d", "sales")


def digest(column, scale=1):
    """md5 of an array's whole numbers (after ``scale``): instances are many, and so are compared by value but not by length."""
    return F.md5(F.array_join(F.transform(column, lambda x: F.round(x * scale).cast("bigint").cast("string")), ",")).alias(column)


def _digest(values, name, scale=1):
    return f"md5(array_to_string(list_transform({values}, lambda x: CAST(round(x * {scale}) AS BIGINT)), ',')) AS {name}"


def _left(values, length, zero="0.0", kind="DOUBLE[]"):
    return f"list_concat(list_resize([]::{kind}, {length} - len({values}), {zero}), {values})"


def _pad(values, length):
    return f"list_concat(list_resize([]::INT[], {length} - len({values}), 1), list_resize([]::INT[], len({values}), 0))"


@query(
    "split_by_offset",
    """WITH r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS p FROM grid) SELECT id, d, p <= 50 AS in_train, TRUE AS in_test FROM r WHERE p <= 78""",
    "grid",
)
def split_by_offset(t):
    return X.split_offset(days(t).drop("sales"), ID, 50, 28)


@query("split_by_date", "SELECT id, d, d <= 2000 AS in_train, TRUE AS in_test FROM panel WHERE d <= 2028", "panel")
def split_by_date(t):
    return X.split_date(base(t).drop("sales"), F.lit(2000), 28)


@query(
    "rolling_splits",
    """WITH r AS (SELECT id, d, w AS "window", row_number() OVER (PARTITION BY id, w ORDER BY d DESC) AS b FROM panel, (SELECT CAST(unnest(range(0, 5)) AS INT) AS w) WHERE d <= 2000 + w * 100 + 28)
 SELECT id, d, "window" FROM r WHERE b <= 40""",
    "panel",
)
def rolling_splits(t):
    return X.rolling_split(base(t).drop("sales"), F.lit(2000), 28, 5, 100, 40, ID)


def _frame(a, b):
    return f"(PARTITION BY id ORDER BY d ROWS BETWEEN {a} AND {b})"


@query(
    "training_instances",
    f"""WITH r AS (SELECT id, d, row_number() OVER w - 1 AS pos, coalesce(list(sales) OVER {_frame('30 PRECEDING', '1 PRECEDING')}, []) AS p,
  coalesce(list(sales) OVER {_frame('2 FOLLOWING', '8 FOLLOWING')}, []) AS f, lead(d, 2) OVER w AS forecast_start FROM grid WINDOW w AS (PARTITION BY id ORDER BY d))
 SELECT id, CAST(pos AS INT) AS pos, forecast_start, {_digest(_left('p', 30), 'past_target')}, {_digest('f', 'future_target')}, {_digest(_pad('p', 30), 'past_is_pad')} FROM r WHERE len(f) = 7""",
    "grid",
)
def training_instances(t):
    made = X.make_instances(days(t), ID, 30, 7, lead=2)
    return made.select("id", "pos", "forecast_start", digest("past_target"), digest("future_target"), digest("past_is_pad"))


@query(
    "prediction_instances",
    """WITH r AS (SELECT id, list(sales ORDER BY d) AS s, max(d) AS e FROM grid GROUP BY id), x AS (SELECT id, e, s[greatest(1, len(s) - 199):] AS p FROM r)
 SELECT id, CAST(e + 1 AS INT) AS forecast_start, list_concat(list_resize([]::DOUBLE[], 200 - len(p), 0.0), p) AS past_target,
  list_concat(list_resize([]::INT[], 200 - len(p), 1), list_resize([]::INT[], len(p), 0)) AS past_is_pad FROM x""",
    "grid",
)
def prediction_instances(t):
    return X.predict_instances(days(t), ID, 200)


@query(
    "canonical_instances",
    f"""WITH r AS (SELECT id, d AS last_day, row_number() OVER (PARTITION BY id ORDER BY d) AS pos, list(sales) OVER {_frame('19 PRECEDING', 'CURRENT ROW')} AS p FROM grid)
 SELECT id, CAST(pos AS INT) AS pos, last_day, {_digest(_left('p', 20), 'past_target')}, {_digest(_pad('p', 20), 'past_is_pad')} FROM r""",
    "grid",
)
def canonical_instances(t):
    made = X.make_instances_canonical(days(t), ID, 20, pad=True)
    return made.select("id", "pos", "last_day", digest("past_target"), digest("past_is_pad"))


CUTS = [120.0, 240.0, 360.0, 480.0, 600.0]
HOURS = "epoch_us(ts - TIMESTAMP '2024-01-01') / 3600000000.0::DOUBLE"


def hours(c="ts"):
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    return micros / F.lit(3600000000.0)


@query(
    "continuous_time_instances",
    """WITH e AS (SELECT user_id, event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS h FROM events),
 w AS (SELECT c AS cut, 'past' AS part, c - 100 AS a, c AS b FROM (SELECT unnest([120.0, 240.0, 360.0, 480.0, 600.0]::DOUBLE[]) AS c) UNION ALL
  SELECT c, 'future', c, c + 24 FROM (SELECT unnest([120.0, 240.0, 360.0, 480.0, 600.0]::DOUBLE[]) AS c))
 SELECT user_id, event_id, event_type, cut, part, round(h - coalesce(lag(h) OVER (PARTITION BY user_id, cut, part ORDER BY h, event_id), a), 6) AS gap FROM e JOIN w ON h >= a AND h < b""",
)
def continuous_time_instances(t):
    _, members = _ct_windows(t, "event_id", "event_type")
    return rounded(members.drop("h"), ["gap"])


def _ct_windows(t, *more):
    events = t.table("events").select("user_id", *more, hours().alias("h"))
    cuts = events.select("user_id").distinct().withColumn("cut", F.explode(F.array(*map(F.lit, CUTS))))
    return X.ct_windows(events, cuts, "user_id", "h", "event_id", 100.0, 24.0)


@query(
    "continuous_time_lengths",
    """WITH e AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS h FROM events),
 c AS (SELECT user_id, cut FROM (SELECT DISTINCT user_id FROM e), (SELECT unnest([120.0, 240.0, 360.0, 480.0, 600.0]::DOUBLE[]) AS cut)),
 w AS (SELECT *, 'past' AS part, cut - 100 AS a, cut AS b FROM c UNION ALL SELECT *, 'future', cut, cut + 24 FROM c)
 SELECT w.user_id, cut, part, count(h) AS valid_length FROM w LEFT JOIN e ON e.user_id = w.user_id AND h >= a AND h < b GROUP BY ALL""",
)
def continuous_time_lengths(t):
    """Every window of every user, those without an event too."""
    lengths, _ = _ct_windows(t, "event_id")
    return lengths


@query("sample_uniform")
def sample_uniform(t):
    return X.sample_uniform(base(t), ["id", "d"], 0.1, 3)


@query("sample_expected")
def sample_expected(t):
    return X.sample_expected(base(t), ID, ["id", "d"], 5, 3)


@query("sample_by_bucket")
def sample_by_bucket(t):
    return X.sample_by_bucket(base(t), ID, ["id", "d"], 3)


@query("weighted_replicate")
def weighted_replicate(t):
    df = t.panel.select("id", "d", F.col("cents").cast("double").alias("weight"))
    return X.weighted_replicate(df, ["id", "d"], "weight", 0.5, 5)


@query(
    "capped_replication",
    """WITH w AS (SELECT id, pow(sum(sales), 2) AS x FROM panel GROUP BY id), a AS (SELECT id, least(greatest(x * 5000 / (SELECT sum(x) FROM w), 2), 20) AS x FROM w),
 b AS (SELECT id, CAST(floor(least(greatest(x * 5000 / (SELECT sum(x) FROM a), 2), 20)) AS INT) AS copies FROM a)
 SELECT id, copies, CAST(unnest(range(1, copies + 1)) AS INT) AS copy FROM b""",
    "panel",
)
def capped_replication(t):
    weights = t.panel.groupBy("id").agg(F.sum("sales").alias("weight"))
    return X.replicate(weights, "weight", 5000.0, 2.0, 20.0).drop("weight")


@query("random_day_holdout")
def random_day_holdout(t):
    return X.fold_by_group(base(t), "d", 500, 9)


@query("thin_by_quantile")
def thin_by_quantile(t):
    from tidegrid.operators.ensemble import QUANTILES

    df = base(t).withColumn("q", F.explode(F.array(*[F.lit(q) for q in QUANTILES])))
    return X.thin_by_quantile(df, ["id", "d"], "q", {0.005: 0.5, 0.995: 0.5, 0.5: 0.2}, 4).groupBy("q").agg(F.count("*").alias("n"))


@query(
    "forking_instances",
    f"""WITH r AS (SELECT id, d, sales, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY id) AS n, coalesce(list(sales) OVER {_frame('1 FOLLOWING', '5 FOLLOWING')}, []) AS nx FROM grid WINDOW w AS (PARTITION BY id ORDER BY d)),
 f AS (SELECT id, pos, n, list(sales) OVER {_frame('9 PRECEDING', 'CURRENT ROW')} AS p, list(nx) OVER {_frame('9 PRECEDING', 'CURRENT ROW')} AS k FROM r)
 SELECT id, CAST(pos AS INT) AS pos, {_digest(_left('p', 10), 'past_target')}, {_digest('flatten(' + _left('k', 10, '[0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]', 'DOUBLE[][]') + ')', 'future_target')} FROM f WHERE pos + 5 < n""",
    "grid",
)
def forking_instances(t):
    made = X.make_forking_instances(days(t), ID, 10, 5).withColumn("future_target", F.flatten("future_target"))
    return made.select("id", "pos", digest("past_target"), digest("future_target"))


@query("sample_dimensions")
def sample_dimensions(t):
    return X.sample_dims(t.dept_panel.select("id", "d", "sales"), "id", 30, 2)


@query(
    "lag_blocks",
    f"""WITH r AS (SELECT id, d, row_number() OVER w - 1 AS pos, coalesce(list(sales) OVER {_frame('7 PRECEDING', '1 PRECEDING')}, []) AS a,
  coalesce(list(sales) OVER {_frame('13 PRECEDING', '7 PRECEDING')}, []) AS b, coalesce(list(sales) OVER {_frame('20 PRECEDING', '14 PRECEDING')}, []) AS c FROM grid WINDOW w AS (PARTITION BY id ORDER BY d))
 SELECT id, d, CAST(pos AS INT) AS pos, {_digest('a', 'block_1')}, {_digest('b', 'block_7')}, {_digest('c', 'block_14')} FROM r WHERE len(c) = 7""",
    "grid",
)
def lag_blocks(t):
    made = X.lag_block(days(t), ID, [1, 7, 14], 7)
    return made.select("id", "d", "pos", *[digest(f"block_{lag}") for lag in (1, 7, 14)])


@query(
    "model_inputs",
    f"""WITH b AS (SELECT id, d, sales, 1 AS observed, (isodow(DATE '1995-01-02' + (d - 1)) - 1) / 6.0::DOUBLE - 0.5 AS dw, log10(row_number() OVER (PARTITION BY id ORDER BY d) + 1.0) AS age FROM grid),
 r AS (SELECT id, d AS forecast_start, row_number() OVER w - 1 AS pos, list(sales) OVER {_frame('20 PRECEDING', '1 PRECEDING')} AS ps, list(observed) OVER {_frame('20 PRECEDING', '1 PRECEDING')} AS po,
  list(dw) OVER {_frame('20 PRECEDING', '1 PRECEDING')} AS pd, list(age) OVER {_frame('20 PRECEDING', '1 PRECEDING')} AS pa,
  list(sales) OVER {_frame('CURRENT ROW', '6 FOLLOWING')} AS fs, list(age) OVER {_frame('CURRENT ROW', '6 FOLLOWING')} AS fa FROM b WINDOW w AS (PARTITION BY id ORDER BY d))
 SELECT id, CAST(pos AS INT) AS pos, forecast_start, {_digest('ps', 'past_sales')}, {_digest('po', 'past_observed')}, {_digest('pd', 'past_day_of_week', 1000000)}, {_digest('pa', 'past_age', 1000000)},
  {_digest('fs', 'future_sales')}, {_digest('fa', 'future_age', 1000000)} FROM r WHERE len(ps) = 20 AND len(fs) = 7""",
    "grid",
)
def model_inputs(t):
    made = X.model_inputs(days(t).withColumn("date", day_to_date(F.col("d"))), ID, "date", "day", 20, 7)
    fine = [digest(c, 1000000) for c in ("past_day_of_week", "past_age", "future_age")]
    return made.select("id", "pos", "forecast_start", digest("past_sales"), digest("past_observed"), digest("future_sales"), *fine)
