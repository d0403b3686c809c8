"""Wide/long reshaping, horizon extension, densifying, resampling, id handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot_days(df: DataFrame, id_cols: list[str], value: str = "sales") -> DataFrame:
    """Columns d_1..d_n to one row per (series, d).

    The day columns become one array of (day, value) that is exploded: with thousands of days this is one expression, where
    an unpivot would plan a projection of all columns for each of them.
    """
    days = sorted((c for c in df.columns if c.startswith("d_") and c[2:].isdigit()), key=lambda c: int(c[2:]))
    pairs = F.array(*[F.struct(F.lit(int(c[2:])).alias("d"), F.col(c).alias("v")) for c in days])
    return df.select(*id_cols, F.explode(pairs).alias("_p")).select(*id_cols, F.col("_p.d").alias("d"), F.col("_p.v").alias(value))


def pivot_days(df: DataFrame, id_cols: list[str], days: int, day: str = "d", value: str = "sales") -> DataFrame:
    """One row per series with d_1..d_n; a day without a row is null. A series' rows become one map, so a day's column is a
    look-up and not an aggregate of its own."""
    packed = df.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct(day, value))).alias("_m"))
    return packed.select(*id_cols, *[F.element_at("_m", F.lit(i)).alias(f"d_{i}") for i in range(1, days + 1)])


def pivot_horizon(df: DataFrame, id_cols: list[str], step: str, value: str, horizon: int) -> DataFrame:
    """(series, step, value) to one row per series with F1..Fh. Fixed value list: no extra pass."""
    wide = df.groupBy(*id_cols).pivot(step, list(range(1, horizon + 1))).agg(F.first(value))
    return wide.select(*id_cols, *[F.col(f"`{s}`").alias(f"F{s}") for s in range(1, horizon + 1)])


def unpivot_horizon(df: DataFrame, id_cols: list[str], horizon: int, value: str = "value") -> DataFrame:
    return df.unpivot(id_cols, [f"F{s}" for s in range(1, horizon + 1)], "step_name", value).select(
        *id_cols, F.substring("step_name", 2, 4).cast("int").alias("step"), value
    )


def unpivot_quantiles(df: DataFrame, id_cols: list[str], columns: dict[str, float], suffix: str) -> DataFrame:
    """One row per (series, step, q); name = series + quantile with three decimals + suffix."""
    long = df.unpivot([*id_cols], list(columns), "q_name", "value")
    pairs = [x for name, q in columns.items() for x in (F.lit(name), F.lit(float(q)))]
    q = F.create_map(*pairs)[F.col("q_name")]
    return long.select(
        *id_cols,
        q.alias("q"),
        F.concat_ws("_", F.col(id_cols[0]), F.format_string("%.3f", q), F.lit(suffix)).alias("name"),
        "value",
    )


def extend_horizon(df: DataFrame, keys: list[str], horizon: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Append h future rows per series with a null target."""
    last = df.agg(F.max(day)).scalar()
    future = (
        df.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.sequence(last + 1, last + horizon)).alias(day))
        .withColumn(value, F.lit(None).cast("double"))
    )
    return df.select(*keys, day, value).unionByName(future)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash by key into the configured number of partitions.

    Used before rows multiply: adaptive coalescing sizes partitions by what is shuffled,
    which says nothing about the rows made after it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def fill_gaps(
    df: DataFrame, keys: list[str], day: str, fills: dict, end: Column, start: Column | None = None
) -> DataFrame:
    """Gap-free days from each series' first row to ``end``.

    Each observed row is stretched up to the day before the next one, so the whole
    job is one shuffle by series: no calendar join. ``start`` leaves out days before it
    (for readers that look back a known number of days).
    """
    if start is not None:
        # of the rows before the start only the last one per series matters
        older = df.filter(F.col(day) < start).groupBy(*keys).agg(F.max(day).alias(day))
        df = df.filter(F.col(day) >= start).select(*keys, day, *fills).unionByName(older, allowMissingColumns=True)
    nxt = F.lead(day).over(Window.partitionBy(keys[0]).orderBy(day))
    stretched = spread_by(df, keys[0]).withColumn("_from", F.col(day)).withColumn("_to", F.coalesce(nxt - 1, end))
    if start is not None:
        stretched = stretched.withColumn("_lo", F.greatest(F.col("_from"), start)).filter("_to >= _lo")
    else:
        stretched = stretched.withColumn("_lo", F.col("_from"))
    rows = stretched.select(*keys, "_from", *fills, F.explode(F.sequence("_lo", "_to")).alias(day))
    real = F.col(day) == F.col("_from")
    filled = [F.when(real, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in fills.items()]
    return rows.select(*keys, day, *filled)


def densify(df: DataFrame, keys: list[str], day: str, value: str, rule: str | float = 0.0) -> DataFrame:
    """All series on the same full day range. rule: a constant, or 'mean' of the series."""
    span = df.agg(F.struct(F.min(day).alias("a"), F.max(day).alias("b"))).scalar()
    axis = (
        df.groupBy(*keys)
        .agg(F.avg(value).alias("_mean"))
        .withColumn("_s", span)
        .select(*keys, "_mean", F.explode(F.sequence(F.col("_s.a"), F.col("_s.b"))).alias(day))
    )
    fill = F.col("_mean") if rule == "mean" else F.lit(float(rule))
    return (
        axis.join(df.select(*keys, day, value), [*keys, day], "left")
        .select(*keys, day, F.coalesce(F.col(value), fill).alias(value))
    )


def group_multivariate(
    df: DataFrame, key: str, day: str, value: str, max_dim: int | None = None, fill: float = 0.0
) -> DataFrame:
    """Aligned series, one row per dimension: dim number, start day, target array.

    Dimensions are numbered by key; with max_dim only the last ones stay. Arrays are
    bounded by the number of days.
    """
    from tidegrid.operators.ranking import global_position

    dims = global_position(df.select(key).distinct(), [key], name="dim").withColumn("dim", F.col("dim") - 1)
    if max_dim is not None:
        dims = dims.withColumn("_n", dims.agg(F.count("*")).scalar())
        dims = dims.filter(F.col("dim") >= F.col("_n") - max_dim).drop("_n")
        dims = dims.withColumn("dim", F.col("dim") - dims.agg(F.min("dim")).scalar())
    dense = densify(df, [key], day, value, fill)
    arrays = collect_series(dense, [key], day, {"target": value})
    return arrays.join(dims, key)


def group_test_dates(df: DataFrame, key: str, day: str, value: str, order: str, n_dates: int, fill: float = 0.0,
                     max_dim: int | None = None) -> DataFrame:
    """Entries (key, order) in ``order`` split into n equal blocks of dimensions: block, dim, key, day, value.

    Every entry is padded on the left to the first day of the whole set, and days that it lacks are filled too. The job fails
    if the entries do not make n equal blocks, or if those of a block end on different days. With max_dim only a
    block's last dimensions stay.
    """
    from tidegrid.operators.ranking import global_position

    entries = df.groupBy(key, order).agg(F.min(day).alias("_f"), F.max(day).alias("_z"))
    first = df.agg(F.min(day)).scalar()
    numbered = global_position(entries, [order, key], name="_pos")
    total = numbered.agg(F.count("*")).scalar()
    whole = F.when(total % n_dates == 0, total).otherwise(F.raise_error(F.concat(total.cast("string"), F.lit(f" entries do not make {n_dates} equal blocks"))).cast("long"))
    placed = numbered.withColumn("_size", F.floor(whole / n_dates)).withColumn("block", F.floor((F.col("_pos") - 1) / F.col("_size")).cast("int"))
    placed = placed.withColumn("dim", (F.col("_pos") - 1) % F.col("_size"))
    ends = placed.groupBy("block").agg(F.min("_z").alias("_a"), F.max("_z").alias("_b"))
    ends = ends.withColumn("_end", F.when(F.col("_a") == F.col("_b"), F.col("_b")).otherwise(F.raise_error(F.lit("entries of a block end on different days")).cast("int")))
    placed = placed.join(ends.select("block", "_end"), "block")
    if max_dim is not None:
        placed = placed.withColumn("dim", F.col("dim") - F.greatest(F.col("_size") - max_dim, F.lit(0))).filter("dim >= 0")
    rows = df.select(key, order, day, value).join(placed.select(key, order, "block", "dim", "_f", "_end"), [key, order])
    # a row reaches to the day before the next one, the first one back to the first day of the set
    following = F.lead(day).over(Window.partitionBy(key, order).orderBy(day))
    low = F.when(F.col(day) == F.col("_f"), first).otherwise(F.col(day))
    spread = rows.withColumns({"_lo": low, "_hi": F.coalesce(following - 1, F.col("_end")), "_at": F.col(day)})
    days = spread.select("block", "dim", key, "_at", F.col(value).alias("_v"), F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.select("block", "dim", key, day, F.when(F.col(day) == F.col("_at"), F.col("_v")).otherwise(F.lit(float(fill))).alias(value))


def collect_series(df: DataFrame, keys: list[str], day: str, fields: dict[str, str]) -> DataFrame:
    """Rows to one array entry per series. Length is bounded by the number of days."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(day).alias("t"), *[F.col(c).alias(n) for n, c in fields.items()])))
    return (
        df.groupBy(*keys)
        .agg(packed.alias("_rows"))
        .select(
            *keys,
            F.col("_rows")[0]["t"].alias("start"),
            *[F.col("_rows")[n].alias(n) for n in fields],
        )
    )


def explode_entries(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Array entries to rows; the day is start + position."""
    zipped = df.select(*keys, "start", F.posexplode(F.arrays_zip(*fields)).alias("pos", "v"))
    return zipped.select(*keys, (F.col("start") + F.col("pos")).alias("d"), *[F.col("v")[f].alias(f) for f in fields])


def resample(df: DataFrame, keys: list[str], ts: str, value: str, freq: str) -> DataFrame:
    """Sum by coarser bucket, trimmed to each series' first and last bucket that has a value."""
    buckets = df.groupBy(*keys, F.date_trunc(freq, ts).alias("bucket")).agg(
        F.sum(value).alias(value), F.count(value).alias("n")
    )
    bounds = (
        buckets.filter("n > 0").groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    )
    return (
        buckets.join(bounds, keys)
        .filter("bucket between _lo and _hi")
        .select(*keys, "bucket", value, "n")
    )


def drop_first_days(df: DataFrame, n: int, day: str = "d") -> DataFrame:
    return df.filter(F.col(day) > n)


def parse_id(df: DataFrame, name: str = "series_name") -> DataFrame:
    """cat_dept_item_state_store_split -> columns; the department keeps its category prefix."""
    parts = F.split(F.col(name), "_")
    return df.withColumns(
        {
            "cat": parts[0],
            "dept": F.concat_ws("_", parts[0], parts[1]),
            "item": F.concat_ws("_", parts[0], parts[1], parts[2]),
            "state": F.element_at(parts, -3),
            "store": F.concat_ws("_", F.element_at(parts, -3), F.element_at(parts, -2)),
            "split": F.element_at(parts, -1),
        }
    )


def quantile_id(first: Column, q: Column, suffix: str, second: Column | None = None) -> Column:
    """level1_level2_q_suffix, or level1_X_q_suffix for one-key levels."""
    return F.concat_ws(
        "_", first, second if second is not None else F.lit("X"), F.format_string("%.3f", q), F.lit(suffix)
    )


def relabel_split(df: DataFrame, name: str, old: str, new: str, both: bool = True) -> DataFrame:
    """Rewrite the id suffix; with ``both`` keep the old rows too."""
    renamed = df.withColumn(name, F.regexp_replace(name, f"{old}$", new))
    return df.unionByName(renamed) if both else renamed
