"""Train/test splits and model-input instances from the long grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.forecast import uniform_draw


def _pos(keys: list[str], day: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(day))


def split_offset(df: DataFrame, keys: list[str], k: int, h: int, day: str = "d") -> DataFrame:
    """First k rows of a series as train; the first k + h as test."""
    rows = df.withColumn("_p", _pos(keys, day)).filter(F.col("_p") <= k + h)
    return rows.select("*", (F.col("_p") <= k).alias("in_train"), F.lit(True).alias("in_test")).drop("_p")


def split_date(df: DataFrame, cut: Column, h: int, day: str = "d") -> DataFrame:
    rows = df.filter(F.col(day) <= cut + h)
    return rows.withColumn("in_train", F.col(day) <= cut).withColumn("in_test", F.lit(True))


def rolling_split(df: DataFrame, cut: Column, h: int, windows: int, distance: int, max_history: int | None = None,
                  keys: list[str] | None = None, day: str = "d") -> DataFrame:
    """One test copy per window, each ending ``distance`` later; optionally only the last rows of each."""
    spread = df.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    rows = spread.filter(F.col(day) <= cut + F.col("window") * distance + h)
    if max_history is None:
        return rows
    newest = Window.partitionBy(*keys, "window").orderBy(F.desc(day))
    return rows.withColumn("_b", F.row_number().over(newest)).filter(F.col("_b") <= max_history).drop("_b")


def tail_history(df: DataFrame, keys: list[str], n: int, day: str = "d") -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc(day))
    return df.withColumn("_b", F.row_number().over(newest)).filter(F.col("_b") <= n).drop("_b")


def _padded(values: Column, length: int, dummy: float) -> Column:
    return F.concat(F.array_repeat(F.lit(dummy), F.lit(length) - F.size(values)), values)


#: Rows of a block of a series, at least; a block's halo is never longer than the block.
BLOCK = 256


def day_blocks(df: DataFrame, keys: list[str], fields: list[str], before: int, after: int, day: str = "d") -> DataFrame:
    """Series in blocks of rows with a halo of ``before`` earlier and ``after`` later ones, so that any frame of these
    sizes is a slice of one block: keys, block, first and last (own positions, from 0), n (rows of the series), start (the
    position of the first row held), and one array a field, ``day`` too.

    A row goes to its own block and to those whose halo holds it, two on average at most; the blocks keep the
    partitioning of the numbering, so a series is shuffled once.
    """
    size = max(BLOCK, before + after)
    whole = Window.partitionBy(*keys)
    held = list(dict.fromkeys([day, *fields]))
    rows = df.select(*keys, *held, (F.row_number().over(whole.orderBy(day)) - 1).alias("_pos"), F.count("*").over(whole).alias("_n"))
    low = F.greatest(F.floor((F.col("_pos") - after) / size), F.lit(0))
    high = F.least(F.floor((F.col("_pos") + before) / size), F.floor((F.col("_n") - 1) / size))
    spread = rows.withColumn("block", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    packed = spread.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_pos", *held))).alias("_r"), F.max("_n").cast("int").alias("n"))
    return packed.select(
        *keys, "block", (F.col("block") * size).alias("first"), (F.least((F.col("block") + 1) * size, F.col("n")) - 1).alias("last"), "n",
        F.col("_r")[0]["_pos"].alias("start"), *[F.expr(f"transform(_r, r -> r.`{c}`)").alias(c) for c in held],
    )


def _instances(blocks: DataFrame, keys: list[str], last: str, columns: dict[str, str], day: str, day_name: str) -> DataFrame:
    """One row a position of each block up to ``last``. ``columns``: name -> SQL in ``p`` (the position) and ``i`` (its
    place, from 0, in the block's arrays)."""
    body = ", ".join(f"'{name}', {sql}" for name, sql in {"pos": "p.p", day_name: f"get({day}, p.i)", **columns}.items())
    places = f"if(least(last, {last}) >= first, transform(sequence(first, least(last, {last})), p -> named_struct('p', p, 'i', p - start)), cast(array() as array<struct<p: int, i: int>>))"
    made = blocks.select(*keys, F.inline(F.expr(f"transform({places}, p -> named_struct({body}))")))
    return made


def _past(field: str, length: int, end: int = 0) -> str:
    """Up to ``length`` values of a field that end ``end`` rows before the position (0: with the one before it)."""
    return f"slice({field}, greatest(p.i - {end + length - 1}, 1), greatest(least({length}, p.i - {end}), 0))"


def _padded_sql(values: str, length: int, dummy: str) -> str:
    return f"concat(array_repeat({dummy}, {length} - size({values})), {values})"


def _pads(values: str, length: int) -> str:
    return f"concat(array_repeat(1, {length} - size({values})), array_repeat(0, size({values})))"


def make_instances(df: DataFrame, keys: list[str], past: int, future: int, lead: int = 0, pick_incomplete: bool = True,
                   chosen: Column | None = None, dummy: float = 0.0, day: str = "d", value: str = "sales") -> DataFrame:
    """Left-padded past window, future window, pad flags and forecast start at every position of every series.

    A cut at position i (0-based) has rows i-past..i-1 as past and i+lead..i+lead+future-1 as
    future. ``chosen`` is a condition on ``pos``, such as a sampler's.
    """
    blocks = day_blocks(df, keys, [value], past, lead + future, day)
    columns = {
        "past_target": _padded_sql(_past(value, past), past, f"{dummy}D"),
        "future_target": f"slice({value}, p.i + {lead + 1}, {future})",
        "past_is_pad": _pads(_past(value, past), past),
        "forecast_start": f"get({day}, p.i + {lead})",
    }
    out = _instances(blocks, keys, f"n - {lead + future}", columns, day, "_day").drop("_day")
    out = out.select(*keys, "pos", "forecast_start", "past_target", "future_target", "past_is_pad")
    out = out if pick_incomplete else out.filter(F.col("pos") >= past)
    return out if chosen is None else out.filter(chosen)


def predict_instances(df: DataFrame, keys: list[str], past: int, lead: int = 0, dummy: float = 0.0, day: str = "d",
                      value: str = "sales") -> DataFrame:
    """The one instance per series at the end of its history."""
    tail = tail_history(df.select(*keys, day, value), keys, past, day)
    packed = tail.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(day), F.col(value)))).alias("_r"), F.max(day).alias("_end")
    )
    values = F.col("_r")[value]
    return packed.select(
        *keys, (F.col("_end") + 1 + lead).alias("forecast_start"), _padded(values, past, dummy).alias("past_target"),
        F.concat(F.array_repeat(F.lit(1), past - F.size("_r")), F.array_repeat(F.lit(0), F.size("_r"))).alias("past_is_pad"),
    )


def make_instances_canonical(df: DataFrame, keys: list[str], length: int, chosen: Column | None = None,
                             pad: bool = False, dummy: float = 0.0, day: str = "d", value: str = "sales") -> DataFrame:
    """One window of ``length`` ending with each row; padded on the left when allowed. ``pos`` is from 1."""
    blocks = day_blocks(df, keys, [value], length, 0, day)
    held = f"slice({value}, greatest(p.i - {length - 2}, 1), least({length}, p.i + 1))"
    columns = {"past_target": _padded_sql(held, length, f"{dummy}D"), "past_is_pad": _pads(held, length)}
    out = _instances(blocks, keys, "n - 1", columns, day, "last_day").withColumn("pos", F.col("pos") + 1)
    out = out if pad else out.filter(F.col("pos") >= length)
    return out if chosen is None else out.filter(chosen)


def previous_in_chunks(df: DataFrame, key: str, order: list[str], chunk: Column, value: str, out: str) -> DataFrame:
    """Previous value of a key that may hold most rows: a lag inside time chunks, and the last value of the chunk before."""
    rows = df.withColumn("_k", chunk)
    inside = F.lag(value).over(Window.partitionBy(key, "_k").orderBy(*order))
    ends = df.withColumn("_k", chunk).groupBy(key, "_k").agg(F.max_by(value, F.struct(*order)).alias("_e"))
    ends = ends.withColumn("_prev", F.lag("_e").over(Window.partitionBy(key).orderBy("_k"))).drop("_e")
    return rows.withColumn("_in", inside).join(ends, [key, "_k"]).withColumn(out, F.coalesce("_in", "_prev")).drop("_k", "_in", "_prev")


#: Events of a time bucket, on average.
BUCKET = 2048


def ct_windows(events: DataFrame, cuts: DataFrame, key: str, time: str, event_id: str, past: float, future: float,
               with_future: bool = True) -> tuple[DataFrame, DataFrame]:
    """Windows of a point process around cut times: the windows, and the events in them.

    ``cuts``: (key, cut), any number a key; a window is [cut - past, cut) or [cut, cut + future). Windows: key, cut, part
    and valid_length, 0 where nothing happened. Events: their columns with cut, part and gap, the time since the event before
    in the window (or the window's start).

    Windows and events meet in time buckets, as wide as it takes for about ``BUCKET`` events of the key: the buckets of a
    key with a third of all events are as large as those of any other. No window is gathered.
    """
    parts = [F.struct(F.lit("past").alias("part"), (F.col("cut") - past).alias("a"), F.col("cut").alias("b"))]
    if with_future:
        parts.append(F.struct(F.lit("future").alias("part"), F.col("cut").alias("a"), (F.col("cut") + future).alias("b")))
    windows = cuts.select(key, F.col("cut").cast("double").alias("cut")).distinct().select(key, "cut", F.explode(F.array(*parts)).alias("_w"))
    windows = windows.select(key, "cut", "_w.part", F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"))
    span = events.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / BUCKET)
    widths = span.select(key, "_lo", "_hi", F.when(width > 0, width).otherwise(1.0).alias("_width"))
    bucket = lambda t: F.floor((t - F.col("_lo")) / F.col("_width"))
    placed = events.join(widths, key).withColumn("_k", bucket(F.col(time)))
    before = previous_in_chunks(placed.drop("_k"), key, [time, event_id], bucket(F.col(time)), time, "_before").withColumn("_k", bucket(F.col(time)))
    reach = windows.join(widths, key).filter((F.col("_b") > F.col("_lo")) & (F.col("_a") <= F.col("_hi")))
    first, last = F.greatest(F.col("_a"), F.col("_lo")), F.least(F.col("_b"), F.col("_hi"))
    reach = reach.withColumn("_k", F.explode(F.sequence(bucket(first), bucket(last)))).drop("_lo", "_hi", "_width")
    inside = before.drop("_lo", "_hi", "_width").join(reach, [key, "_k"]).filter((F.col(time) >= F.col("_a")) & (F.col(time) < F.col("_b")))
    gap = F.col(time) - F.greatest(F.coalesce(F.col("_before"), F.col("_a")), F.col("_a"))
    members = inside.select(*events.columns, "cut", "part", gap.alias("gap"))
    counts = members.groupBy(key, "cut", "part").agg(F.count("*").alias("valid_length"))
    lengths = windows.select(key, "cut", "part").join(counts, [key, "cut", "part"], "left").na.fill(0, ["valid_length"])
    return lengths, members


def make_forking_instances(df: DataFrame, keys: list[str], enc: int, dec: int, chosen: Column | None = None, day: str = "d",
                           value: str = "sales") -> DataFrame:
    """Per row: the left-padded past of length enc and, for each of its steps, the next dec values."""
    blocks = day_blocks(df, keys, [value], enc, dec, day)
    held = f"slice({value}, greatest(p.i - {enc - 2}, 1), least({enc}, p.i + 1))"
    forks = f"transform(sequence(greatest(p.i - {enc - 1}, 0), p.i), j -> slice({value}, j + 2, {dec}))"
    columns = {
        "past_target": _padded_sql(held, enc, "0.0D"),
        "future_target": f"concat(array_repeat(array_repeat(0.0D, {dec}), {enc} - size({held})), {forks})",
    }
    out = _instances(blocks, keys, f"n - {dec + 1}", columns, day, "_day").drop("_day")
    return out if chosen is None else out.filter(chosen)


def lag_block(df: DataFrame, keys: list[str], lags: list[int], length: int, chosen: Column | None = None, day: str = "d", value: str = "sales") -> DataFrame:
    """For each lag, the block of ``length`` values that ends lag rows back; only full blocks."""
    blocks = day_blocks(df, keys, [value], max(lags) + length, 0, day)
    columns = {f"block_{lag}": _past(value, length, lag - 1) for lag in lags}
    out = _instances(blocks, keys, "n - 1", columns, day, day).filter(F.col("pos") >= max(lags) + length - 1)
    out = out.select(*keys, day, "pos", *columns)
    return out if chosen is None else out.filter(chosen)


def model_inputs(df: DataFrame, keys: list[str], date: str, freq: str, past: int, future: int, chosen: Column | None = None,
                 day: str = "d", value: str = "sales") -> DataFrame:
    """Observed flag, time features, age, then instances of target and features at every position with a full past and future."""
    from tidegrid.functions.calendar import FREQ_FEATURES, age_feature, time_features
    from tidegrid.operators.clean import observed_indicator

    out = observed_indicator(df, value)
    out = age_feature(time_features(out, date, freq), keys, day)
    fields = [value, "observed", *FREQ_FEATURES[freq], "age"]
    blocks = day_blocks(out, keys, fields, past, future, day)
    columns = {f"past_{f}": _past(f, past) for f in fields}
    columns |= {f"future_{f}": f"slice({f}, p.i + 1, {future})" for f in fields if f != "observed"}
    rows = _instances(blocks, keys, f"n - {future}", columns, day, "forecast_start").filter(F.col("pos") >= past)
    rows = rows.select(*keys, "pos", "forecast_start", *columns)
    return rows if chosen is None else rows.filter(chosen)


# --- samplers: every choice is a hash of the row's keys, so a retry makes the same one ---

def sample_uniform(df: DataFrame, keys: list[str], p: float | Column, seed: int) -> DataFrame:
    return df.filter(uniform_draw(keys, seed) < p)


def sample_expected(df: DataFrame, series: list[str], keys: list[str], n: float, seed: int) -> DataFrame:
    """About n rows per series: probability n over the mean series length."""
    mean = df.groupBy(*series).agg(F.count("*").alias("_n")).agg(F.avg("_n")).scalar()
    return sample_uniform(df, keys, F.lit(float(n)) / mean, seed)


def sample_by_bucket(df: DataFrame, series: list[str], keys: list[str], seed: int, value: str = "sales") -> DataFrame:
    """Probability 1 over the number of series of the same scale bucket."""
    from tidegrid.operators.encode import scale_bucket

    per = df.groupBy(*series).agg(F.avg(F.abs(value)).alias("_m")).withColumn("_b", scale_bucket(F.col("_m")))
    sizes = per.groupBy("_b").agg(F.count("*").alias("_size"))
    tagged = df.join(per.join(sizes, "_b").select(*series, "_size"), series)
    return sample_uniform(tagged, keys, F.lit(1.0) / F.col("_size"), seed).drop("_size")


def weighted_replicate(df: DataFrame, keys: list[str], weight: str, frac: float, seed: int) -> DataFrame:
    """Rows kept or repeated in proportion to weight: the whole part always, the rest by chance."""
    mean = df.agg(F.avg(weight)).scalar()
    share = F.col(weight) / mean * frac
    copies = F.floor(share) + (uniform_draw(keys, seed) < share - F.floor(share)).cast("int")
    out = df.withColumn("_n", copies.cast("int")).filter("_n > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def replicate(df: DataFrame, weight: str, capacity: float, lo: float, hi: float, power: float = 2.0) -> DataFrame:
    """Copies in proportion to weight^power, scaled to the capacity and clipped, twice."""
    out = df.withColumn("_x", F.pow(F.col(weight), F.lit(power)))
    for _ in range(2):
        total = out.agg(F.sum("_x")).scalar()
        out = out.withColumn("_x", F.least(F.greatest(F.col("_x") * capacity / total, F.lit(lo)), F.lit(hi)))
    out = out.withColumn("copies", F.floor("_x").cast("int")).drop("_x")
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def fold_by_group(df: DataFrame, day: str, n_days: int, seed: int) -> DataFrame:
    """Mark n random days as held out: the days with the smallest hashes."""
    days = df.select(day).distinct().withColumn("_u", uniform_draw([day], seed))
    chosen = days.orderBy("_u", day).limit(n_days).select(day, F.lit(True).alias("_h"))
    return df.join(chosen, day, "left").withColumn("held_out", F.coalesce("_h", F.lit(False))).drop("_h")


def thin_by_quantile(df: DataFrame, keys: list[str], q: str, keep: dict[float, float], seed: int) -> DataFrame:
    """Keep probability by quantile (1 where not listed)."""
    p = F.lit(1.0)
    for quantile, prob in keep.items():
        p = F.when(F.col(q) == quantile, F.lit(prob)).otherwise(p)
    return df.filter(uniform_draw([*keys, q], seed) < p)


def sample_dims(df: DataFrame, dim: str, n: int, seed: int) -> DataFrame:
    """n random dimensions of every entry: the ones with the smallest hashes."""
    dims = df.select(dim).distinct().withColumn("_u", uniform_draw([dim], seed))
    return df.join(dims.orderBy("_u", dim).limit(n).select(dim), dim, "left_semi")
