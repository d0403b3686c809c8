"""Per-series features. A partition is one series, whose rows are bounded by the days.

All features of one call share a partition and order, so Spark plans one shuffle and one
sort for them. Long means and deviations come from running sums: the cost of a row does
not grow with the width.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _order(keys: list[str], day: str):
    return Window.partitionBy(*keys).orderBy(day)


def add_lags(df: DataFrame, keys: list[str], lags: list[int], day: str = "d", value: str = "sales", name: str = "lag") -> DataFrame:
    w = _order(keys, day)
    return df.withColumns({f"{name}_{n}": F.lag(value, n).over(w) for n in lags})


def rolling(df: DataFrame, keys: list[str], specs: list[tuple[int, int]], day: str = "d", value: str = "sales",
            std: bool = True, name: str = "roll", whole: bool = False) -> DataFrame:
    """Mean (and sample std) of ``width`` rows ending ``shift`` rows back, null unless all are observed.

    ``whole``: the values are whole numbers, so running count, sum and sum of squares are exact and can be
    differenced: the cost of a row does not grow with the width. Else each frame is aggregated by itself, as
    differences of running sums would lose the digits of small values after large ones.
    """
    if not whole:
        x, cols = F.col(value).cast("double"), {}
        for s, n in specs:
            win = frame(keys, n, s, day)
            cols[f"{name}_mean_{s}_{n}"] = F.when(F.count(x).over(win) == n, F.avg(x).over(win))
            if std and n > 1:
                cols[f"{name}_std_{s}_{n}"] = F.when(F.count(x).over(win) == n, F.stddev_samp(x).over(win))
        return df.withColumns(cols)
    w = _order(keys, day)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    sums = {"_n": F.count(x).over(run), "_s": F.coalesce(F.sum(x).over(run), F.lit(0.0))}
    if std:
        sums["_q"] = F.coalesce(F.sum(x * x).over(run), F.lit(0.0))
    ends = sorted({b for s, n in specs for b in (s, s + n)})
    marks = {f"{c}{e}": (F.lag(c, e).over(w) if e else F.col(c)) for e in ends for c in sums}
    out = df.withColumns(sums).withColumns(marks)

    def between(c: str, s: int, n: int, zero) -> Column:
        return F.col(f"{c}{s}") - F.coalesce(F.col(f"{c}{s + n}"), F.lit(zero))

    cols = {}
    for s, n in specs:
        count, total = between("_n", s, n, 0), between("_s", s, n, 0.0)
        cols[f"{name}_mean_{s}_{n}"] = F.when(count == n, total / n)
        if std and n > 1:
            var = F.greatest(F.lit(0.0), (between("_q", s, n, 0.0) - total * total / n) / (n - 1))
            cols[f"{name}_std_{s}_{n}"] = F.when(count == n, F.sqrt(var))
    return out.withColumns(cols).drop(*sums, *marks)


def frame(keys: list[str], width: int, shift: int = 0, day: str = "d"):
    return _order(keys, day).rowsBetween(-(shift + width - 1), -shift)


def full(agg: Column, value: str, win, need: int) -> Column:
    """The aggregate where at least ``need`` rows of the frame are observed."""
    return F.when(F.count(value).over(win) >= need, agg.over(win))


def rolling_frames(df: DataFrame, keys: list[str], width: int, aggs: dict[str, Column], day: str = "d",
                   value: str = "sales", shift: int = 0, need: int | None = None) -> DataFrame:
    win = frame(keys, width, shift, day)
    return df.withColumns({n: full(a, value, win, need or width) for n, a in aggs.items()})


def rolling_quantiles(df: DataFrame, keys: list[str], widths: list[int], probs: list[float], day: str = "d",
                      value: str = "sales", need: int | None = None, name: str = "q") -> DataFrame:
    """Linear-interpolated quantiles of the last ``width`` rows, as columns {name}{100 p}_{width}: null unless ``need`` (all, if
    not given) of them are observed.

    A series' rows pass in order through one sorted window per width: the value that leaves is taken out and the new one put in
    by binary search, and every quantile is read from its place. A task holds the widest window of one series. The
    table's rows are spread by series and sorted once, whatever the number of widths.
    """
    names = [(w, p, f"{name}{round(100 * p)}_{w}") for w in widths for p in probs]
    added = T.StructType([T.StructField(n, T.DoubleType()) for _, _, n in names])
    hashed = F.xxhash64(*keys)
    spread = df.withColumns({"_key": hashed, "_x": F.col(value).cast("double")})
    spread = spread.repartition(*keys).sortWithinPartitions("_key", *keys, day)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in keys))
            out: dict[str, list] = {n: [] for _, _, n in names}
            for key, x in zip(ids, batch.column("_x").to_pylist()):
                if key != now:
                    now, windows = key, [SortedWindow(w) for w in widths]
                for window in windows:
                    window.push(x)
                    enough = window.seen() >= (need or window.width)
                    for p in probs:
                        out[f"{name}{round(100 * p)}_{window.width}"].append(window.quantile(p) if enough else None)
            given = batch.drop_columns(["_key", "_x"])
            yield pa.RecordBatch.from_arrays([*given.columns, *(pa.array(v, pa.float64()) for v in out.values())], names=[*given.schema.names, *out])

    return spread.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


class SortedWindow:
    """The last ``width`` values in order of size; nulls only take up their place in time."""

    def __init__(self, width: int):
        self.width, self.queue, self.ranked = width, deque(), []

    def push(self, x: float | None) -> None:
        self.queue.append(x)
        if len(self.queue) > self.width and (old := self.queue.popleft()) is not None:
            del self.ranked[bisect_left(self.ranked, old)]
        if x is not None:
            insort(self.ranked, x)

    def seen(self) -> int:
        return len(self.ranked)

    def quantile(self, p: float) -> float | None:
        if not self.ranked:
            return None
        at = p * (len(self.ranked) - 1)
        low = int(at)
        if low == at:
            return self.ranked[low]
        return self.ranked[low] + (self.ranked[low + 1] - self.ranked[low]) * (at - low)


def rolling_shape(df: DataFrame, keys: list[str], width: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Bias-corrected skewness and excess kurtosis; null when the frame has no spread."""
    win = frame(keys, width, 0, day)
    n = F.lit(float(width))
    enough = (F.count(value).over(win) == width) & (F.max(value).over(win) > F.min(value).over(win))
    skew = F.skewness(value).over(win) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value).over(win) + 6)
    return df.withColumns(
        {
            f"skew_{width}": F.when(enough, skew) if width >= 3 else F.lit(None).cast("double"),
            f"kurt_{width}": F.when(enough, kurt) if width >= 4 else F.lit(None).cast("double"),
        }
    )


def std_over_mean(df: DataFrame, keys: list[str], width: int, day: str = "d", value: str = "sales", whole: bool = False) -> DataFrame:
    out = rolling(df, keys, [(0, width)], day, value, name="_r", whole=whole)
    ratio = F.try_divide(F.col(f"_r_std_0_{width}"), F.col(f"_r_mean_0_{width}"))
    return out.withColumn(f"cv_{width}", ratio).drop(f"_r_std_0_{width}", f"_r_mean_0_{width}")


def pct_nonzero(df: DataFrame, keys: list[str], widths: list[int], day: str = "d", value: str = "sales") -> DataFrame:
    """Share of non-zero days; a null counts as zero."""
    flagged = df.withColumn("_nz", (F.coalesce(F.col(value), F.lit(0.0)) != 0).cast("double"))
    out = rolling(flagged, keys, [(0, w) for w in widths], day, "_nz", std=False, name="_r", whole=True)
    return out.withColumnsRenamed({f"_r_mean_0_{w}": f"pct_nonzero_{w}" for w in widths}).drop("_nz")


def age_counts(df: DataFrame, keys: list[str], caps: list[int], day: str = "d", value: str = "sales") -> DataFrame:
    """Observed days and non-zero days so far, and the latter capped."""
    run = _order(keys, day).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("days_since_first", F.count(value).over(run)).withColumn(
        "nonzero_days", F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(run)
    )
    return out.withColumns({f"nonzero_days_{c}": F.least(F.col("nonzero_days"), F.lit(c)) for c in caps})


def trailing_vol(df: DataFrame, keys: list[str], day: str = "d", value: str = "sales") -> DataFrame:
    """Mean absolute one-row change to date."""
    w = _order(keys, day)
    out = df.withColumn("_j", F.abs(F.col(value) - F.lag(value).over(w)))
    return out.withColumn("trailing_vol", F.avg("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def price_cumrel(df: DataFrame, keys: list[str], order: str, price: str = "sell_price") -> DataFrame:
    """(p - running min) / (1 + running max - running min)."""
    run = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.min(price).over(run), F.max(price).over(run)
    return df.withColumn("price_cumrel", (F.col(price) - lo) / (1 + hi - lo))


def price_change(df: DataFrame, keys: list[str], order: str, price: str = "sell_price", width: int = 7) -> DataFrame:
    """Relative change from the previous known price, and rolling std."""
    w = _order(keys, order)
    known = F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_k", known)
    return out.withColumns(
        {
            "price_rel_diff": F.try_divide(F.col("_k"), F.lag("_k").over(w)) - 1,
            f"price_sd_{width}": full(F.stddev_samp(price), price, w.rowsBetween(-(width - 1), 0), width),
        }
    ).drop("_k")


def rm_diff_price(df: DataFrame, keys: list[str], order: str, widths: list[int], price: str = "sell_price") -> DataFrame:
    """(p - rolling mean) / p, to three decimals with ties to even."""
    w = _order(keys, order)
    cols = {}
    for n in widths:
        mean = full(F.avg(price), price, w.rowsBetween(-(n - 1), 0), n)
        cols[f"rm_diff_price_{n}"] = F.bround(F.try_divide(F.col(price) - mean, F.col(price)), 3)
    return df.withColumns(cols)


def nth_in_window(df: DataFrame, keys: list[str], flag: str, width: int, out: str, day: str = "d") -> DataFrame:
    """Count of flagged days in the window, on flagged days."""
    return df.withColumn(out, F.sum(flag).over(frame(keys, width, 0, day)) * F.col(flag))


def ma_crosses(df: DataFrame, columns: list[str]) -> DataFrame:
    """Difference and ratio of every pair of moving averages."""
    cols = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            cols[f"{a}_minus_{b}"] = F.col(a) - F.col(b)
            cols[f"{a}_over_{b}"] = F.try_divide(F.col(a), F.col(b))
    return df.withColumns(cols)


def rolling_ratio(df: DataFrame, keys: list[str], short: int, long: int, day: str = "d", value: str = "sales") -> DataFrame:
    """Short rolling mean over the long one, minus 1; null unless the long frame is full. The sums are divided once, so
    whole numbers give the same ratio in any order of summing."""
    near, far = frame(keys, short, 0, day), frame(keys, long, 0, day)
    ratio = F.try_divide((F.sum(value).over(near) * long).cast("double"), (F.sum(value).over(far) * short).cast("double")) - 1
    enough = (F.count(value).over(far) == long) & (F.count(value).over(near) == short)
    return df.withColumn(f"ratio_{short}_{long}", F.when(enough, ratio))


def min_periods(span: float) -> int:
    return math.ceil(span ** 0.8)


def ewm_mean(df: DataFrame, keys: list[str], spans: dict[str, float], day: str = "d", value: str = "sales",
             need: dict[str, int] | None = None) -> DataFrame:
    """Exponentially weighted means with normalised weights; nulls are skipped but still age the weights.

    ``spans``: output column -> span. See _decayed for the method.
    """
    out = df.withColumn("_i", F.row_number().over(_order(keys, day)) - 1)
    run = _order(keys, "_i").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_seen", F.count(value).over(run))
    observed = F.col(value).isNotNull()
    for name, span in spans.items():
        rate = 1 - 2.0 / (span + 1)
        out = _decayed(out, keys, rate, {"_num": F.coalesce(F.col(value), F.lit(0.0)), "_den": observed.cast("double")})
        enough = F.col("_seen") >= (need or {}).get(name, min_periods(span))
        out = out.withColumn(name, F.when(enough, F.try_divide(F.col("_num"), F.col("_den")))).drop("_num", "_den")
    return out.drop("_i", "_seen")


def ewm_recursive(df: DataFrame, keys: list[str], spans: dict[str, float], day: str = "d", value: str = "sales") -> DataFrame:
    """y_0 = x_0, y_t = (1-a) y_{t-1} + a x_t, for a value without nulls."""
    out = df.withColumn("_i", F.row_number().over(_order(keys, day)) - 1)
    for name, span in spans.items():
        a = 2.0 / (span + 1)
        weighted = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(a)) * F.col(value)
        out = _decayed(out, keys, 1 - a, {name: weighted})
    return out.drop("_i")


def _decayed(df: DataFrame, keys: list[str], rate: float, terms: dict[str, Column]) -> DataFrame:
    """sum over i <= t of term_i * rate^(t-i), for row index ``_i``.

    Within a block of rows it is a running sum of term * rate^-j, scaled back by rate^j.
    Blocks are short enough for rate^-j to stay finite and long enough that what came
    before the previous block has no weight left in double precision.
    """
    if rate <= 0:
        return df.withColumns(terms)
    size = max(1, int(300 / -math.log(rate)))
    j = (F.col("_i") % size).cast("double")
    blocked = df.withColumn("_b", F.floor(F.col("_i") / size))
    within = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.pow(F.lit(rate), -j), F.pow(F.lit(rate), j)
    local = blocked.withColumns({n: F.sum(t * up).over(within) * down for n, t in terms.items()})
    before = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        f"{n}__end": F.last(F.when(F.col("_i") % size == size - 1, F.col(n)), ignorenulls=True).over(before)
        for n in terms
    }
    carried = local.withColumns(carry)
    age = F.pow(F.lit(rate), j + 1)
    return carried.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"{n}__end"), F.lit(0.0)) * age for n in terms}
    ).drop("_b", *carry)


def lag_pca(df: DataFrame, key: str, n_days: int, k: int = 3, day: str = "d", value: str = "sales"):
    """First k principal components of the n lags of a key's max-scaled daily sums (sign is arbitrary)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    sums = df.groupBy(key, day).agg(F.sum(value).alias("_x"))
    top = sums.agg(F.max("_x")).scalar()
    scaled = sums.withColumn("_x", F.col("_x") / top)
    names = [f"l{n}" for n in range(1, n_days + 1)]
    w = _order([key], day)
    lags = scaled.withColumns({f"l{n}": F.coalesce(F.lag("_x", n).over(w), F.lit(0.0)) for n in range(1, n_days + 1)})
    means = lags.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    centred = lags.withColumn("_m", means).select(key, day, *[(F.col(c) - F.col("_m")[c]).alias(c) for c in names])
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(centred)
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(vec)
    arr = vector_to_array("pc")
    return model.transform(vec).select(key, day, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])
