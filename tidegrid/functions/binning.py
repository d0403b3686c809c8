"""Discretising targets: scaled, global, per-series and given bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.ranking import exact_quantiles


def edges_from_centers(centers: Column) -> Column:
    """Midpoints between neighbouring centres; the outer edges are open."""
    return F.zip_with(
        F.slice(centers, 1, F.size(centers) - 1), F.slice(centers, 2, F.size(centers) - 1), lambda a, b: (a + b) / 2.0
    )


def bin_index(x: Column, edges: Column) -> Column:
    """1-based bin: one more than the number of inner edges at or below x."""
    return F.size(F.filter(edges, lambda e: e <= x)) + 1


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def digitize_scaled(df: DataFrame, keys: list[str], value: str, edges: list[float], out: str = "bin") -> DataFrame:
    """x / mean |x| of its series (1 when that is 0), then the number of edges at or below it."""
    scales = df.groupBy(*keys).agg(F.avg(F.abs(value)).alias("_m")).withColumn(
        "scale", F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)
    ).drop("_m")
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return df.join(scales, keys).withColumn(out, F.size(F.filter(arr, lambda e: e <= F.col(value) / F.col("scale"))))


def relative(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value over the mean of its series."""
    scales = df.groupBy(*keys).agg(F.greatest(F.avg(value), F.lit(1e-20)).alias("scale"))
    return df.join(scales, keys).withColumn("rel", F.col(value) / F.col("scale"))


def global_centers(rel: DataFrame, n: int, quantile: bool, limit: float | None = None) -> Column:
    """Bin centres over all scaled values, as a scalar array of n numbers."""
    if quantile:
        probs = linspace(0.0, 0.99 if limit is None else limit, n)
        stats = exact_quantiles(rel.select("rel"), "rel", probs)
        return stats.select(F.array(*[F.col(f"q{i}") for i in range(n)])).scalar()
    high = 10.0 if limit is None else limit
    low = F.when(F.min("rel") < 0, F.lit(-high)).otherwise(0.0)
    return rel.agg(F.array(*[low + (high - low) * i / (n - 1) for i in range(n)])).scalar()


def bin_global(df: DataFrame, keys: list[str], value: str, n: int, quantile: bool = True, limit: float | None = None) -> DataFrame:
    """Bin of the mean-scaled value among centres shared by all series; ``decoded`` is the centre scaled back."""
    rel = relative(df, keys, value)
    out = rel.withColumn("_c", global_centers(rel, n, quantile, limit)).withColumn("_e", edges_from_centers(F.col("_c")))
    out = out.withColumn("bin", bin_index(F.col("rel"), F.col("_e")))
    return out.withColumn("decoded", F.element_at("_c", F.col("bin")) * F.col("scale")).drop("_c", "_e", "rel")


def bin_local(df: DataFrame, keys: list[str], value: str, n: int, quantile: bool = True) -> DataFrame:
    """Bins from each series' own quantiles or range (a series is bounded by its days)."""
    if quantile:
        centers = F.percentile(value, F.array(*[F.lit(p) for p in linspace(0.0, 1.0, n)]))
    else:
        lo, hi = F.min(value), F.max(value)
        centers = F.array(*[lo + (hi - lo) * i / (n - 1) for i in range(n)])
    fit = df.groupBy(*keys).agg(centers.alias("_c")).withColumn("_e", edges_from_centers(F.col("_c")))
    out = df.join(fit, keys).withColumn("bin", bin_index(F.col(value), F.col("_e")))
    return out.withColumn("decoded", F.element_at("_c", F.col("bin"))).drop("_c", "_e")


def bin_custom(x: Column, centers: list[float]) -> Column:
    mids = [(a + b) / 2 for a, b in zip(centers, centers[1:])]
    return bin_index(x, F.array(*[F.lit(float(m)) for m in mids]))


def hybrid(df: DataFrame, encodings: dict[str, Column]) -> DataFrame:
    """Several encodings of one value side by side."""
    return df.withColumns(encodings)


def chain(x: Column, steps: list) -> Column:
    """Encodings applied in order."""
    for step in steps:
        x = step(x)
    return x


def pit(b: Column, n: int) -> Column:
    return b / F.lit(float(n))


def unpit(u: Column, n: int) -> Column:
    """Number of whole bin starts at or below u * n."""
    return F.least(F.greatest(F.floor(u * n) + 1, F.lit(0)), F.lit(n)).cast("int")
