"""Array entries: validation and conversion from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.encode import encode_ordinal
from tidegrid.operators.reshape import collect_series

# Unit each frequency's start must be aligned to.
ALIGN = {"day": "day", "week": "week", "month": "month", "hour": "hour", "minute": "minute"}


def align_start(start: Column, freq: str) -> Column:
    return F.date_trunc(ALIGN[freq], start)


def _rank(kind: T.DataType) -> int:
    return 1 + _rank(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def validate_entries(df: DataFrame, freq: str, required: list[str], ranks: dict[str, int], strict: bool = False) -> DataFrame:
    """Entries with ``problem`` null, or the first rule they break; strict fails the job instead.

    Array rank is a property of the schema and is checked on it; presence and the aligned
    start are checked per row.
    """
    for name, rank in ranks.items():
        if name not in df.columns:
            raise ValueError(f"missing field {name}")
        if _rank(df.schema[name].dataType) != rank:
            raise ValueError(f"field {name} must have rank {rank}")
    rules = [(F.col(c).isNull(), f"missing {c}") for c in required]
    rules += [(F.size(c) == 0, f"empty {c}") for c in ranks]
    rules += [(F.col("start") != align_start(F.col("start"), freq), f"start is not aligned to {freq}")]
    problem = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        problem = F.when(broken, F.lit(text)).otherwise(problem)
    if strict:
        return df.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True)))
    return df.withColumn("problem", problem)


#: An offset or Z at the end of a time.
_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def utc_start(df: DataFrame, rule: str, column: str = "start") -> DataFrame:
    """Start times (text, with or without an offset) as times without a zone. Rules: ``ignore`` the offset, convert to ``utc``,
    or ``error``, which fails the job where a time has one."""
    if rule not in ("ignore", "utc", "error"):
        raise ValueError(f"unknown rule {rule}")
    text = F.col(column)
    local = F.to_timestamp_ntz(F.regexp_replace(text, _ZONED, ""))
    zoned = text.rlike(_ZONED)
    if rule == "error":
        said = F.concat(F.lit("times with a zone are not accepted: "), text)
        return df.withColumn(column, F.when(zoned, F.raise_error(said).cast("timestamp_ntz")).otherwise(local))
    if rule == "ignore":
        return df.withColumn(column, local)
    offset = F.regexp_extract(text, _ZONED, 1)
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))
    shift = F.make_interval(mins=-F.when(F.length(digits) == 4, minutes).otherwise(0))
    return df.withColumn(column, F.when(zoned, local + shift).otherwise(local))


def to_entries(sales: DataFrame, calendar: DataFrame, key: str, static: list[str], dynamic: list[str]) -> DataFrame:
    """Long sales + calendar to entries: target, dynamic features over the same days, static codes and cardinalities."""
    rows = sales.join(calendar.select("d", *dynamic), "d")
    entries = collect_series(rows, [key], "d", {"target": "sales", **{c: c for c in dynamic}})
    entries = entries.withColumn("feat_dynamic_real", F.array(*[F.transform(c, lambda x: x.cast("double")) for c in dynamic])).drop(*dynamic)
    codes = sales.select(key, *static).distinct()
    for c in static:
        codes = encode_ordinal(codes, c, f"{c}__code")
    codes = codes.select(key, F.array(*[F.col(f"{c}__code") for c in static]).alias("feat_static_cat"))
    sizes = codes.agg(F.array(*[F.max(F.col("feat_static_cat")[i]) + 1 for i in range(len(static))])).scalar()
    return entries.join(codes, key).withColumn("cardinalities", sizes)


def ragged_to_entries(df: DataFrame, key: str, train: str, test: str, cap: int) -> DataFrame:
    """Ragged arrays: trailing missing values dropped, test appended, only the last ``cap`` kept."""

    def trimmed(name: str) -> Column:
        last = F.array_max(F.transform(F.col(name), lambda x, i: F.when(x.isNotNull(), i + 1)))
        return F.slice(F.col(name), 1, F.coalesce(last, F.lit(0)))

    joined = F.concat(trimmed(train), trimmed(test))
    out = df.select(key, joined.alias("target"), F.size(trimmed(train)).alias("train_length"))
    start = F.greatest(F.size("target") - cap + 1, F.lit(1))
    return out.withColumn("target", F.slice("target", start, F.lit(cap)))
