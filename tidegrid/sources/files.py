"""Readers and writers: CSV, JSON Lines, Parquet stage tables, keyed files."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import shared_dir

PRICES_SCHEMA = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("sell_price", T.DoubleType()),
])

CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("wday", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("d", T.StringType()),
    T.StructField("event_name_1", T.StringType()),
    T.StructField("event_type_1", T.StringType()),
    T.StructField("event_name_2", T.StringType()),
    T.StructField("event_type_2", T.StringType()),
])

ENTRY_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("target", T.ArrayType(T.DoubleType())),
    T.StructField("feat_static_cat", T.ArrayType(T.IntegerType())),
    T.StructField("feat_static_real", T.ArrayType(T.DoubleType())),
    T.StructField("feat_dynamic_cat", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("feat_dynamic_real", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def sales_schema(days: int) -> T.StructType:
    """Wide sales: ids and d_1..d_n."""
    ids = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in ids] + [T.StructField(f"d_{i}", T.IntegerType()) for i in range(1, days + 1)]
    )


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place.getParent())
    store.deleteOnExit(place)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None,
               fmt: str | None = None) -> DataFrame:
    """CSV (with header) or Parquet; a schema avoids the inference pass; only named columns are read."""
    kind = fmt or ("csv" if path.split("?")[0].rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def last_days(df: DataFrame, id_cols: list[str], k: int) -> DataFrame:
    """Ids and only the last k day columns of a wide table (column pruning reaches the scan)."""
    days = sorted((c for c in df.columns if c.startswith("d_")), key=lambda c: int(c[2:]))
    return df.select(*id_cols, *days[-k:])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file and the line's number in it, from 0: (line, source_file, source_line).

    Files stay splittable. A block's lines are counted where they are read, blocks before it add up to its first line's
    number, and a line's place in its block follows from the order in which its task reads it. Names starting with '.'
    or '_' are skipped by the reader.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"),
    )
    blocks = lines.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(starts, ["source_file", "_block"]).select(
        "line", "source_file", (F.col("_before") + F.col("_m") - F.col("_first")).alias("source_line")
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ENTRY_SCHEMA) -> DataFrame:
    """Entries with the file and line they came from; a line that is not an entry fails the job and is named."""
    lines = numbered_lines(spark, path)
    given = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("line", given, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_e", parsed)
    bad = F.col("_e").isNull() | F.col("_e._bad").isNotNull() | (F.trim("line") == "")
    where = F.concat(F.lit("could not read line "), F.col("source_line"), F.lit(" of "), F.col("source_file"), F.lit(": "), F.col("line"))
    checked = rows.filter(F.when(bad, F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*[F.col(f"_e.{f.name}").alias(f.name) for f in schema], "source_file", "source_line")


#: Fields of entries that are written if the table has them; reals may be missing inside and are then "NaN".
REALS = {"target": 1, "feat_static_real": 1, "feat_dynamic_real": 2}
CODES = {"feat_static_cat": 1, "feat_dynamic_cat": 2}


def _nested(rank: int, kind: T.DataType) -> T.DataType:
    return kind if rank == 0 else T.ArrayType(_nested(rank - 1, kind))


def _deep(column: Column, rank: int, change) -> Column:
    return change(column) if rank == 0 else F.transform(column, lambda x: _deep(x, rank - 1, change))


def write_dataset(df: DataFrame, path: str, by: str = "split", **metadata) -> None:
    """Entries as JSON Lines, one folder per split, and a manifest of what they are.

    ``metadata``: such as freq, prediction_length, or feature names and cardinalities; any JSON value. Every call writes a
    new data folder first and the manifest, which names it, last. A reader goes by the manifest, so it sees the set before
    or the set after, never a part. A missing real is written as "NaN".
    """
    fields = {c: r for c, r in {**REALS, **CODES}.items() if c in df.columns}
    text = lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), F.lit("NaN")).otherwise(x.cast("string"))
    out = df.withColumns({c: _deep(F.col(c), r, text) for c, r in fields.items() if c in REALS})
    folder = f"data-{uuid.uuid4().hex}"
    out.write.partitionBy(by).json(f"{path}/{folder}")
    splits = {r[by]: r["n"] for r in df.sparkSession.read.schema(f"{by} string").json(f"{path}/{folder}").groupBy(by).agg(F.count("*").alias("n")).collect()}
    manifest = {"data": folder, "by": by, "columns": [c for c in df.columns if c != by], "entries": splits, "metadata": metadata}
    row = df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """What ``write_dataset`` recorded; an error where no set is complete."""
    try:
        return json.loads(spark.read.text(f"{path}/manifest").first().value)
    except AnalysisException as gone:
        raise ValueError(f"{path} holds no complete dataset") from gone


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The written dataset, or one split of it, with the types of its fields; "NaN" comes back as null."""
    manifest = read_manifest(spark, path)
    ranks = {**REALS, **CODES}
    kind = lambda c: T.StringType() if c not in ranks else _nested(ranks[c], T.StringType() if c in REALS else T.IntegerType())
    schema = T.StructType([T.StructField(c, kind(c)) for c in [*manifest["columns"], manifest["by"]]])
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{manifest['data']}")
    if split is not None:
        df = df.filter(F.col(manifest["by"]) == split)
    value = lambda x: F.when(x != "NaN", x.cast("double"))
    return df.withColumns({c: _deep(F.col(c), REALS[c], value) for c in manifest["columns"] if c in REALS})


def checkpoint_table(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back: cuts lineage and keeps columns prunable."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_by_key(df: DataFrame, path: str, keys: list[str]) -> None:
    df.write.partitionBy(*keys).parquet(path)


def read_by_key(spark: SparkSession, path: str, **wanted: str) -> DataFrame:
    """All key folders, or only the wanted ones (partition pruning)."""
    df = spark.read.option("basePath", path).parquet(path)
    for key, value in wanted.items():
        df = df.filter(F.col(key) == value)
    return df


def write_forecast(df: DataFrame, path: str, decimals: int | None = None, compress: bool = True) -> None:
    """CSV with header; doubles rounded, optionally gzipped."""
    if decimals is not None:
        doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        df = df.withColumns({c: F.round(c, decimals) for c in doubles})
    writer = df.write.option("header", "true")
    (writer.option("compression", "gzip") if compress else writer).csv(path)


def read_many(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All CSV folders whose name matches, as one table with the file each row came from."""
    df = spark.read.schema(schema).option("header", "true").csv(pattern)
    return df.withColumn("source_file", F.col("_metadata.file_path"))
