import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegrid.operators import clean, joins
from tidegrid.operators import reshape as R
from tidegrid.sources import entries as N
from tidegrid.sources import files as S


def test_unpivot_then_pivot_is_identity(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, F1 double, F2 double")
    back = R.pivot_horizon(R.unpivot_horizon(wide, ["id"], 2), ["id"], "step", "value", 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_fill_gaps(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 6, 3.0)], "id string, d int, sales double")
    out = R.fill_gaps(df, ["id"], "d", {"sales": 0.0}, end=F.lit(7)).orderBy("id", "d").collect()
    assert [(r.id, r.d, r.sales) for r in out] == [
        ("a", 2, 1.0), ("a", 3, 0.0), ("a", 4, 0.0), ("a", 5, 2.0), ("a", 6, 0.0), ("a", 7, 0.0), ("b", 6, 3.0), ("b", 7, 0.0)
    ]
    part = R.fill_gaps(df, ["id"], "d", {"sales": 0.0}, end=F.lit(7), start=F.lit(4)).filter("id = 'a'").orderBy("d").collect()
    assert [(r.d, r.sales) for r in part] == [(4, 0.0), (5, 2.0), (6, 0.0), (7, 0.0)]


def test_checked_join_fails_on_repeated_key(spark):
    left = spark.createDataFrame([(1, "x")], "k int, v string")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, w int")
    with pytest.raises(PySparkException):
        joins.join_m1(left, right, ["k"]).collect()
    assert joins.join_m1(left, right.limit(1), ["k"]).count() == 1


def test_countdown_offset(spark):
    cal = spark.range(1, 61).select(F.col("id").cast("int").alias("d"), F.when(F.col("id") == 40, "Fair").alias("event"))
    exact = {r.d: r.event_Fair for r in joins.event_countdown(cal, {"event": ["Fair"]}, exact=True).collect()}
    late = {r.d: r.event_Fair for r in joins.event_countdown(cal, {"event": ["Fair"]}).collect()}
    assert exact[40] == 30 and exact[39] == 29 and exact[11] == 1 and exact[10] == 0 and exact[41] == 0
    assert late[39] == 30 and late[40] == 0 and late[10] == 1


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "x double")
    out = [r[0] for r in df.select(clean.clip(F.col("x"), 2.0, 5.0)).collect()]
    assert out == [2.0, None, 5.0]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 70000), (100, -5)], "a long, b long")
    out = clean.narrow_types(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["tinyint", "int"]
    assert sorted(map(tuple, out.collect())) == [(1, 70000), (100, -5)]


def test_dataset_round_trip_keeps_fields(spark, tmp_path):
    """Types, missing values and metadata come back; a second write replaces the set, and half a set is none."""
    schema = "item_id string, start string, target array<double>, feat_static_cat array<int>, feat_static_real array<double>, feat_dynamic_cat array<array<int>>, feat_dynamic_real array<array<double>>, split string"
    rows = [("a", "2020-01-01", [1.0, None, 3.0], [2], [0.5, None], [[1, 2, 3]], [[1.0, None, 2.0], [0.0, float("nan"), 1.0]], "train"), ("b", "2020-01-02", [], None, None, None, None, "test")]
    path = str(tmp_path / "ds")
    with pytest.raises(ValueError):
        S.read_dataset(spark, path)
    S.write_dataset(spark.createDataFrame(rows, schema), path, freq="D", prediction_length=3, feat_static_cat=[{"name": "store", "cardinality": 5}])
    back = {r.item_id: r for r in S.read_dataset(spark, path).collect()}
    assert tuple(back["a"]) == ("a", "2020-01-01", [1.0, None, 3.0], [2], [0.5, None], [[1, 2, 3]], [[1.0, None, 2.0], [0.0, None, 1.0]], "train")
    assert back["b"].target == [] and back["b"].feat_dynamic_real is None
    assert [r.item_id for r in S.read_dataset(spark, path, "test").collect()] == ["b"]
    known = S.read_manifest(spark, path)
    assert known["metadata"] == {"freq": "D", "prediction_length": 3, "feat_static_cat": [{"name": "store", "cardinality": 5}]} and known["entries"] == {"train": 1, "test": 1}
    S.write_dataset(spark.createDataFrame(rows[:1], schema), path, freq="W")
    assert S.read_dataset(spark, path).count() == 1 and S.read_manifest(spark, path)["metadata"] == {"freq": "W"}
    import shutil

    shutil.rmtree(path + "/manifest")  # as if the write had ended before its last step
    with pytest.raises(ValueError, match="no complete dataset"):
        S.read_dataset(spark, path)


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Files of several blocks: every line has its own number."""
    import json

    texts = {"a.json": 3000, "b.json": 1, "sub.json": 777, "_skipped.json": 5}
    for name, n in texts.items():
        (tmp_path / name).write_text("".join(json.dumps({"item_id": f"{name}-{i}", "start": "2020-01-01", "target": [i]}) + "\n" for i in range(n)))
    small = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = S.read_jsonl(spark, str(tmp_path))
        assert S.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 3778
    assert all(r.item_id == f"{r.source_file.split('/')[-1]}-{r.source_line}" and r.target == [r.source_line] for r in rows)


@pytest.mark.parametrize("bad", ["{bad", "", '{"item_id": "a", "target": "x"}'])
def test_bad_json_line_is_named(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text('{"item_id": "a", "start": "2020-01-01", "target": [1]}\n' + bad + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    with pytest.raises((PySparkException, Py4JJavaError), match="could not read line 1 of .*x.json"):
        S.read_jsonl(spark, str(tmp_path)).collect()


def test_validation_rules(spark):
    df = spark.sql("select * from values ('a', timestamp_ntz'2024-01-01', array(1.0D)), ('b', timestamp_ntz'2024-01-02', array(1.0D)), ('c', null, array(1.0D)), ('d', timestamp_ntz'2024-01-01', array()) t(item_id, start, target)")
    out = {r.item_id: r.problem for r in N.validate_entries(df, "week", ["item_id", "start"], {"target": 1}).collect()}
    assert out == {"a": None, "b": "start is not aligned to week", "c": "missing start", "d": "empty target"}
    with pytest.raises(ValueError):
        N.validate_entries(df, "week", ["item_id"], {"target": 2})


def test_column_pruning_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(10).select("id", *[F.lit(i).alias(f"d_{i}") for i in range(1, 50)]).write.parquet(path)
    plan = S.last_days(spark.read.parquet(path), ["id"], 2)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,d_48:int,d_49:int>" in plan


def test_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "keyed")
    S.write_by_key(spark.range(10).withColumn("k", (F.col("id") % 3).cast("string")), path, ["k"])
    plan = S.read_by_key(spark, path, k="1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_ragged_cap(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, None, None], [3.0, None])], "id string, a array<double>, b array<double>")
    assert N.ragged_to_entries(df, "id", "a", "b", 2).first().target == [2.0, 3.0]
    assert N.ragged_to_entries(df, "id", "a", "b", 9).first().target == [1.0, 2.0, 3.0]


def test_test_dates_are_padded_to_the_first_day(spark):
    """Blocks in order, dimensions within them, padding to the set's first day; uneven sets fail."""
    rows = [("a", 10, d, float(d)) for d in (3, 4, 6, 10)] + [("b", 10, d, 1.0) for d in (5, 10)] + [("a", 12, d, float(d)) for d in (3, 12)] + [("b", 12, 12, 7.0)]
    df = spark.createDataFrame(rows, "id string, final int, d int, sales double")
    out = R.group_test_dates(df, "id", "d", "sales", "final", 2).toPandas().sort_values(["block", "dim", "d"])
    found = {k: g.sales.tolist() for k, g in out.groupby(["block", "dim", "id"])}
    assert found == {
        (0, 0, "a"): [3.0, 4.0, 0, 6.0, 0, 0, 0, 10.0], (0, 1, "b"): [0, 0, 1.0, 0, 0, 0, 0, 1.0],
        (1, 0, "a"): [3.0, 0, 0, 0, 0, 0, 0, 0, 0, 12.0], (1, 1, "b"): [0] * 9 + [7.0],
    }
    last = R.group_test_dates(df, "id", "d", "sales", "final", 2, max_dim=1).select("block", "dim", "id").distinct().collect()
    assert sorted(map(tuple, last)) == [(0, 0, "b"), (1, 0, "b")]
    with pytest.raises((PySparkException, Py4JJavaError), match="equal blocks"):
        R.group_test_dates(df, "id", "d", "sales", "final", 3).collect()
    with pytest.raises((PySparkException, Py4JJavaError), match="different days"):
        R.group_test_dates(df.filter("NOT (id = 'b' AND d = 12)"), "id", "d", "sales", "final", 1).collect()


def test_zone_rules(spark):
    df = spark.createDataFrame([("2020-01-01T10:00:00",), ("2020-01-01T10:00:00Z",), ("2020-01-01 10:00:00+02:00",), ("2020-01-01T00:30:00-0530",)], "start string")
    of = lambda rule: [str(r.start) for r in N.utc_start(df, rule).collect()]
    assert of("ignore") == ["2020-01-01 10:00:00"] * 3 + ["2020-01-01 00:30:00"]
    assert of("utc") == ["2020-01-01 10:00:00"] * 2 + ["2020-01-01 08:00:00", "2020-01-01 06:00:00"]
    with pytest.raises((PySparkException, Py4JJavaError), match="not accepted"):
        of("error")
    assert N.utc_start(df.limit(1), "error").count() == 1
