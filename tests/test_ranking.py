"""Order and quantiles over groups where one key or one value holds most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import splits
from tidegrid.operators.encode import encode_ordinal, every_kth
from tidegrid.operators.ranking import exact_quantiles, global_position, keyed_permutation
from tidegrid.operators.splits import ct_windows, previous_in_chunks


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(5)
    n = 6000
    key = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 40, n).astype(str))
    value = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n).round(3))
    pdf = pd.DataFrame({"k": key, "v": value, "u": np.arange(n)})
    return spark.createDataFrame(pdf), pdf


def test_global_position(hot):
    df, pdf = hot
    out = global_position(df, ["v", "u"]).toPandas().sort_values("pos")
    want = pdf.sort_values(["v", "u"])
    assert out.pos.tolist() == list(range(1, len(pdf) + 1))
    assert out.u.tolist() == want.u.tolist()


def test_position_in_groups(hot):
    df, pdf = hot
    out = global_position(df, ["v", "u"], ["k"]).toPandas().set_index("u").pos
    want = pdf.sort_values(["v", "u"]).groupby("k").cumcount() + 1
    want.index = pdf.sort_values(["v", "u"]).u
    assert (out.sort_index() == want.sort_index()).all()


def test_quantiles_whole_and_grouped(hot):
    df, pdf = hot
    probs = [0.0, 0.1, 0.5, 0.93, 1.0]
    row = exact_quantiles(df, "v", probs).first()
    np.testing.assert_allclose(list(row), np.quantile(pdf.v, probs), atol=1e-12)
    out = exact_quantiles(df, "v", probs, ["k"]).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k").v.quantile(probs).unstack().sort_index()
    np.testing.assert_allclose(out.to_numpy(), want.to_numpy(), atol=1e-12)


def test_ordinal_codes_shift_for_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    out = {r.x: r.code for r in encode_ordinal(df, "x", "code").collect()}
    assert out == {None: 0, "a": 1, "b": 2}


def test_every_kth(hot):
    df, pdf = hot
    assert every_kth(df, "v", "u", 7).count() == int(np.ceil(len(pdf) / 7))


def test_previous_in_chunks_matches_one_window(hot):
    df, pdf = hot
    df = df.withColumn("t", F.col("u") / 10)
    out = previous_in_chunks(df, "k", ["t", "u"], F.floor(F.col("t") / 25), "t", "prev").toPandas().set_index("u").prev
    want = pdf.assign(t=pdf.u / 10).groupby("k").t.shift(1)
    np.testing.assert_allclose(out.sort_index(), want, equal_nan=True)


@pytest.mark.parametrize("bucket", [2048, 7])
def test_ct_windows_brute_force(spark, hot, monkeypatch, bucket):
    """Windows with and without events, of a hot key, of a key of one event, and of one that has none."""
    monkeypatch.setattr(splits, "BUCKET", bucket)
    df, pdf = hot
    df = df.withColumn("t", F.col("u") / 10).select("k", "t", "u").unionByName(spark.createDataFrame([("once", 90.0, -1)], "k string, t double, u long"))
    cuts = [100.0, 300.0, 5000.0]
    keys = [*pdf.k.unique(), "once", "never"]
    grid = spark.createDataFrame([(k, c) for k in keys for c in cuts], "k string, cut double")
    lengths, members = ct_windows(df, grid, "k", "t", "u", 50.0, 20.0)
    times = {k: g.u.to_numpy() / 10 for k, g in pdf.groupby("k")} | {"once": np.array([90.0]), "never": np.array([])}
    found = {key: g.sort_values("t") for key, g in members.toPandas().groupby(["k", "cut", "part"])}
    rows = lengths.collect()
    assert len(rows) == len(keys) * len(cuts) * 2
    for r in rows:
        a, b = (r.cut - 50, r.cut) if r.part == "past" else (r.cut, r.cut + 20)
        t = np.sort(times[r.k][(times[r.k] >= a) & (times[r.k] < b)])
        assert r.valid_length == len(t)
        if len(t):
            mine = found[r.k, r.cut, r.part]
            np.testing.assert_allclose(mine.t, t)
            np.testing.assert_allclose(mine.gap, np.diff(np.r_[a, t]), atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_keyed_permutation_is_one(spark, n):
    pos = lambda seed: [r[0] for r in spark.range(n).select(keyed_permutation(F.col("id"), n, seed)).collect()]
    one, two = pos(1), pos(2)
    assert sorted(one) == sorted(two) == list(range(n)) and one == pos(1)
    if n >= 97:
        assert one != two and sum(a == i for i, a in enumerate(one)) < n / 10


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 2.0)], "g string, v double")
    rows = {(r.g, r.v): r.pos for r in global_position(df, ["v"], ["g"]).collect()}
    assert rows == {(None, 1.0): 1, (None, 3.0): 2, ("a", 2.0): 1}
    assert {r.g: r.q0 for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()} == {None: 2.0, "a": 2.0}
