from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import binning as B
from tidegrid.functions import calendar as C
from tidegrid.functions import holidays as H
from tidegrid.functions import scaling as S
from tidegrid.functions.normal import normal_cdf, normal_ppf


def dates(spark, start, n):
    rows = [(start + timedelta(days=i),) for i in range(n)]
    return spark.createDataFrame(rows, "date date")


def test_holiday_golden_values(spark):
    df = dates(spark, date(2016, 12, 24), 8)
    out = H.holiday_features(df, "date", ["christmas_eve", "christmas_day"]).orderBy("date").collect()
    assert [r.christmas_eve for r in out] == [1, 0, 0, 0, 0, 0, 0, 0]
    assert [r.christmas_day for r in out] == [0, 1, 0, 0, 0, 0, 0, 0]
    kernel = H.squared_exponential_kernel(1.0)
    out = H.holiday_features(df, "date", ["christmas_eve"], kernel).orderBy("date").collect()
    want = [1.0, 3.67879441e-01, 1.83156389e-02, 1.23409804e-04, 1.12535175e-07, 0, 0, 0]
    np.testing.assert_allclose([r.christmas_eve for r in out], want, rtol=1e-8)


# Known dates, year -> holiday -> date.
KNOWN = {
    "easter_sunday": ["2008-03-23", "2011-04-24", "2019-04-21", "2024-03-31", "2025-04-20"],
    "thanksgiving": ["2008-11-27", "2011-11-24", "2019-11-28", "2024-11-28", "2025-11-27"],
    "memorial_day": ["2008-05-26", "2011-05-30", "2019-05-27", "2024-05-27", "2025-05-26"],
    "labor_day": ["2008-09-01", "2011-09-05", "2019-09-02", "2024-09-02", "2025-09-01"],
    "mothers_day": ["2008-05-11", "2011-05-08", "2019-05-12", "2024-05-12", "2025-05-11"],
    "cyber_monday": ["2008-12-01", "2011-11-28", "2019-12-02", "2024-12-02", "2025-12-01"],
    "columbus_day": ["2008-10-13", "2011-10-10", "2019-10-14", "2024-10-14", "2025-10-13"],
}


@pytest.mark.parametrize("name", KNOWN)
def test_known_holidays(spark, name):
    df = spark.createDataFrame([(d,) for d in KNOWN[name]], "day string").withColumn("date", F.col("day").cast("date"))
    assert [r[0] for r in df.select(H.distance_to_holiday("date", name)).collect()] == [0] * len(KNOWN[name])


def test_lags_for_frequency():
    day = C.lags_for("day")
    assert day[:7] == [1, 2, 3, 4, 5, 6, 7]
    assert {8, 13, 14, 15, 27, 28, 29, 30, 31, 363, 364, 365} - set(day) == {363, 364, 365} - set(day)
    assert C.lags_for("month") == [1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 23, 24, 25, 35, 36, 37]
    hour = C.lags_for("hour")
    assert {23, 24, 25, 167, 168, 169, 720} <= set(hour) and max(hour) <= 1200


def test_normal_approximations(spark):
    ps = [0.001, 0.01, 0.2, 0.5, 0.77, 0.99, 0.9995]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    out = [r[0] for r in df.select(normal_ppf(F.col("p"))).collect()]
    np.testing.assert_allclose(out, [NormalDist().inv_cdf(p) for p in ps], atol=1e-5)
    back = [r[0] for r in df.select(normal_cdf(normal_ppf(F.col("p")))).collect()]
    np.testing.assert_allclose(back, ps, atol=1e-5)


def test_cdf_transform_brute_force(spark):
    history = [1.0, 2.0, 2.0, 2.0, 5.0, 9.0, 9.0]
    new = [0.0, 1.0, 1.5, 2.0, 4.0, 9.0, 11.0]

    def brute(v):
        x = np.sort(history)
        m = len(x)
        q = np.arange(m) / m
        dx = np.diff(x)
        slope = np.append(np.where(dx == 0, 0, np.diff(q) / np.where(dx == 0, 1, dx)), 0)
        icept = q - slope * x
        left, right = np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")
        i = max(0, min(left + (right - left) // 2 - 1, m - 1))
        cut = S.normal_limit(m)
        return min(max(slope[i] * v + icept[i], cut), 1 - cut)

    h = spark.createDataFrame([("a", v) for v in history], "id string, v double")
    n = spark.createDataFrame([("a", v) for v in new], "id string, v double")
    out = {r.v: r.cdf for r in S.cdf_transform(h, n, ["id"], "v").collect()}
    for v in new:
        assert out[v] == pytest.approx(brute(v), abs=1e-12), v


def test_boxcox_inverse(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    for lam in (0.0, 0.3, 1.0):
        out = df.select("x", S.boxcox_inverse(S.boxcox(F.col("x"), lam, 1.0), lam, 1.0).alias("y")).collect()
        np.testing.assert_allclose([r.y for r in out], [r.x for r in out], atol=1e-9)


def test_pit_round_trip(spark):
    df = spark.range(1, 9).withColumn("u", B.pit(F.col("id") - 1, 8))
    assert [r[0] for r in df.select(B.unpit(F.col("u"), 8)).collect()] == list(range(1, 9))


def test_digitize_matches_numpy(spark):
    edges = [0.5, 1.0, 1.5]
    xs = [0.1, 0.5, 0.9, 1.0, 1.7, 3.0]
    df = spark.createDataFrame([("a", x) for x in xs], "id string, x double")
    out = {r.x: r.bin for r in B.digitize_scaled(df, ["id"], "x", edges).collect()}
    want = np.digitize(np.array(xs) / np.mean(np.abs(xs)), edges)
    assert [out[x] for x in xs] == want.tolist()


def test_all_zero_series_takes_global_scale(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 4.0), ("b", None)], "id string, x double")
    out = {r.id: r.scale for r in S.mean_scale(df, ["id"], "x").collect()}
    assert out == {"a": pytest.approx(4 / 3), "b": 4.0}


def test_moon_phase_changes(spark):
    df = dates(spark, date(2001, 1, 9), 2).select("date", C.moon_phase("date").alias("m")).orderBy("date").collect()
    assert df[0].m in (3, 4) and df[1].m == 4  # full moon on 2001-01-09
