import numpy as np
import pandas as pd
import pytest

from tidegrid.operators import windows as W
from tidegrid.operators.clean import mask_leading_zeros
from tidegrid.operators.joins import days_since_last_sale

ID = ["id"]


def got(df, col):
    return df.toPandas().sort_values(["id", "d"]).reset_index(drop=True)[col].astype(float)


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9, equal_nan=True)


def by(pdf):
    return pdf.groupby("id")["sales"]


def test_lags(tiny, tiny_pdf):
    same(got(W.add_lags(tiny, ID, [2]), "lag_2"), by(tiny_pdf).shift(2))


@pytest.mark.parametrize("shift,width", [(0, 3), (1, 2), (2, 4)])
def test_rolling_matches_pandas(tiny, tiny_pdf, shift, width):
    out = W.rolling(tiny, ID, [(shift, width)])
    roll = by(tiny_pdf).transform(lambda x: x.shift(shift).rolling(width).mean())
    same(got(out, f"roll_mean_{shift}_{width}"), roll)
    std = by(tiny_pdf).transform(lambda x: x.shift(shift).rolling(width).std())
    np.testing.assert_allclose(got(out, f"roll_std_{shift}_{width}"), std, atol=1e-6, equal_nan=True)


def test_rolling_quantiles(tiny, tiny_pdf):
    out = W.rolling_quantiles(tiny, ID, [1, 2, 5], [0.0, 0.25, 0.9])
    for w in (1, 2, 5):
        for p in (0.0, 0.25, 0.9):
            same(got(out, f"q{round(100 * p)}_{w}"), by(tiny_pdf).transform(lambda x: x.rolling(w).quantile(p)))
    some = W.rolling_quantiles(tiny, ID, [5], [0.5], need=2)
    same(got(some, "q50_5"), by(tiny_pdf).transform(lambda x: x.rolling(5, min_periods=2).quantile(0.5)))


def test_rolling_ratio(tiny, tiny_pdf):
    out = W.rolling_ratio(tiny, ID, 2, 4)
    mean = lambda n: by(tiny_pdf).transform(lambda x: x.rolling(n).mean())
    ratio = (mean(2) / mean(4) - 1).replace([np.inf, -np.inf], np.nan)
    same(got(out, "ratio_2_4"), ratio)


def test_rolling_shape(tiny, tiny_pdf):
    out = W.rolling_shape(tiny, ID, 5).toPandas().set_index(["id", "d"])
    assert out.loc[("spike", 5), "skew_5"] == pytest.approx(1.549131, abs=1e-6)
    assert out.loc[("spike", 5), "kurt_5"] == pytest.approx(2.675098, abs=1e-6)
    assert pd.isna(out.loc[("zeros", 5), "skew_5"])


@pytest.mark.parametrize("span", [3, 7, 30])
def test_ewm_matches_pandas(tiny, tiny_pdf, span):
    out = W.ewm_mean(tiny, ID, {"e": span}, need={"e": 1})
    same(got(out, "e"), by(tiny_pdf).transform(lambda x: x.ewm(span=span, min_periods=1).mean()))


def test_ewm_long_series_does_not_overflow(spark):
    n = 2000
    values = np.random.default_rng(1).integers(0, 20, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": "a", "d": range(n), "sales": values}))
    out = W.ewm_mean(df, ID, {"e": 3}, need={"e": 1})
    same(got(out, "e"), pd.Series(values).ewm(span=3).mean())


def test_ewm_recursive(tiny, tiny_pdf):
    clean = tiny.filter("id != 'nulls'")
    pdf = tiny_pdf[tiny_pdf.id != "nulls"].reset_index(drop=True)
    out = W.ewm_recursive(clean, ID, {"e": 5})
    same(got(out, "e"), by(pdf).transform(lambda x: x.ewm(span=5, adjust=False).mean()))


def test_pct_nonzero_counts_null_as_zero(tiny, tiny_pdf):
    out = W.pct_nonzero(tiny, ID, [3])
    same(got(out, "pct_nonzero_3"), by(tiny_pdf).transform(lambda x: x.fillna(0).ne(0).rolling(3).mean()))


def test_trailing_vol(tiny, tiny_pdf):
    out = W.trailing_vol(tiny.filter("id != 'nulls'"), ID)
    pdf = tiny_pdf[tiny_pdf.id != "nulls"].reset_index(drop=True)
    same(got(out, "trailing_vol"), by(pdf).transform(lambda x: x.diff().abs().expanding().mean()))


def test_leading_zeros(tiny):
    out = mask_leading_zeros(tiny.filter("id in ('late', 'zeros')"), ID).toPandas()
    late = out[out.id == "late"].sort_values("d").sales.tolist()
    assert np.isnan(late[:2]).all() and late[2:] == [3, 0, 5, 1]
    assert out[out.id == "zeros"].sales.isna().all()


def test_days_since_last_sale(tiny):
    out = days_since_last_sale(tiny.filter("id = 'late'"), ID, 1).orderBy("d").toPandas()
    # the count seen one row late is -1, 0, 0, 1, 1, 2
    assert out.last_sale.tolist() == [0, 0, 1, 0, 1, 0]


def test_price_change(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 3.0)], "id string, d int, sell_price double")
    out = W.price_change(df, ID, "d").orderBy("d").toPandas()
    assert out.price_rel_diff.tolist()[1:] == [0.0, 0.5]


def test_rolling_std_after_a_large_level(spark):
    values = [1e6 + k for k in range(30)] + [0.0, 0.1, 0.2] * 10
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "id string, d int, sales double")
    got = [r.roll_std_0_9 for r in W.rolling(df, ["id"], [(0, 9)]).orderBy("d").collect()]
    want = pd.Series(values).rolling(9).std().tolist()
    assert abs(got[-1] - np.std(values[-9:], ddof=1)) < 1e-9
    assert sum(g is None for g in got) == sum(w != w for w in want)
