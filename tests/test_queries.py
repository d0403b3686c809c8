"""A sample of the named queries against their plain SQL (tools/check.py runs all of them)."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "wrmsse_by_level", "revenue_weights", "hierarchy_rollup", "target_encodings",
    "event_countdown", "price_momentum", "seasonal_naive", "metrics_total", "bin_global", "continuous_time_instances",
    "resample_hourly", "group_test_dates", "ordinal_codes", "kernel_quantiles", "blended_quantiles", "holiday_distances",
    "owa", "weighted_pinball_by_level", "parameter_search_ridge", "permutation_importance_mean", "continuous_time_lengths",
    "jsonl_scan", "dataset_round_trip", "mean_residuals", "holdout_wrmsse", "target_out_of_sample", "fit_by_store_poisson",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def norm(pdf):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, (list, np.ndarray)):  # a masked array's list has None where it is masked
            return tuple(one(x) for x in (v if isinstance(v, list) else v.tolist()))
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v.item() if hasattr(v, "item") else str(v) if hasattr(v, "isoformat") else v

    rows = [tuple(one(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple(str(v) for v in r if not isinstance(v, float)) + tuple(f"{v:.3g}" for v in r if isinstance(v, float)))


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = norm(entry.queries()[name](spark, FOLDER).toPandas())
    want = norm(con.execute(entry.oracle_sql()[name]).fetch_df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-4 * max(1, abs(x))), (a, b)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["level", "series", "wrmsse"] and out.count() == 12


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
