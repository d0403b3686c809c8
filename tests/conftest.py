import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegrid.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests",
        **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Tiny series for edge cases: name -> values by day.
TINY = {
    "zeros": [0, 0, 0, 0, 0],
    "late": [0, 0, 3, 0, 5, 1],
    "nulls": [1, None, 2, None, 4, 3],
    "one": [7],
    "season": [1, 2, 3, 4, 5, 6, 7] * 6,
    "spike": [1, 2, 4, 9, 3],
}


@pytest.fixture(scope="session")
def tiny(spark):
    rows = [(k, i + 1, None if v is None else float(v)) for k, vs in TINY.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "id string, d int, sales double").cache()


@pytest.fixture(scope="session")
def tiny_pdf(tiny):
    return tiny.toPandas().sort_values(["id", "d"]).reset_index(drop=True)
