"""One local session for all tests."""

import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from gaugeline.functions.session import local_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def gaps(spark):
    """Ten rows: ``a`` misses 10 % and has one extreme, ``b`` is complete, ``c`` misses 70 %."""
    rows = [
        (i, a, 2.0 * (i + 1), 1.0 if i < 3 else None)
        for i, a in enumerate([1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0, 9.0, 100.0])
    ]
    return spark.createDataFrame(rows, "id int, a double, b double, c double")


def frame(spark, pdf: pd.DataFrame):
    """pandas to Spark with NaN as NULL."""
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(),
                                 ", ".join(f"`{c}` {'double' if t.kind == 'f' else 'bigint'}"
                                           for c, t in pdf.dtypes.items()))
