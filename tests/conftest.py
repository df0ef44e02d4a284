import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from assayer.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "assayer-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame(ddl, rows) -> DataFrame"""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)
