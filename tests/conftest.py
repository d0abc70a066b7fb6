import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from caselight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Rows of tuples and a schema text as a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
