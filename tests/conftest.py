import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Small frame from tuples and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
