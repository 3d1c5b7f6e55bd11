import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from herdwatch.session import local_session  # noqa: E402

DATA = os.environ.get("HERDWATCH_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "herdwatch-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df, *order):
    """Rows as tuples, sorted, doubles rounded."""
    out = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()]
    return sorted(out, key=repr)
