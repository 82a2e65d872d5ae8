import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairwright.session import local_session  # noqa: E402



@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def rows(df):
    return [tuple(r) for r in df.collect()]
