import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemill.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
