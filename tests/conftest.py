"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    session = local_session(cores="4", shuffle_partitions="4", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
