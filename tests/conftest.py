"""One session for all tests."""

from __future__ import annotations

import os

import pytest

from specmill.session import local_session

DATA = os.environ.get("SPECMILL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    """A local session with few partitions."""
    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest data folder."""
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
