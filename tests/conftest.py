"""One session for all tests."""

import pytest

from loam.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, "8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def rows():
    def sort(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return sort
