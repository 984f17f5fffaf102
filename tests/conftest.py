import pytest

from quadloom.runtime import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("quadloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
