import pytest

from lexhaul.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
