import pytest

from plumbline.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
