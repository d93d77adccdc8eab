import pytest

from tests.session import new_session


@pytest.fixture(scope="session")
def spark():
    session = new_session(4, memory="6g")
    yield session
    session.stop()
