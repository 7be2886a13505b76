import pytest

from lodestrata.session import local_session, ship
from lodestrata.storage import clear


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(4, 3, "4g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()
