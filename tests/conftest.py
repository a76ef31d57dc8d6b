import pytest

from lotlens.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cores=4, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
