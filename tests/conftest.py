import pytest


@pytest.fixture(scope="session")
def spark():
    from tessella.session import build_session

    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
