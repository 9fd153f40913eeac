import pytest

from tests.compare import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    """A fresh path below the session's shared folder."""
    from siltbed.session import scratch_path

    return scratch_path(spark, "test")
