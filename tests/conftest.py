import pytest

from citeloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
