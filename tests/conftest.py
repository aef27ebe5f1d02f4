import pytest

from paronym.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, memory="3g", shuffle_partitions=4, app="tests")
