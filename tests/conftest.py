import pytest

from strandframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, memory="3g", partitions=4)
