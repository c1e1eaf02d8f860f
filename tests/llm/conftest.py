import pytest

from cartwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, app="llm-tests")
