import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tiller.session import local_session

    s = local_session("*", shuffle_partitions=8, app="tiller-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    """A fresh folder per test (pytest hands out a new one each time)."""
    return str(tmp_path)
