import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedstack.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="feedstack-tests")
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="feedstack-test-")
