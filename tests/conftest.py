import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from engramite.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session("tests", cores=4, partitions=4, spark__checkpoint__dir=f"file://{folder}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
