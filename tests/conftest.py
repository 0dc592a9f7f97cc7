import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from torrentia.session import get_session

    s = get_session("tests", cpus="3", partitions=3)
    s.sparkContext.setLogLevel("ERROR")
    return s
