import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ampliq.session import local_session
    s = local_session(4, app="ampliq-tests", memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("ampliq.spread", "4")  # the test files are one row group each
    yield s
    s.stop()
