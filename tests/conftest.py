import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from respscore.session import build_session, discard_all
    s = build_session("local[4]", 8)
    yield s
    discard_all(s)
    s.stop()
