from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tessella.session import local_session, ship

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
