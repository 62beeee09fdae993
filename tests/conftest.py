from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    s = build_session("tidemark-tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions=8,
                      spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

