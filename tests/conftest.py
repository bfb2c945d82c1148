import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

DATA = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from varicohort.session import build_session

    s = build_session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
