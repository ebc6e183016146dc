import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fathomline.session import local_session

    s = local_session(8, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from tests.oracle import duck

    return duck(SF)
