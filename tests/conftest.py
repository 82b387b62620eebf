import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("LAVRA_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from lavra.session import local_session, ship

    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("no test tables")
    return f"{DATA}/sf0.001"
