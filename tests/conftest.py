import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from talentmesh.session import local_session

    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("talentmesh.join.salts", "2")
    yield session
    session.stop()
