import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import local_session, ship_package

    session = local_session(os.environ.get("TEST_CPUS", "4"), partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
