import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.join(ROOT, "tests", "llm")]


@pytest.fixture(scope="session")
def spark():
    from quern.session import expose_package, local_session

    session = local_session(cpus=4, memory="3g", partitions=4)
    expose_package(session)
    yield session
    session.stop()
