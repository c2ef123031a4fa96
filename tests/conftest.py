import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from flowloom.session import local_session

    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    session = local_session("tests", "8", 4)
    yield session
    session.stop()
