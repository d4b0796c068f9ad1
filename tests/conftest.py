import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillon.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("quillon-tests", cores=8, partitions=8, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
