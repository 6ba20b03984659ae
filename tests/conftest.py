import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestone.session import get_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
