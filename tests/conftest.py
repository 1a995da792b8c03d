from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillon.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", "tests")
    yield session
    session.stop()
