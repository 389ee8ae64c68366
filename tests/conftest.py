from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge.session import local_session, ship  # noqa: E402

SMALLEST = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "4g", 2)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALLEST
