from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codelattice.session import build, ship

    session = build("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    ship(session)
    yield session
    session.stop()
