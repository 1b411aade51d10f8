from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corvane.session import local_session

    return local_session(4, memory="6g", app="tests", shared=f"file://{tmp_path_factory.mktemp('shared')}")
