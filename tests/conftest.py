from __future__ import annotations

import pytest

from harborlight.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"
