from __future__ import annotations

import pytest

from kerbflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "kerbflow-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
