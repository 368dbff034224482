"""The session that all tests share."""

from __future__ import annotations

import pytest

from chronoloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, memory="6g")
