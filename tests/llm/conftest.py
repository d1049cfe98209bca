from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def shared(spark):
    """A session whose shared folder is set."""
    return spark
