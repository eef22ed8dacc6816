import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from larder.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column expression over no table."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value
