import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyboard.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows():
    def take(df, *order):
        got = df.orderBy(*order) if order else df
        return [tuple(r) for r in got.collect()]

    return take
