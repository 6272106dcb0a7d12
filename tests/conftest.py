from __future__ import annotations

import pytest

from shopledger.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    """All rows as plain tuples, in the order Spark returns them."""
    return [tuple(r) for r in df.collect()]


def unordered(df) -> list[tuple]:
    return sorted(rows(df), key=repr)
