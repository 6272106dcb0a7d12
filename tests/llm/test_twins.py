"""The queries beside their SQL twins, over whole small tables."""

from __future__ import annotations

import pytest

from checks.compare import canonical, duck
from shopledger.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    got = queries.queries()[name](spark, FOLDER).toPandas()
    want = duck(FOLDER).execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0 and canonical(got) == canonical(want)
