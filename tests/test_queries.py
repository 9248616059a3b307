"""Every registered query against its DuckDB counterpart, on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in oracle_sql():
        assert difference(got, duck.execute(oracle_sql()[name]).df()) is None
