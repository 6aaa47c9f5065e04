"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from compare import difference, oracle
from controlweave.workload.registry import registered

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", list(registered()))
def test_query(spark, connection, name):
    query = registered()[name]
    result = query.run(spark, SF_DIR)
    if query.sql is None:
        assert result.count() > 0
    else:
        assert difference(result, connection, query.sql) is None
