"""Every query of the subpackage against its SQL, on the smallest tables."""

import os

import pytest

from compare import difference, oracle
from controlweave.llm.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, name):
    assert difference(QUERIES[name].run(spark, SF_DIR), oracle(SF_DIR), QUERIES[name].sql) is None
