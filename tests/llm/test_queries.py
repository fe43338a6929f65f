import pytest

from auditlake.llm import registry
from tests.oracle import both, views

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return views(DATA)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows(spark, con, name):
    got, want = both(spark, con, DATA, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want
