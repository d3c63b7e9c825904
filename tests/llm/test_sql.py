import pytest

from tallyloom.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") is None
