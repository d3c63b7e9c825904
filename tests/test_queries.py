import pytest

import __spark_entry__ as entry
from tallyloom.plans import queries

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shuffled_sample_is_stable(spark):
    rows = [sorted(r.doc_id for r in queries.QUERIES["shuffled_sample"](spark, SF).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and len(rows[0]) == 100
