import os

import pytest

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values()) and len(queries) >= 60
