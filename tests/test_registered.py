"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, rows_of


@pytest.mark.parametrize("name", sorted(set(queries()) & set(oracle_sql())))
def test_query_agrees_with_sql(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = connect(sf_dir).execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, result.fetchall()) and got


def test_entry(spark):
    assert entry(spark).count() > 0
