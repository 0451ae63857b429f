"""Every query of the driver's contract against its SQL."""

import pytest

from comparing import same_rows
from tidemark.queries import QUERIES, queries


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    sql = QUERIES[name].oracle()
    if sql is None:
        assert df.count() > 0
    else:
        same_rows(df, duck.sql(sql))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 * 48
    assert set(e.oracle_sql()) <= set(e.queries())
