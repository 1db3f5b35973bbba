"""Every query on the test tables against its SQL."""

import pytest

from quillspark.plans import registry

from .compare import SF, duck, rows

ALL, SQL = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    got = ALL[name](spark, SF).toPandas()
    if name in SQL:
        want = duck(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
