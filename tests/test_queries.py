"""Every query of the package against its SQL; those without SQL must at least run and be stable."""

from __future__ import annotations

import pytest

from strandlog import plans

NAMES = sorted(plans.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, same_as_sql, name):
    df = plans.queries()[name](spark, sf)
    if sql := plans.oracle_sql().get(name):
        same_as_sql(df, sql)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
