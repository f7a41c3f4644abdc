"""Every query of the library against its SQL on the smallest tables."""

import oracle
import pytest

from shoal.plans.oracles import ORACLE_SQL
from shoal.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
