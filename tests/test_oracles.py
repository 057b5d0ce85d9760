"""Every query of the library against its SQL twin on the smallest tables."""

import pytest
from oracle import duck_rows, spark_rows

from spindrift import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
