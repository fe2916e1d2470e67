import pytest
from oracle import check

from foretide.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert check(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) >= 0
