"""Every query of the catalogue against its SQL; those without SQL have tests of their own elsewhere."""

import pytest
from conftest import rows_of, sql_rows

from lorekeep.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    rows = rows_of(found)
    assert rows or name in catalogue.SQL
    if name in catalogue.SQL:
        assert rows == sql_rows(catalogue.SQL[name], found.columns, sf_dir)
