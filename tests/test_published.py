"""The published examples of the formats against their expected values."""

import published
import pytest
from conftest import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(published.QUERIES))
def test_examples(spark, sf_dir, name):
    found = published.QUERIES[name](spark, sf_dir)
    assert rows_of(found) == sql_rows(published.SQL[name], found.columns, sf_dir)
