"""Every registered query of the engine against its SQL."""

import pytest

from colloquy.plans import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same_rows(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLE_SQL[name])


def test_entry_imports_and_covers_the_catalog():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
