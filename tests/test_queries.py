"""Every query of the engine that has SQL gives the rows of that SQL."""

import pytest

from quillspark import catalog

from .compare import DATA, same

NAMES = sorted(catalog.oracle_sql())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "norm", "repeats"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
