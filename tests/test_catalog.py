"""Every core query against its SQL, and rows and columns of those without."""

import pytest

from curatrix.plans import catalog
from tests.helpers import DATA, same_as_sql

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()


def test_entry_is_a_known_query(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["id_a", "id_b", "levenshtein_sim"]
