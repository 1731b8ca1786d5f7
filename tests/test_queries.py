"""Every registered query with SQL against DuckDB on the smallest tables; the others for a result."""

import pytest

from tests.conftest import DATA, same
from verdure.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    assert same((tuple(r) for r in df.select(*columns).collect()), relation, [f'"{c}"' for c in columns])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).limit(1).count() == 1


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
