import pytest
from compare import assert_same

from rowsync.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert_same(df, catalog.ORACLE_SQL[name], SF)
    else:
        assert df.count() > 0


def test_entry_imports_without_corpus_operators():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
