"""Every query of the entry point's core against the same SQL in DuckDB."""

import pytest
from conftest import DATA, multiset, plain

from nestquery import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, oracle):
    df = queries.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    if name not in queries.ORACLE:
        assert got
        return
    names, rows = oracle(queries.ORACLE[name])
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert multiset(got) == multiset([tuple(r[i] for i in at) for r in rows])


@pytest.mark.parametrize("name", queries.SORTS)
def test_full_sort(name, spark, oracle):
    """All rows, in order."""
    df = queries.QUERIES[name](spark, DATA)
    names, rows = oracle(queries.ORACLE[name])
    assert df.columns == names and [plain(tuple(r)) for r in df.collect()] == [plain(r) for r in rows]
    limited = queries.QUERIES[name.removesuffix("_all")](spark, DATA)
    assert len(rows) >= limited.count() and "LIMIT" not in queries.ORACLE[name]
    assert "TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
