"""Every query runs; those with SQL give DuckDB's rows."""

import pytest

from scriptloom.plans import boundary_queries, catalog, editor_queries, quality_queries  # noqa: F401  (queries register on import)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(name, spark, duck, data, same):
    same(catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, data):
    rows = catalog.QUERIES[name](spark, data).toPandas()
    assert len(rows.columns)
    if name not in ("chinese_group_findings", "adjacent_duplicates", "variant_buckets", "fuzzy_glossary"):
        assert len(rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
