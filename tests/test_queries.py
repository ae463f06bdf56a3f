"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(x):
    if isinstance(x, float):
        return f"{x:.6f}"
    return [shown(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    other = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    places = [other.columns.index(c) for c in columns]
    ours = sorted(str([shown(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(str([shown(r[k]) for k in places]) for r in other.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert 0 < len(rows) <= 8 and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


def test_entry_without_the_training_data_part(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None if name.startswith(("marlstone.llm", "corpus")) else find(name))
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.SQL)
