"""Every query that has SQL against DuckDB, and the driver contract."""

import os
import re

import duckdb
import pytest

from lorekeep import programs  # noqa: F401  registers its queries
from lorekeep import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(engine.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = engine.QUERIES[name](spark, sf_dir)
    want = duck.sql(engine.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() == 10


def test_nothing_else_imports_the_training_data_operators():
    import lorekeep

    top = os.path.dirname(lorekeep.__file__)
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read()), n
