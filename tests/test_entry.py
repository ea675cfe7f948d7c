import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def plain(x):
    """A value as both engines show it."""
    if isinstance(x, decimal.Decimal | float):
        return f"{float(x):.7g}"
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


def show(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_query_runs_and_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert df.columns
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql)
        columns = [x[0] for x in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert show(df.columns, [tuple(r) for r in rows]) == show(columns, want.fetchall())


def test_library_stands_without_the_training_data_operators():
    code = "import sys; sys.modules['netquarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
