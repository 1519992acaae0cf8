"""Every query with SQL of its own against DuckDB over the same tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from netloom.plans import catalogue

DATA = os.environ.get("NETLOOM_DATA", "/root/testdata/sf0.001")
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in ("events", "documents", "pages", "supplier", "customer", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 5) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v
    return sorted(repr([cell(r[i]) for i in order]) for r in data), sorted(names)


@pytest.fixture(scope="module")
def results(spark, request):
    """The rows of every query that is asked for; several run at once, as each keeps a small session waiting."""
    names = [i.callspec.params["name"] for i in request.session.items if "name" in getattr(getattr(i, "callspec", None), "params", {})]
    known = catalogue.queries()

    def run(name):
        df = known[name](spark, DATA)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in names if name in known}


def test_every_query_has_sql():
    assert set(ORACLE) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(results, duck, name):
    sql = duck.execute(ORACLE[name])
    assert rows(*results[name].result()) == rows([c[0] for c in sql.description], sql.fetchall())
