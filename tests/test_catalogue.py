"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tripleframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return repr(float(v)) if not isinstance(v, str) and hasattr(v, "__float__") else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    wanted = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(rows, got.columns) == normal(wanted.fetchall(), columns)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) >= 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_every_order_is_probed(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority").collect()
    found = catalogue.QUERIES["kv_composite_probe"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted((k, p == "1-URGENT") for k, p in orders)
