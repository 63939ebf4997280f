"""Every query of the inspection engine against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from lotwise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if value != value else f"{value + 0.0:.8g}"
    return f"{float(value):.8g}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    want = con.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert rows == sorted(tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
