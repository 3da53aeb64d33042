import math

import duckdb
import pytest

from xylem import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    sql = duck.execute(queries.ORACLE_SQL[name])
    assert sorted(c[0] for c in sql.description) == names
    expected = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*names).collect())) == plain(expected)


def test_entry_points():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_once_for_both_hashes(spark, sf):
    plan = plan_of(queries.equal_documents(spark, sf))
    assert plan.count("to_xml(") == 1 and plan.count("from_xml(") == 2


def test_texts_are_made_by_all_tasks(spark, sf):
    assert queries.order_texts(spark, sf).rdd.getNumPartitions() == 4


def test_namespaces_come_without_patterns(spark, sf):
    assert "regexp_replace(xml" not in plan_of(queries.namespaced_documents(spark, sf))
