"""Every library query against its SQL, on the smallest tables."""

import duckdb
import pytest

from vellum import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Queries whose order is whole, and what says it where the SQL does not.
ORDERED = {"keyset_page": "", "filtered_page": "", "ranked_names": "", "facet_tags": "", "tag_suggestions": "", "top_categories": "", "recent_of_all": "", "tag_counts": " order by translate(tag, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), tag"}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order_of_queries(spark, duck, name):
    want = duck.execute(queries.ORACLE_SQL[name] + ORDERED[name])
    names = [c[0] for c in want.description]
    assert [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()] == want.fetchall()


@pytest.mark.parametrize(("name", "column"), [("library_scan", "fetched_at"), ("export_scan", "created"), ("source_scan", "created_at")])
def test_scans_are_newest_first(spark, name, column):
    got = [r[column] for r in queries.QUERIES[name](spark, SF).collect()]
    assert got == sorted(got, reverse=True)
