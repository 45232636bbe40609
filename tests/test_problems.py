"""The general problems' queries on small tables of every odd kind."""

from datetime import datetime as D

import pytest

from weftline.plans import problems as P

from .conftest import rows

T = D(2025, 1, 31, 23, 59)
LINEAGE = "src_key string, dst_key string, transform string, confidence double, query_id string, inferred_from_source_name boolean, indexed_at timestamp, parent string, node string"
COLUMN = "id string, catalog string, db string, table_name string, col_name string, table_qualified string, indexed_at timestamp, deleted_at timestamp"
TABLES = {
    "selects_from": ("src_key string, dst_key string, indexed_at timestamp, weight long", []),
    "column_lineage": (LINEAGE, []),
    "sql_column": (COLUMN, []),
    "sql_query": ("id string, indexed_at timestamp, deleted_at timestamp", []),
    "src_file": ("path string, sha string, indexed_at timestamp", []),
    "file_done": ("run_id long, path string, sha string, done_at timestamp", []),
    "index_run": ("run_id long, started_at timestamp, finished_at timestamp, status string", []),
}


@pytest.fixture
def put(spark, tmp_path):
    def write(**data):
        for n, (schema, none) in TABLES.items():
            spark.createDataFrame(data.get(n, none), schema).write.mode("overwrite").parquet(str(tmp_path / f"{n}.parquet"))
        return str(tmp_path)

    return write


def edge(s, d, kind="RENAME", q=None, t=T):
    return (s, d, kind, 1.0, q, None, t, "p", "n")


def test_empty_tables(spark, put):
    d = put()
    for name, f in P.QUERIES.items():
        assert f(spark, d).collect() == [], name


def test_one_percent_is_enough(spark, put):
    sf = [(f"q{i}", "hot", T, 1) for i in range(98)] + [("q", "one", T, 1), (None, None, None, 1)]
    d = put(selects_from=sf, column_lineage=[edge(f"a{i}", f"k{i}") for i in range(101)])
    assert rows(P.p2_found(spark, d)) == [("selects_from", "hot"), ("selects_from", "one")]  # null is no key, 1 of 101 too little


def test_kinds_of_edges(spark, put):
    e = [edge("a", "b"), edge("a", "b"), edge("b", "c", "PASS_THROUGH"), edge("x", "y", "EXPRESSION"), edge("c", "d", "STAR_EXPANSION"), edge(None, "z"), edge("z", None), edge("s", "s"), edge("s", "t")]
    got = rows(P.p3_found(spark, put(column_lineage=e)))
    assert got == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("s", "s", -1), ("t", "s", -1)]


def test_orphans_by_table_and_month(spark, put):
    col = lambda i, seen, gone=None: (i, None, None, "t", i, "t", seen, gone)
    feb = D(2025, 2, 1)
    d = put(
        column_lineage=[edge("ok", "d", q="q1"), edge("gone", "d", q=""), edge("late", "d", q="no"), edge("late", "d", q="q2", t=feb), edge("none", "d", t=feb), edge("ok", "e", q="q3", t=None)],
        sql_column=[col("ok", T), col("gone", T, T), col("late", feb), col("late", feb, feb)],
        sql_query=[("q1", T, None), ("q2", T, T), ("q3", feb, None)],
    )
    assert rows(P.p6_found(spark, d)) == [
        ("sql_column", "2025-01", "gone", "d", "deleted"), ("sql_column", "2025-01", "late", "d", "late"), ("sql_column", "2025-02", "none", "d", "missing"),
        ("sql_query", "2025-01", "late", "d", "deleted"), ("sql_query", "2025-01", "late", "d", "missing"),
    ]
