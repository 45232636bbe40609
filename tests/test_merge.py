import itertools
import random

from pyspark.sql import functions as F

from weftline.operators import merge as M
from weftline.operators import passes as P

from .conftest import rows

RANK = {"ddl": 3, "information_schema": 2, "usage": 1}


def test_has_column_precedence_matrix(spark):
    """A source gives way only to one of strictly higher rank: folded row by row."""
    kinds = ["ddl", "information_schema", "usage", "star_expansion", "clone_inherited"]
    data, want = [], {}
    for n, seq in enumerate(itertools.product(kinds, repeat=3)):
        cur = None
        for i, s in enumerate(seq):
            data.append((f"t{n}", "c", s, i))
            if cur is None or RANK.get(s, 0) > RANK.get(cur, 0):
                cur = s
        want[f"t{n}"] = cur
    df = spark.createDataFrame(data, "src_key string, dst_key string, source string, seq int")
    assert {r["src_key"]: r["source"] for r in M.merge_has_column(df, "seq").collect()} == want


def fold(rows_):
    kind, file = None, ""
    for k, f in rows_:
        if kind is None:
            kind = k
        elif kind == "temp" or (k == "derived" and kind in ("table", "view")):
            pass
        else:
            kind = k
        file = f or file
    return kind, file


def test_table_kind_guard_equals_the_fold(spark):
    r = random.Random(4)
    data, want = [], {}
    for n in range(150):
        seq = [(r.choice(["table", "view", "derived", "cte", "external", "temp", "table"]), r.choice(["", "", "f1", "f2"])) for _ in range(r.randrange(1, 6))]
        if any(k == "temp" for k, _ in seq[1:]) and r.random() < 0.5:
            seq = [x for x in seq if x[0] != "temp"] or [("table", "")]
        want[f"t{n}"] = fold(seq)
        data += [(f"t{n}", None, "d", "n", k, f, i) for i, (k, f) in enumerate(seq)]
    df = spark.createDataFrame(data, "qualified string, catalog string, db string, name string, kind string, defined_in_file string, seq int")
    assert {x["qualified"]: (x["kind"], x["defined_in_file"]) for x in M.merge_tables(df, "seq").collect()} == want


def test_upserts(spark):
    s = "k string, v int"
    a, b, none = spark.createDataFrame([("x", 1), ("y", None)], s), spark.createDataFrame([("x", 2), ("x", 2), ("z", 3)], s), spark.createDataFrame([], s)
    assert rows(M.upsert(a, b, keys=["k"])) == [("x", 2), ("y", None), ("z", 3)]
    assert rows(M.upsert(a, none, keys=["k"])) == [("x", 1), ("y", None)] and rows(M.upsert(None, none, keys=["k"])) == []
    assert rows(M.insert_absent(a, b, ["k"])) == [("x", 1), ("y", None), ("z", 3)]


def test_lineage_dedup(spark):
    e = spark.createDataFrame([("a", "b", "RENAME", 1), ("a", "b", "TEMP_INLINE", 2), ("a", "c", "TEMP_INLINE", 1), ("a", "c", "TEMP_INLINE", 3), ("a", "d", "TEMP_INLINE", 5), ("a", "d", None, 1)], "src_key string, dst_key string, transform string, seq int")
    assert rows(M.dedup_lineage(e, "seq"), "dst_key", "transform", "seq") == [("b", "RENAME", 1), ("c", "TEMP_INLINE", 3), ("d", None, 1)]


def graph(spark):
    df = spark.createDataFrame
    return {
        "sql_table": df([("s.a", None, "s", "a", "table", ""), ("s.b", None, "s", "b", "table", "f"), ("s.t", None, "s", "t", "derived", "")], "qualified string, catalog string, db string, name string, kind string, defined_in_file string"),
        "sql_column": df([("s.a.Id", "Id", "s.a"), ("s.a.x", "x", "s.a"), ("s.b.ID", "ID", "s.b")], "id string, col_name string, table_qualified string").select("id", F.lit(None).cast("string").alias("catalog"), F.lit("s").alias("db"), F.lit("").alias("table_name"), "col_name", "table_qualified"),
        "has_column": df([("s.a", "s.a.Id", "ddl"), ("s.a", "s.a.x", "ddl"), ("s.b", "s.b.ID", "usage")], "src_key string, dst_key string, source string"),
        "sql_query": df([("q1", "s.t", "f"), ("q2", "", "f"), ("q3", "s.a", "g")], "id string, target_table string, file_path string"),
        "selects_from": df([("q1", "s.a"), ("q1", "s.b"), ("q3", "s.a")], "src_key string, dst_key string"),
        "star_source": df([("q1", "s.a"), ("q2", "s.a"), ("q3", "s.a")], "src_key string, dst_key string"),
        "join_col_resolve": df([("q1", "s.t.k", "id"), ("q1", "s.t.m", "X"), ("q1", "s.t.z", "nope")], "src_key string, dst_key string, bare_col string"),
        "column_lineage": df([("s.a.x", "s.t.x", "RENAME", 1.0, "q1", False), ("s.b.ID", "s.t.q", "RENAME", 1.0, None, False)], "src_key string, dst_key string, transform string, confidence double, query_id string, inferred_from_source_name boolean"),
        "file": df([("f",), ("g",)], "path string"),
    }


def test_star_expansion_keeps_what_is_surer(spark):
    g = P.expand_stars(graph(spark))
    assert rows(g["column_lineage"], "src_key", "dst_key", "transform", "confidence") == [("s.a.Id", "s.t.Id", "STAR_EXPANSION", 0.8), ("s.a.x", "s.t.x", "RENAME", 1.0), ("s.b.ID", "s.t.q", "RENAME", 1.0)]
    assert ("s.t", "s.t.Id", "star_expansion") in rows(g["has_column"])
    assert g["sql_column"].where("table_qualified = 's.t'").count() == 2


def test_join_columns_by_owner(spark):
    got = rows(P.join_columns(graph(spark)), "src_key", "dst_key", "confidence")
    assert got == [("s.a.Id", "s.t.k", 0.5), ("s.a.x", "s.t.m", 0.9), ("s.b.ID", "s.t.k", 0.5)]
    g = graph(spark)
    once = P.resolve_joins(g)["column_lineage"]
    assert rows(P.resolve_joins({**g, "column_lineage": once})["column_lineage"]) == rows(once)  # again changes nothing


def test_delete_files(spark):
    g = M.delete_files(graph(spark), spark.createDataFrame([("f",), (None,), ("unknown",)], "path string"))
    assert rows(g["sql_table"], "qualified") == [("s.a",), ("s.t",)]
    assert rows(g["has_column"], "dst_key") == [("s.a.Id",), ("s.a.x",), ("s.b.ID",)]  # usage vouches for it
    assert rows(g["sql_query"], "id") == [("q3",)] and rows(g["selects_from"]) == [("q3", "s.a")]
    assert rows(g["column_lineage"], "dst_key") == [("s.t.q",)] and rows(g["file"]) == [("g",)]
