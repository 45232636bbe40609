import pytest

from weftline.extract import tables as T
from weftline.extract.lexer import normalise, statements
from weftline.extract.lineage import extract

from .conftest import rows


def edges(sql, i=-1, **kw):
    o = extract("f.sql", sql, **kw)[i]
    return sorted((f"{e.src_table}.{e.src_col}", f"{e.dst_table}.{e.dst_col}", e.transform, e.confidence) for e in o.edges)


def test_statements_and_lines():
    st = statements("-- a;\n\nSELECT 1;\n/* ; */ SELECT ';' ;;\nCREATE PROCEDURE p() AS BEGIN\n SELECT 1; IF x THEN SELECT 2; END IF;\nEND;\nSELECT 3")
    assert [(s.line, s.tokens[0].low) for s in st] == [(3, "select"), (4, "select"), (5, "create"), (8, "select")]
    assert statements("") == [] and statements(" ;; -- x") == []
    assert normalise("create TEMP table if not exists t as\nselect 1").startswith("create temporary table t")
    assert normalise("SELECT 1 FROM t UNPIVOT (a\nFOR b IN (c, d)) x").count("\n") == 1


@pytest.mark.parametrize(
    "sql,kind,target,reads",
    [
        ("SELECT * FROM a.b x, c.d", "SELECT", "", ["a.b", "c.d"]),
        ("INSERT INTO x.y SELECT a FROM (SELECT b AS a FROM q.r WHERE c IN (SELECT d FROM s.t)) z", "INSERT", "x.y", ["q.r", "s.t"]),
        ("CREATE OR REPLACE TABLE t AS WITH q AS (SELECT 1 FROM u.v), w AS (SELECT * FROM q) SELECT * FROM w", "CREATE_TABLE", "t", ["u.v"]),
        ("CREATE VIEW v AS (SELECT a FROM b UNION SELECT c FROM d)", "CREATE_VIEW", "v", ["b", "d"]),
        ("UPDATE t SET a = 1 FROM u WHERE t.i IN (SELECT i FROM w)", "UPDATE", "", ["w", "u"]),
        ("DELETE FROM t WHERE EXISTS (SELECT 1 FROM u)", "DELETE", "", ["u"]),
        ("MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", "MERGE", "", ["s"]),
        ("CREATE TABLE t (a INT, b VARCHAR(9), PRIMARY KEY (a))", "CREATE_TABLE", "t", []),
        ("DROP TABLE t", "OTHER", "", []),
        ("WITH q AS (SELECT a FROM b) INSERT INTO c SELECT a FROM q", "INSERT", "c", ["b"]),
        ('INSERT INTO "A"."B C" SELECT x FROM [d].[e]', "INSERT", "a.b c", ["d.e"]),
        ("INSERT INTO t SELECT a FROM t", "INSERT", "t", []),
    ],
)
def test_reads_and_writes(sql, kind, target, reads):
    o = extract("f.sql", sql)[0]
    assert (o.kind, o.target, sorted(o.reads)) == (kind, target, sorted(reads))


def test_column_lineage():
    assert edges("INSERT INTO t (p, q, r) SELECT x.a, MAX(y.b) AS z, x.a + y.c FROM s.x x JOIN s.y y ON x.i = y.i") == [
        ("s.x.a", "t.p", "PASS_THROUGH", 1.0), ("s.x.a", "t.r", "EXPRESSION", 1.0), ("s.y.b", "t.q", "AGGREGATION", 1.0), ("s.y.c", "t.r", "EXPRESSION", 1.0)]
    assert edges("CREATE VIEW v AS SELECT a AS k, CAST(b AS DATE) AS d, 1 AS one, f(c, 'x') AS e FROM s.t") == [("s.t.a", "v.k", "RENAME", 1.0), ("s.t.b", "v.d", "EXPRESSION", 1.0), ("s.t.c", "v.e", "EXPRESSION", 1.0)]
    assert edges("CREATE TABLE o AS SELECT q.m AS n FROM (SELECT MAX(z) AS m FROM s.t) q") == [("s.t.z", "o.n", "RENAME", 1.0)]
    assert edges("CREATE TABLE o AS SELECT (SELECT MAX(z) FROM s.t) AS n FROM s.u") == [("s.t.z", "o.n", "EXPRESSION", 1.0)]
    cte = edges("CREATE TABLE o AS WITH c AS (SELECT a AS b FROM s.t) SELECT b FROM c")
    assert cte == [("f.sql::c.b", "o.b", "PASS_THROUGH", 1.0), ("s.t.a", "f.sql::c.b", "CTE_PROJECTION", 1.0)]
    amb = edges("CREATE TABLE o AS WITH c AS (SELECT k FROM s.t JOIN s.u ON t.i = u.i) SELECT k FROM c")
    assert [e for e in amb if e[2] == "CTE_PROJECTION_AMBIGUOUS"] == [("s.t.k", "f.sql::c.k", "CTE_PROJECTION_AMBIGUOUS", 0.5), ("s.u.k", "f.sql::c.k", "CTE_PROJECTION_AMBIGUOUS", 0.5)]
    u = edges("CREATE TABLE o AS SELECT a AS k FROM s.t UNION ALL SELECT b FROM s.u")
    assert u == [("s.t.a", "o.k", "RENAME", 1.0), ("s.u.b", "o.k", "PASS_THROUGH", 1.0)]


def test_markers():
    o = extract("f.sql", "INSERT INTO d (x, y) SELECT k, t.* FROM s.t t JOIN s.u u ON t.i = u.i")[0]
    assert o.bare == [("x", "k")] and o.stars == [("s.t", "t")] and o.edges == []
    o = extract("f.sql", "CREATE TABLE z AS SELECT a + 1 FROM s.t")[0]
    assert o.errors == ["col_lineage_skip:func_fallback:unnamed expression"]
    assert extract("f.sql", "MERGE INTO t USING s ON a = b WHEN MATCHED THEN DELETE")[0].errors == ["col_lineage_skip:merge"]


def test_temp_tables_schema_and_scripting():
    sql = "CREATE TEMP TABLE IF NOT EXISTS t1 AS SELECT a FROM s.x; CREATE TEMPORARY TABLE t2 AS SELECT a AS b FROM t1; INSERT INTO d.o (c) SELECT b FROM t2"
    inline = [e for e in edges(sql) if e[2] == "TEMP_INLINE"]
    assert inline == [("s.x.a", "d.o.c", "TEMP_INLINE", 1.0)]
    o = extract("f.sql", sql)
    assert o[0].target == "f.sql::t1" and o[0].role == "temp" and o[2].reads == ["f.sql::t2"]
    o = extract("f.sql", "USE SCHEMA ba_tmp; SELECT * FROM t, x.y; USE DATABASE z; SELECT * FROM u; USE d.s2; SELECT * FROM w", aliases={"ba_tmp": "ba"})
    assert [x.reads for x in o if x.kind == "SELECT"] == [["ba.t", "x.y"], ["ba.u"], ["s2.w"]]
    o = extract("f.sql", "BEGIN\n INSERT INTO a.b (x) SELECT y FROM c.d;\n IF (1 = 1) THEN DELETE FROM e.f; END IF;\nEND;")
    assert [(x.kind, x.mode, x.confidence, x.parse_failed) for x in o if x.kind != "OTHER"] == [("INSERT", "scripting", 0.3, True), ("DELETE", "scripting", 0.3, True)]
    o = extract("f.sql", "EXECUTE IMMEDIATE 'CREATE TABLE a.b AS SELECT x FROM c.d'")
    assert (o[0].mode, o[0].target, o[0].reads) == ("dynamic_sql", "a.b", ["c.d"])


def test_never_fails():
    for s in ("", ";;;", "SELECT", "INSERT INTO", "CREATE TABLE", "((((", "WITH a AS (", "SELECT a FROM (SELECT", "'open", "MERGE", "UPDATE", "SELECT * FROM t WHERE ((((", "BEGIN", "USE", "SELECT " + "(" * 300 + "1" + ")" * 300, "é ü 漢字 SELECT"):
        extract("f.sql", s)


FILES = "path string, repo_path string, sha string, dialect string, content string"


def test_relations_and_increment(spark):
    v1 = [
        ("a.sql", "r", "1", "ansi", "CREATE TABLE s.t (p INT, q INT); CREATE TABLE s.c1 CLONE s.t; CREATE TABLE s.c2 LIKE s.c1; CREATE TABLE l1 CLONE l2; CREATE TABLE l2 CLONE l1;"),
        ("b.sql", "r", "1", None, "INSERT INTO s.t SELECT x, y AS z, w FROM s.u; INSERT INTO t SELECT 1 FROM s.u;"),
        ("e.sql", None, "1", "odd", ""),
        ("n.sql", "r", "1", "ansi", None),
    ]
    v2 = [v1[0], ("b.sql", "r", "2", None, "INSERT INTO s.t SELECT k FROM s.v"), ("d.sql", "r", "1", "ansi", "SELECT p FROM s.t")]
    f1, f2 = spark.createDataFrame(v1, FILES), spark.createDataFrame(v2, FILES)
    g = T.graph_of(f1)
    got = rows(g["column_lineage"], "src_key", "dst_key", "transform", "inferred_from_source_name")
    # by position; the third value is beyond the catalog
    assert got == [("s.u.w", "s.t.w", "PASS_THROUGH", True), ("s.u.x", "s.t.p", "PASS_THROUGH", False), ("s.u.y", "s.t.q", "RENAME", False)]
    assert rows(g["has_column"], "dst_key") == [("s.c1.p",), ("s.c1.q",), ("s.c2.p",), ("s.c2.q",), ("s.t.p",), ("s.t.q",)]
    kinds = dict(rows(g["sql_table"], "qualified", "kind"))
    assert kinds["s.t"] == "table" and kinds["s.u"] == "table" and "t" not in kinds  # the bare target is s.t
    assert rows(g["file"].where("path = 'a.sql'"), "parse_failed", "parse_cause") == [(False, "pure_ddl_skip")]
    assert rows(T.second_pass(T.extract_files(f2))) == [("d.sql",)]
    old = T.extract_files(f1)
    ch = spark.createDataFrame([("b.sql", "M"), ("d.sql", "A"), ("e.sql", "D")], "path string, change string")
    inc, full = T.from_statements(T.refresh(old, ch, f2), f2), T.graph_of(f2)
    for k in full:
        assert rows(inc[k]) == rows(full[k]), k
    assert T.extract_files(f1.limit(0)).collect() == []


def test_long_chains_of_clones(spark):
    n = 40
    st = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(n)] + [("l1", "l2"), ("l2", "l1"), ("x", "nowhere"), ("t3", "t9"), ("none", "")], "target_table string, donor string")
    cat = spark.createDataFrame([(f"t{n}", 0, "a"), (f"t{n}", 1, "b"), ("t20", 0, "own")], "qualified string, pos int, col_name string")
    got = {}
    for r in T.clones(st, cat).collect():
        got.setdefault(r["qualified"], []).append(r["col_name"])
    assert {k: sorted(v) for k, v in got.items()} == {f"t{i}": ["own"] if i < 20 else ["a", "b"] for i in range(n) if i != 20}
    assert T.clones(st.limit(0), cat).collect() == []
