import json

import pytest
from pyspark.sql import functions as F

from weftline.sinks import store as K
from weftline.sources import files as S
from weftline.streaming import watch as W

from .conftest import rows


def test_scan_and_ignore(spark, tmp_path):
    for p, t in {"a.sql": "SELECT 1", "x/b.sql": "SELECT\n2", "x/b_bck.sql": "no", "old/c.sql": "no", "x/d.txt": "no", "x y/ü.sql": "3", "x/t_20240101.sql": "4"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    df = S.scan(spark, str(tmp_path), ["old/", "*_[0-9]*.sql", "# note", "!x/t_*"])
    assert rows(df, "path", "content") == [("a.sql", "SELECT 1"), ("x y/ü.sql", "3"), ("x/b.sql", "SELECT\n2"), ("x/t_20240101.sql", "4")]
    assert rows(S.scan(spark, str(tmp_path), only=["a.sql", "gone.sql"]), "path") == [("a.sql",)]
    assert S.tracked(str(tmp_path)) in (None, [])


def test_delta(spark):
    a = spark.createDataFrame([("same", "1"), ("mod", "1"), ("del", "1"), ("null", None)], "path string, sha string")
    b = spark.createDataFrame([("same", "1"), ("mod", "2"), ("new", "1"), ("null", None)], "path string, sha string")
    assert rows(S.delta(a, b)) == [("del", "D"), ("mod", "M"), ("new", "A")]


def test_catalog(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("TABLE_SCHEMA;Table_Name;COLUMN_NAME;x\nBA_TMP; T ;Id;1\nba;t;id;2\nba;t;;3\n;t;z;4\nba;d;k;5\n")
    c = S.catalog_csv(spark, str(p), {"ba_tmp": "ba"})
    assert rows(c, "qualified", "col_name") == [("ba.d", "k"), ("ba.t", "id")]
    df = spark.createDataFrame
    g = {
        "sql_table": df([("ba.d", None, "ba", "d", "derived", ""), ("x.y", None, "x", "y", "derived", "")], "qualified string, catalog string, db string, name string, kind string, defined_in_file string"),
        "sql_column": df([], "id string, catalog string, db string, table_name string, col_name string, table_qualified string"),
        "has_column": df([("ba.t", "ba.t.id", "ddl"), ("ba.d", "ba.d.k", "usage")], "src_key string, dst_key string, source string"),
    }
    g = S.apply_catalog(g, c)
    assert rows(g["sql_table"], "qualified", "kind") == [("ba.d", "table"), ("ba.t", "table"), ("x.y", "derived")]
    assert rows(g["has_column"]) == [("ba.d", "ba.d.k", "information_schema"), ("ba.t", "ba.t.id", "ddl")]
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        S.catalog_csv(spark, str(p))


def test_manifest_consumers_facets_config(spark, tmp_path):
    m = tmp_path / "manifest.json"
    m.write_text(json.dumps({"other": 1, "nodes": {"a": {"resource_type": "table", "schema": "S", "name": "T", "columns": {"Id": {"name": "Id"}}}, "b": {"resource_type": "test", "schema": "s", "name": "u", "columns": {}}, "c": {"resource_type": "view", "schema": "s", "name": "v", "alias": "w", "columns": {}}}}))
    assert rows(S.dbt_manifest(spark, str(m))) == [("s.t", "id"), ("s.w", None)]
    g, warn = S.declared_consumers({"sql_table": spark.createDataFrame([("mart.a",), ("raw.b",)], "qualified string")}, spark.createDataFrame([("d1", "bi", "MART.A"), ("d1", "bi", "raw.b"), ("d2", "bi", "no.t")], "name string, consumer_type string, table string"), ["mart."])
    assert rows(g["consumed_by"]) == [("mart.a", "d1"), ("raw.b", "d1")] and rows(warn, "table", "warning") == [("no.t", "unknown table"), ("raw.b", "outside the presentation layer")]
    f = tmp_path / "f.csv"
    f.write_text("pattern,label,color\nMART.*,mart,red\n*_x,ex,blue\n*.a_*,a\n")
    t = spark.createDataFrame([("mart.a_x",), ("raw.a_1",), ("raw.q",), (None,)], "qualified string")
    assert [(r[0], list(r[1]), r[2]) for r in S.facets(t, S.facet_rules(spark, str(f))).orderBy("qualified").collect()] == [("mart.a_x", ["mart", "ex", "a"], "red"), ("raw.a_1", ["a"], None)]
    c = tmp_path / "c.toml"
    c.write_text('[lineage]\ndialect = "postgres"\n[lineage.noise_filter]\nignore_table_patterns = ["*_Old"]\nindex_filter = true\n[lineage.schema_aliases]\nA_tmp = "A"\n[[lineage.consumers]]\nname = "n"\ntype = "bi"\ntables = ["M.T"]\n')
    got = S.read_config(str(c))
    assert (got.dialect, got.noise_globs, got.filter_at_index, got.schema_aliases, got.consumers) == ("postgres", ("*_old",), True, {"a_tmp": "a"}, (("n", "bi", "m.t"),))
    c.write_text("not toml [")
    assert S.read_config(str(c)) == S.Config() == S.read_config(str(tmp_path / "none"))
    assert S.dialect("odd") == "ansi" and S.dialect(None) == "ansi" and S.dialect("tsql") == "tsql"


def test_store(spark, tmp_path):
    st = K.GraphStore(spark, str(tmp_path / "g"))
    assert st.read()["file"].collect() == []
    one = {"file": spark.createDataFrame([("a",)], "path string")}
    st.write(one, "sha1")
    held = st.read()["file"]
    st.write({"file": spark.createDataFrame([("b",)], "path string")}, "sha2")
    assert rows(held) == [("a",)] and rows(st.read()["file"]) == [("b",)]  # readers keep what they opened
    with pytest.raises(ValueError):
        st.write({"file": one["file"].limit(0)})
    assert rows(st.read()["file"]) == [("b",)]
    assert K.freshness(st, "sha3") == {"indexed_sha": "sha2", "stale": True, "commits_behind": None, "version_stale": False}
    st.clear()
    assert st.read()["sql_table"].collect() == []


def test_page(spark):
    n = spark.createDataFrame([("a", "s", "table", 1, True), ("b</script>", "s", "view", 1, False)], "id string, schema string, kind string, deg int, cat boolean")
    page = K.html_page(n, spark.createDataFrame([("a", "b</script>", 2)], "source string, target string, n long"))
    assert '"n": 2' in page and page.count("</script>") == 1
    with pytest.raises(ValueError):
        K.html_page(n, n, most=1)
    assert json.loads(K.as_json(n.limit(1))[0])["schema"] == "s"
    with pytest.raises(ValueError):
        K.as_json(spark.range(3), most=2)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    ev = [("f1", "A", "2025-01-01T00:00:00"), ("f1", "M", "2025-01-01T00:00:01"), ("f1", "M", "2025-01-01T00:00:09"), ("f2", "D", "2025-01-01T00:00:00")]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "change", "at"), e))) for e in ev))
    want = [("f1", 1), ("f1", 2), ("f2", 1)]
    assert rows(W.debounce(spark.read.schema("path string, change string, at timestamp").json(str(src)), "path", "at", late=None), "key", "n_events") == want
    q = W.debounce(W.watch_files(spark, str(src)), "path", "at").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("bursts"), "key", "n_events") == want

    req = tmp_path / "req"
    req.mkdir()
    data = [("reindex", "r1", 1), ("reindex", "r1", 2), ("index", "r1", 3), ("reindex", "r1", 4), ("reindex", "r2", 1)]
    (req / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "at": f"2025-01-01T00:00:0{s}", "seq": s}) for k, p, s in data))
    stream = spark.readStream.schema("kind string, path string, at timestamp, seq long").json(str(req))
    seen = []
    q = W.run_writer(stream, str(tmp_path / "ck"), lambda b, n: seen.extend((r["kind"], r["path"], r["seq"], n) for r in b.collect()))
    q.awaitTermination(60)
    assert sorted(seen) == [("index", "r1", 3, 0), ("reindex", "r1", 4, 0), ("reindex", "r2", 1, 0)]
    assert W.coalesce_requests(spark.createDataFrame([], "kind string, path string, at timestamp, seq long")).collect() == []
