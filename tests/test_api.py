import pytest

from weftline import cli
from weftline.api import Engine
from weftline.sources.files import Config

from .conftest import rows

SQL = {
    "ddl/src.sql": "CREATE TABLE raw.orders (id INT, amt INT, day DATE);\nCREATE TABLE raw.users (id INT, name VARCHAR);",
    "etl/stage.sql": "CREATE TABLE stg.o AS SELECT id, amt AS amount FROM raw.orders;\nINSERT INTO stg.all_orders SELECT * FROM raw.orders;\nCREATE TABLE stg.all_orders (id INT, amt INT, day DATE);",
    "etl/mart.sql": "CREATE VIEW mart.v AS SELECT o.id, SUM(o.amount) AS total FROM stg.o o JOIN raw.users u ON o.id = u.id GROUP BY o.id;\nCREATE VIEW mart.w AS SELECT total FROM mart.v;",
    "etl/x_bck.sql": "SELECT 1 FROM nowhere",
}


@pytest.fixture
def root(tmp_path):
    for p, t in SQL.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(t)
    return tmp_path


def test_a_repository_from_end_to_end(spark, root, capsys):
    e = Engine(spark, str(root / "store"), Config(consumers=(("board", "bi", "mart.w"),), presentation=("mart.",)))
    with pytest.raises(Exception):
        (root / "empty").mkdir()
        e.index(str(root / "empty"))
    src = str(root / "src")
    info = dict(rows(e.index(src, "shop")))
    assert info["file"] == 3 and info["sql_query"] == 7 and info["repo"] == 1
    assert rows(e.dependents("raw.orders.amt"), "node", "depth", "what")[:2] == [("board", 4, "consumer"), ("mart.v.total", 2, "column")]
    assert ("raw.orders.day", "stg.all_orders.day", "STAR_EXPANSION") in rows(e.graph()["column_lineage"], "src_key", "dst_key", "transform")
    assert rows(e.trace("mart.w.total", 9), "src_key", "depth") == [("mart.v.total", 1), ("raw.orders.amt", 3), ("stg.o.amount", 2)]
    assert [r[0] for r in rows(e.upstream("mart.w.total", all_kinds=True), "id")] == ["mart.v.total", "raw.orders.amt", "stg.o.amount"]
    assert [r[0] for r in rows(e.downstream("RAW.Orders.amt"), "id")] == ["stg.all_orders.amt", "stg.o.amount"]  # views only when asked for
    assert rows(e.definition("stg.o"), "file_path", "authoritative") == [("etl/stage.sql", True)]
    assert {r[0] for r in rows(e.usages("orders"), "how")} == {"direct"} and e.usages("raw.orders").count() == 2
    s = e.scope_change("raw.orders")
    assert s["scope"]["n_tables"] == 4 and s["scope"]["risk"] == "low" and s["hints"] == []
    assert s["backfill_order"].index("stg.o") < s["backfill_order"].index("mart.v") < s["backfill_order"].index("mart.w")
    assert rows(e.empty_impact(["raw.users"]), "table_qualified", "value_state") == [("mart.v", None), ("mart.w", None)]
    assert rows(e.unused(), "table_qualified", "has_consumer") == [("mart.w", True), ("stg.all_orders", False)]
    assert rows(e.hubs(1), "table_qualified") == [("raw.orders",)]
    assert e.search("SUM(").count() == 1 and e.sql("SELECT count(*) FROM sql_table").first()[0] == 6
    assert "mart.w" in e.page() and e.diagram("mart.w.total").startswith("flowchart LR")
    assert {r["metric"]: r["band"] for r in e.coverage().collect()}["phantom_rate"] == "green"
    e.submit_feedback("trace", "TP")
    assert rows(e.feedback(), "tool", "verdict") == [("trace", "TP")]
    with pytest.raises(ValueError):
        e.submit_feedback("trace", "maybe")

    before = e.graph()
    assert rows(e.refresh(src, "shop")) == []
    (root / "src/etl/stage.sql").write_text("CREATE TABLE stg.o AS SELECT id, amt AS amount, day FROM raw.orders;")
    (root / "src/ddl/src.sql").unlink()
    assert rows(e.refresh(src, "shop")) == [("ddl/src.sql", "D"), ("etl/stage.sql", "M")]
    fresh = Engine(spark, str(root / "other"), e.config)
    fresh.index(src, "shop")
    a, b = e.graph(), fresh.graph()
    assert all(rows(a[k], *sorted(a[k].columns)) == rows(b[k], *sorted(a[k].columns)) for k in b)
    lost = rows(e.pr_impact(before), "table_qualified", "risk")
    assert lost == [("raw.orders", "low"), ("raw.users", "low"), ("stg.all_orders", "safe")]
    assert cli.main(["--store", "x", "find", "table", "stg"], e) == 0 and "stg.o" in capsys.readouterr().out
    assert cli.main(["--store", "x", "backfill-order", "stg.o"], e) == 0 and capsys.readouterr().out.split() == ["stg.o", "mart.v", "mart.w"]
