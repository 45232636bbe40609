"""Graph queries go as far as the graph does: chains longer than any hop limit."""

import pytest

from weftline.plans import graph as G

from .conftest import rows

N = 12


def chain_graph(spark):
    """s.t0 -> ... -> s.t12 by columns, and inlined temp edges s.u0 -> ... into
    the end of it, which has most edges; s.t0 feeds most."""
    df = spark.createDataFrame
    edges = [(f"s.t{i}.c", f"s.t{i + 1}.c", "RENAME") for i in range(N)] + [("s.t0.d", "s.t1.d", "RENAME"), ("s.x.c", f"s.t{N}.c", "RENAME")]
    edges += [(f"s.u{i}.c", f"s.u{i + 1}.c" if i + 1 < N else f"s.t{N}.c", "TEMP_INLINE") for i in range(N)]
    cols = sorted({x for a, b, _ in edges for x in (a, b)})
    tabs = sorted({x.rsplit(".", 1)[0] for x in cols})
    return {
        "column_lineage": df([(a, b, t, 1.0, "q") for a, b, t in edges], "src_key string, dst_key string, transform string, confidence double, query_id string"),
        "sql_query": df([("q", "f.sql", 1, "s.t0")], "id string, file_path string, start_line int, target_table string"),
        "sql_table": df([(t, "temp" if t == "s.t10" else "table", t[2:]) for t in tabs], "qualified string, kind string, name string"),
        "sql_column": df([(c, *c.rsplit(".", 1)) for c in cols], "id string, table_qualified string, col_name string"),
        "has_column": df([(c.rsplit(".", 1)[0], c) for c in cols], "src_key string, dst_key string"),
        "external_consumer": df([("board", "dashboard")], "name string, consumer_type string"),
        "consumed_by": df([(f"s.t{N}", "board")], "src_key string, dst_key string"),
        "selects_from": df([], "src_key string, dst_key string"),
        "star_source": df([], "src_key string, dst_key string"),
        "query_defined_in": df([("q", "f.sql")], "src_key string, dst_key string"),
        "file": df([("f.sql", True)], "path string, parse_failed boolean"),
        "defined_in": df([("s.t0", "f.sql")], "src_key string, dst_key string"),
    }


@pytest.fixture
def run(spark, monkeypatch):
    g = chain_graph(spark)
    monkeypatch.setattr(G, "load_graph", lambda s, d, texts=False, settled=(): g)
    return lambda name, *cols: rows(G.QUERIES[name](spark, "none"), *cols)


def test_traces_reach_the_first_source(run):
    assert [d for d, in run("g01_trace", "depth")] == sorted([1, *range(1, N + 1)], key=lambda d: repr((d,)))
    assert ("s.t0.c", "s.t1.c", N) in run("g01_trace", "src_key", "dst_key", "depth")
    assert run("g01_trace_source_to_sink", "src_key", "depth") == sorted((f"s.u{i}.c", N - i) for i in range(N))
    assert run("g02_upstream", "node", "depth") == sorted([(f"s.{k}{i}.c", N - i) for k in "tu" for i in range(N)] + [("s.x.c", 1)])


def test_downstream_reaches_the_last_consumer(run):
    want = [(f"s.t{i}.c", i, "column") for i in range(1, N + 1)] + [("s.t1.d", 1, "column"), ("board", N + 1, "consumer")]
    assert run("g03_downstream_with_consumers", "node", "depth", "what") == sorted(want, key=repr)
    tabs = sorted([(f"s.t{i}", 2 if i == 1 else 1, i) for i in range(1, N + 1)], key=repr)
    assert run("g05_rollup", "table_qualified", "n_columns", "depth") == tabs
    assert run("g06_split_synthetic", "table_qualified", "synthetic") == sorted([(t, t == "s.t10") for t, _, _ in tabs], key=repr)


def test_a_diff_reaches_the_last_table(run):
    assert run("g14_diff_impact") == sorted([(f"s.t{i}", i, int(i == N)) for i in range(N + 1) if i != 10], key=repr)
    order = [f"s.t{i}" for i in range(1, N + 1) if i != 10]
    assert run("g14_diff_order", "table_qualified", "level", "presentation") == sorted([(t, i, False) for i, t in enumerate(order)], key=repr)
    assert run("g14_diff_gating") == []


def test_the_engine_has_no_hop_limit_of_its_own(spark, tmp_path, monkeypatch):
    from weftline.api import Engine

    e = Engine(spark, str(tmp_path))
    g = chain_graph(spark)
    monkeypatch.setattr(e, "graph", lambda: g)
    assert max(r["depth"] for r in e.trace(f"s.t{N}.c").collect()) == N
    assert ("board", N + 1) in rows(e.dependents("s.t0.c"), "node", "depth")
