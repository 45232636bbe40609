import random
from collections import deque

import pytest

from weftline.functions import text as X
from weftline.operators import closure as C
from weftline.plans import graph as G

from .conftest import rows


def bfs(edges, start, limit=None):
    out = {s: 0 for s in start}
    q = deque(start)
    while q:
        n = q.popleft()
        if limit is not None and out[n] >= limit:
            continue
        for a, b in edges:
            if a == n and b not in out:
                out[b] = out[n] + 1
                q.append(b)
    return {k: v for k, v in out.items() if k not in start}


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 2)])
def test_closure(spark, seed, limit):
    r = random.Random(seed)
    e = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(40)] + [("c1", "c2"), ("c2", "c1"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(e, "src_key string, dst_key string")
    start = spark.createDataFrame([("n0",), ("n1",), ("c1",), (None,), ("n0",)], "node string")
    clean = [x for x in e if None not in x]
    for least in (1, 10_000):
        assert {x["node"]: x["depth"] for x in C.closure(df, start, limit, least_hot=least, hops=3).collect()} == bfs(clean, ["n0", "n1", "c1"], limit)
        assert C.closure(df.limit(0), start, least_hot=least, hops=3).collect() == [] and C.closure(df, start.limit(0), least_hot=least, hops=3).collect() == []
        assert rows(C.closure(df.limit(0), start, keep_start=True, least_hot=least, hops=3), "node", "depth") == [("c1", 0), ("n0", 0), ("n1", 0)]


def test_closure_takes_ways_without_branches_at_once(spark, monkeypatch):
    # a chain of 120 nodes, entered by a short way and a longer one; loops of nodes with one way in, one of them with a start node
    e = [(f"h{i}", f"h{i + 1}") for i in range(120)] + [("a", "b"), ("b", "h0"), ("a", "h0"), ("a", "k0"), ("k0", "k1"), ("k1", "h60")]
    e += [("l1", "l2"), ("l2", "l1"), ("l2", "l3"), ("c1", "c2"), ("c2", "c1"), ("c1", "c1"), ("h120", "d")]
    starts = {"A": ["a"], "B": ["c1", "h100"], "C": ["b"], "D": ["none"]}
    df = spark.createDataFrame(e, "src_key string, dst_key string")
    start = spark.createDataFrame([(k, n) for k, v in starts.items() for n in v], "source string, node string")
    tags, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda t, tag="t", where="true": tags.append(tag) or cut(t, tag, where))
    got = rows(C.closure(df, start, by=["source"], hops=4))
    assert got == sorted(((k, n, d) for k, v in starts.items() for n, d in bfs(e, v).items()), key=repr)
    assert tags.count("reached") <= 5 and tags.count("climbed") <= 9


def test_contract(spark):
    e = spark.createDataFrame([("a", "s1"), ("s1", "s2"), ("s2", "b"), ("s2", "s1"), ("a", "c"), ("s1", "a"), ("s3", "d"), ("c", "s4"), ("a", "a")], "src string, dst string")
    syn = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "node string")
    assert rows(C.contract(e, syn)) == [("a", "b"), ("a", "c")]


def test_levels_and_order(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("d", "d"), ("q", "a")], "src string, dst string")
    n = spark.createDataFrame([(c,) for c in "zyxdcba"] + [(None,)], "node string")
    got = {r["node"]: (r["level"], r["in_cycle"]) for r in C.levels(n, e).collect()}
    assert got == {"a": (0, False), "c": (0, False), "b": (1, False), "d": (2, False), "x": (None, True), "y": (None, True), "z": (None, True)}
    order, cyc = C.rebuild_order(n, e)
    assert order[:4] == ["a", "c", "b", "d"] and set(order[4:]) == {"x", "y", "z"} and cyc
    assert C.rebuild_order(n.limit(0), e) == ([], False)


def test_similar_sets_lose_no_pair(spark):
    r = random.Random(9)
    sets = {f"k{i}": {r.choice("abcdefgh") for _ in range(r.randrange(1, 7))} for i in range(40)}
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "key string, item string")
    want = sorted((a, b) for a in sets for b in sets if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6)
    assert rows(G.similar_sets(df, df, 0.6), "left", "right") == want


def test_lost_and_renamed(spark):
    df = spark.createDataFrame

    def state(queries, reads, cols):
        return {
            "sql_query": df(queries, "id string, target_table string"), "selects_from": df(reads, "src_key string, dst_key string"), "star_source": df([], "src_key string, dst_key string"),
            "has_column": df(cols, "src_key string, dst_key string"), "sql_table": df([("s.tmp", "temp")], "qualified string, kind string"),
        }

    cols = [(t, f"{t}.{c}") for t in ("s.old", "s.new", "s.new2", "s.lost", "s.tmp") for c in "abc"]
    base = state([("1", "s.old"), ("2", "s.lost"), ("3", "s.use"), ("4", "s.use2")], [("3", "s.old"), ("4", "s.old"), ("3", "s.lost")], cols)
    head = state([("1", "s.new"), ("9", "s.new2"), ("8", "s.tmp"), ("3", "s.use"), ("4", "s.use2")], [("3", "s.new"), ("4", "s.new"), ("3", "s.new2"), ("4", "s.new2"), ("3", "s.tmp")], cols)
    assert rows(G.lost_producers(base, head)) == [("s.lost", None), ("s.old", "s.new")]
    assert rows(G.producer_diff(base, head.copy())) == [("s.lost", "lost"), ("s.new", "new"), ("s.new2", "new"), ("s.old", "lost"), ("s.tmp", "new")]


def test_labels(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(0,), (1,), (5,), (6,), (20,), (21,)], "n int")
    assert [r[0] for r in d.select(X.risk_label(F.col("n"))).collect()] == ["safe", "low", "low", "medium", "medium", "high"]
    n = spark.createDataFrame([("s.t_bck",), ("s.T_BCK",), ("s.t_bck_us1",), ("s.bck",), ("f.sql::x_backup",), ("S.Exact",), ("s.re_gex",), (None,)], "q string")
    got = [r[0] for r in n.select(X.is_noise(F.col("q"), exact=["s.exact"], regexes=["RE_g", "("])).collect()]
    assert got == [True, False, True, False, True, True, True, False]
    e = spark.createDataFrame([("STAR_EXPANSION", 0.8), ("X", 0.5), ("X", 1.0), (None, None), (None, 0.3)], "t string, c double")
    assert [r[0] for r in e.select(X.reason(F.col("t"), F.col("c"))).collect()] == ["star-expansion: columns inferred from source table schema", "inferred edge (confidence=0.50)", None, None, "scripting-block fallback: column lineage approximate"]
    a = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["a"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in a.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_free_sql_is_read_only(spark):
    g = {"t": spark.range(3)}
    assert G.execute_sql(spark, g, "SELECT * FROM t").count() == 3
    assert G.execute_sql(spark, g, "WITH x AS (SELECT id FROM t) SELECT 'insert into' AS s FROM x LIMIT 2").count() == 2
    assert G.execute_sql(spark, g, "SELECT id FROM t UNION SELECT 9", limit=2).count() == 2
    spark.range(7).createOrReplaceTempView("t")  # a view of the caller's
    assert G.execute_sql(spark, {"t": spark.range(3), "u9": spark.range(1)}, "SELECT * FROM t").count() == 3
    assert spark.table("t").count() == 7 and not spark.catalog.tableExists("u9")
    spark.catalog.dropTempView("t")
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE z AS SELECT 1", "SET a=1", "ALTER TABLE t ADD COLUMN x INT", "TRUNCATE TABLE t", "MERGE INTO t USING t s ON t.id = s.id WHEN MATCHED THEN DELETE", "CACHE TABLE t", "BEGIN SELECT 1; END"):
        with pytest.raises(ValueError):
            G.execute_sql(spark, g, bad)


def test_mermaid(spark):
    e = spark.createDataFrame([("a", 'b"', "RENAME"), ("a", "c", None), ("a", "c", None)], "src_key string, dst_key string, transform string")
    assert G.mermaid(e) == 'flowchart LR\n  n0["a"]\n  n1["b#quot;"]\n  n2["c"]\n  n0 -->|RENAME| n1\n  n0 --> n2'
