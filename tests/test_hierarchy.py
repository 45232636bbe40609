import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import hierarchy as H

from .conftest import rows


def brute(links):
    """root and depth of every key by walking up."""
    parent = dict(links)
    out = {}
    for k in set(parent) | set(parent.values()):
        seen, at = [k], k
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        if at in parent:  # a loop: from the repeated key on
            loop = seen[seen.index(parent[at]) :]
            out[k] = (min(loop), -1)
        else:
            out[k] = (at, len(seen) - 1)
    return out


def run(spark, links, **kw):
    df = spark.createDataFrame(links, "node string, parent string")
    return H.hierarchy(df, **kw)


def check(spark, links, **kw):
    h = run(spark, links, paths=True, **kw).collect()
    assert {r["node"]: (r["root"], r["depth"]) for r in h} == brute(links)
    assert len(h) == len(brute(links))
    parent = dict(links)
    below = {}
    for k in parent:
        at, seen = k, {k}
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.add(at)
            below[at] = below.get(at, 0) + 1
    for r in h:
        if r["depth"] >= 0:
            assert r["path"][0] == r["root"] and r["path"][-1] == r["node"] and len(r["path"]) == r["depth"] + 1
            assert all(parent[b] == a for a, b in zip(r["path"], r["path"][1:]))
            assert r["n_descendants"] == below.get(r["node"], 0)
        else:
            assert r["path"] is None and r["n_descendants"] is None


def test_chain_star_loop_and_tail(spark):
    links = [(f"c{i:02}", f"c{i - 1:02}") for i in range(1, 30)]  # longer than a round
    links += [(f"s{i}", "hub") for i in range(20)]
    links += [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("t1", "l2"), ("t2", "t1"), ("me", "me"), ("m2", "me")]
    check(spark, links)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    r = random.Random(seed)
    links = [(f"n{i}", f"n{r.randrange(60)}") for i in range(60) if r.random() < 0.9]
    check(spark, links, least_hot=r.choice([1, 10_000]))


def test_empty_and_nulls(spark):
    assert rows(run(spark, [])) == []
    e = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), (None, "c", 3), ("d", None, 4), ("z", "b", 5)], "src string, dst string, node int")
    links = H.parent_links(e, "src", "dst")  # a child with two parents takes the smallest
    assert rows(links) == [("b", "a")]
    assert rows(H.hierarchy(links), "node", "root", "depth") == [("a", "a", 0), ("b", "a", 1)]


def test_hot_parent_and_descendants(spark):
    links = [(f"k{i:05}", "hub") for i in range(12_000)] + [("hub", "top")]
    h = run(spark, links, paths=True)
    d = H.descendants(h)
    assert d.where("ancestor = 'top'").count() == 12_001
    assert d.where("ancestor = 'hub'").agg(F.max("distance")).first()[0] == 1
    assert rows(h.where("node = 'hub'"), "n_descendants") == [(12_000,)]


def test_loops_report(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("s", "s")], "node string, parent string")
    assert rows(H.loops(H.hierarchy(links))) == [("a", 2, 1), ("s", 1, 0)]
