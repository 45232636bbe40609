"""Parent-child links to full hierarchies by leaf peeling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, planned_once, rows_where, rows_written
from .closure import HOPS
from .skew import LEAST_HOT, hot_keys, lookup_join


def parent_links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, parent), one row per child. Rows with a null end are no links. If
    a child comes with several parents, the smallest one counts."""
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("parent"))
    return e.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))


def _peel(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Peels leaves of (node, parent) - numbers - bottom-up. Returns tables of what was peeled (node, parent -
    null for a root -, below: size of its subtree without itself), and the rest
    (node, parent), in which every node is a parent: exactly the nodes on loops.

    Every node carries how many of its children are still to come. In a hop the
    nodes that wait for none leave and send their subtree's size to their parent;
    messages to one parent are summed before they are shuffled, so no parent is
    too large. A round is 2, 4, 8 and then HOPS hops and one table; what has left
    is not carried further."""
    kind = links.schema["node"].dataType.simpleString()
    kids = links.groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("kids"))
    j = links.join(kids, F.col("node") == F.col("_p"), "full")
    state = j.select(F.coalesce("node", "_p").alias("node"), "parent", F.coalesce("kids", F.lit(0)).cast("long").alias("kids"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("gone"))
    own = "struct(node, parent, kids, below, gone OR kids = 0 AS gone)"
    message = f"struct(parent AS node, CAST(NULL AS {kind}) AS parent, CAST(-1 AS BIGINT) AS kids, below + 1 AS below, false AS gone)"
    peeled: list[DataFrame] = []
    rest, n = state, 2
    while not peeled or rows_where(rest):
        q = "SELECT node, parent, kids, below, gone FROM {state}"
        for _ in range(n):
            step = f"SELECT inline(IF(kids = 0 AND NOT gone AND parent IS NOT NULL, array({own}, {message}), array({own}))) FROM ({q})"
            q = f"SELECT node, max(parent) AS parent, sum(kids) AS kids, sum(below) AS below, max(gone) AS gone FROM ({step}) GROUP BY node"
        with planned_once(links.sparkSession):
            rest = cut(links.sparkSession.sql(q, state=rest.where("not gone")), "peel", "not gone")
        if peeled and rows_written(rest) == rows_where(rest):  # no leaf is left
            break
        peeled.append(rest.where("gone").select("node", "parent", "below"))
        n = min(HOPS, 2 * n)
    return peeled, rest.where("not gone").select("node", "parent")


def _loop_keys(rest: DataFrame, names: DataFrame) -> DataFrame:
    """(node, low) of nodes on loops (node, parent): the smallest key on each
    loop, by pointer doubling."""
    x = rest.join(names, F.col("node") == F.col("id"))
    loop = cut(x.select("node", F.col("parent").alias("jump"), F.col("key").alias("low")), "loop")
    left, reach = rows_written(loop), 1
    while reach < left:
        t = loop.select(F.col("node").alias("_t"), F.col("jump").alias("_j"), F.col("low").alias("_l"))
        nxt = loop.join(t, F.col("jump") == F.col("_t")).select("node", F.col("_j").alias("jump"), F.least("low", "_l").alias("low"))
        old, loop = loop, cut(nxt, "loop")
        drop_cut(old)
        reach *= 2
    return loop.select("node", "low")


def _hand_down(links: DataFrame, paths: bool, least_hot: int) -> DataFrame:
    """(node, root, depth[, up]) of every child in links without loops, by
    pointer doubling: a node knows the ancestor 2^k above it, and takes over what
    that one knows until it is a root. Ancestors of very many nodes are split."""
    inside = links.select(F.col("node").alias("_t"))
    up = [F.array("parent_key").alias("up")] if paths else []  # ancestors, nearest first
    s = links.select("node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("dist"), *up)
    s = cut(s.join(inside, F.col("jump") == F.col("_t"), "left").withColumn("done", F.col("_t").isNull()).drop("_t"), "down", "not done")
    done = [s.where("done")]
    while rows_where(s):
        todo = s.where("not done")
        # an ancestor that is done already is in an earlier table
        known = todo
        for x in done:
            known = known.unionByName(x)
        t = known.select(F.col("node").alias("_t"), F.col("jump").alias("_j"), F.col("dist").alias("_d"), F.col("done").alias("_e"), *([F.col("up").alias("_u")] if paths else []))
        hot = hot_keys(todo, "jump", least=least_hot) if rows_where(s) >= least_hot else []
        j = lookup_join(todo, t, "jump", "_t", hot, "inner")
        s = cut(j.select("node", F.col("_j").alias("jump"), (F.col("dist") + F.col("_d")).alias("dist"), *([F.concat("up", "_u").alias("up")] if paths else []), F.col("_e").alias("done")), "down", "not done")
        done.append(s.where("done"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("node", F.col("jump").alias("root"), F.col("dist").alias("depth"), *(["up"] if paths else []))


def hierarchy(links: DataFrame, paths: bool = False, sizes: bool = True, least_hot: int = LEAST_HOT) -> DataFrame:
    """From (node, parent), node unique: one row per key on either end with
    root, depth, on_loop, with `sizes` n_descendants and with `paths` path (array
    from the root to the node).

    Leaves are peeled bottom-up, sending the sizes of their subtrees to their
    parents, until nothing or only loops are left (_peel); then root, depth and
    path are handed down (_hand_down). For keys on a loop or below one depth is
    -1, root the smallest key on the loop, path and n_descendants null. Empty
    links give no rows."""
    raw = cut(links.select("node", "parent"), "links")
    big = rows_written(raw) >= least_hot
    hot = hot_keys(raw, "parent", least=least_hot) if big else []
    # keys become numbers: small rows, and sums without sorting
    names = raw.select(F.col("node").alias("key")).union(raw.select("parent")).distinct().withColumn("id", F.monotonically_increasing_id())
    names = cut(names, "names")
    to = lambda k, i: names.select(F.col("key").alias(k), F.col("id").alias(i))
    base = lookup_join(raw.join(to("_n", "_i"), F.col("node") == F.col("_n")), to("_p", "_j"), "parent", "_p", hot, "inner")
    base = cut(base.select(F.col("_i").alias("node"), F.col("_j").alias("parent"), *([F.col("parent").alias("parent_key")] if paths else [])), "numbered")
    peeled, rest = _peel(base.select("node", "parent"))
    on = cut(_loop_keys(rest, names), "loops")
    # a node on a loop stands for the top of what hangs below the loop
    got = _hand_down(base.join(on.select("node"), "node", "left_anti"), paths, least_hot)
    none = [F.array().cast(got.schema["up"].dataType).alias("up")] if paths else []
    tops = on.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *none)
    for p in peeled:
        tops = tops.unionByName(p.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *none))
    got = cut(got.unionByName(tops), "found")
    roots = hot_keys(got, "root", least=least_hot) if big else []
    j = lookup_join(got, to("root_key", "_r"), "root", "_r", roots, "inner").join(to("key", "_i"), F.col("node") == F.col("_i"))
    j = lookup_join(j, on.select(F.col("node").alias("_t"), F.col("low").alias("_low")), "root", "_t", [])
    bad = F.col("_t").isNotNull()
    more = [F.when(~bad, F.reverse(F.concat(F.array("key"), "up"))).alias("path")] if paths else []
    j = j.select(
        F.col("node").alias("_n"), F.col("key").alias("node"), F.coalesce("_low", "root_key").alias("root"), F.when(bad, -1).otherwise(F.col("depth")).cast("long").alias("depth"),
        (bad & (F.col("depth") == 0)).alias("on_loop"), *more,
    )
    if not sizes:
        return j.drop("_n")
    below = peeled[0].select(F.col("node").alias("_i"), "below")
    for p in peeled[1:]:
        below = below.unionByName(p.select(F.col("node").alias("_i"), "below"))
    j = j.join(below, F.col("_n") == F.col("_i"), "left")
    return j.select("node", "root", "depth", "on_loop", F.when(F.col("depth") >= 0, F.col("below")).alias("n_descendants"), *(["path"] if paths else []))


def descendants(h: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every pair of a node and one of its
    ancestors, from hierarchy(paths=True). Rows are made from each node's own
    path, so a root with very many descendants is spread over all tasks. Keys on
    loops or below them have no path and give no rows."""
    p = h.where(F.col("path").isNotNull()).select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return p.where(F.col("at") < F.col("depth")).select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def loops(h: DataFrame) -> DataFrame:
    """(loop_key, n_nodes, n_keys_below) of hierarchy()'s result for every loop:
    its smallest key, the nodes on it and the keys below it."""
    bad = h.where("depth = -1").groupBy(F.col("root").alias("loop_key"))
    n = F.count(F.when(F.col("on_loop"), F.lit(1)))
    return bad.agg(n.alias("n_nodes"), (F.count(F.lit(1)) - n).alias("n_keys_below"))
