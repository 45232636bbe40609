"""Reachability: frontier expansion, contraction of synthetic tables, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, planned_once, rows_where, rows_written
from .skew import LEAST_HOT, hot_keys, lookup_join

#: Most hops of one round, that is between two written tables. Each is one
#: shuffle of the nodes of the round; the edges are shuffled once a round.
HOPS = 16
#: Hops of the first round; each round has twice as many as the one before, so
#: shallow graphs are done soon and deep ones take few tables.
FIRST_HOPS = 4
#: Parts into which the edges of a hub node are split.
PARTS = 32


class _Edges:
    """Edges (_s, _d, _w: their length) in the shared folder, ready for hops. The
    edges of a hub - a node from which more than 1/200 of all edges start - are
    split by their other end into PARTS parts, and the hub itself stands once for
    each part, so no task gets all edges of a node."""

    def __init__(self, edges: DataFrame, src: str, dst: str, least_hot: int = LEAST_HOT, length: str | None = None) -> None:
        e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), *([F.col(length).alias("_w")] if length else []))
        e = e.where(F.col("_s").isNotNull() & F.col("_d").isNotNull())
        self.all = cut(e.groupBy("_s", "_d").agg(F.min("_w").alias("_w")) if length else e.distinct(), "edges")
        # fewer rows than make a key hot need no look
        self.hot = hot_keys(self.all, "_s", least=least_hot) if rows_written(self.all) >= least_hot else []
        is_hot = lambda c: F.col(c).isin(self.hot)
        part = F.when(is_hot("_s"), F.pmod(F.hash("_d"), F.lit(PARTS))).otherwise(0) if self.hot else F.lit(0)
        more = F.when(is_hot("_d"), F.lit(PARTS - 1)).otherwise(0) if self.hot else F.lit(0)
        self.rows = self.all.select("_s", part.alias("_p"), "_d", more.alias("_m"), (F.col("_w") if length else F.lit(1)).cast("long").alias("_w"))

    def parted(self, nodes: DataFrame) -> DataFrame:
        """nodes (column node) with a row for each of their parts."""
        if not self.hot:
            return nodes.withColumn("part", F.lit(0))
        last = F.when(F.col("node").isin(self.hot), PARTS - 1).otherwise(0)
        return nodes.withColumn("part", F.explode(F.sequence(F.lit(0), last)))

    def hops(self, state: DataFrame, n: int, goes: str, kept: dict[str, str], sent: dict[str, str], folds: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
        """n hops from state (node, part, `by`, and the columns of folds), in
        SQL. In a hop every row stays with its columns as `kept` says, a row for
        which `goes` holds sends a row with the columns `sent` to each node
        behind it, and rows of one node and part (and equal `by`) are folded.
        All hops have the same expressions."""
        keys = ", ".join([*by, "node", "part"])
        row = lambda node, part, cols: f"struct({', '.join([*by, f'{node} AS node', f'{part} AS part', *(f'{cols[k]} AS {k}' for k in folds)])})"
        own, new = row("node", "part", kept), row("_d", "0", sent)
        news = f"transform(sequence(0, _m), p -> {row('_d', 'p', sent)})" if self.hot else f"array({new})"
        q = f"SELECT {keys}, {', '.join(folds)} FROM {{state}}"
        for _ in range(n):
            step = f"SELECT inline(IF(_d IS NULL, array({own}), concat(array({own}), {news}))) FROM ({q}) LEFT JOIN {{edges}} ON node = _s AND part = _p AND {goes}"
            q = f"SELECT {keys}, {', '.join(f'{f} AS {k}' for k, f in folds.items())} FROM ({step}) GROUP BY {keys}"
        return self.all.sparkSession.sql(q, state=state, edges=self.rows)


def closure(edges: DataFrame, start: DataFrame, max_depth: int | None = None, src: str = "src_key", dst: str = "dst_key", keep_start: bool = False, by: Sequence[str] = (), hops: int = HOPS, least_hot: int = LEAST_HOT) -> DataFrame:
    """(node, depth): what can be reached from the start nodes (column `node`),
    with the least number of edges. Start nodes are at depth 0 and left out
    unless keep_start; a start node reached from another stays a start node.
    With `by` (columns of start) that holds for each of its values by itself,
    and the result has these columns first.

    Without max_depth, nodes with one way in are taken out first: such a node is
    reached exactly when the one before it is, one edge later. They form trees,
    climbed by doubling (_trees()), and the hops go only over start nodes and
    nodes with several ways in, along edges as long as the way through the tree;
    the trees behind what was reached are joined at the end."""
    first = start.select(*by, "node").where(F.col("node").isNotNull()).distinct()
    if max_depth is not None:
        seen = _spread(_Edges(edges, src, dst, least_hot), first, max_depth, by, hops)
        return seen if keep_start else seen.where("depth > 0")
    first = cut(first, "start")
    pairs = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"))
    pairs = cut(pairs.where(F.col("_s") != F.col("_d")).distinct(), "pairs")
    ways = pairs.groupBy(F.col("_d").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("parent"))
    starts = first.select("node").distinct()
    links = cut(ways.where("n = 1").join(starts, "node", "left_anti").select("node", "parent"), "links")
    tree = _trees(links, least_hot)
    hot = lambda c: hot_keys(pairs, c, least=least_hot) if rows_written(pairs) >= least_hot else []
    on = lookup_join(pairs, links.select(F.col("node").alias("_l")), "_d", "_l", hot("_d"), "left_anti")
    on = lookup_join(on, tree.withColumnRenamed("node", "_n"), "_s", "_n", hot("_s"), "left").select(F.coalesce("root", "_s").alias("_s"), "_d", (F.coalesce("dist", F.lit(0)) + 1).alias("_w"))
    # hops never come to other nodes
    entered = on.select(F.col("_d").alias("_e")).union(starts.select("node")).distinct()
    on = on.join(entered, F.col("_s") == F.col("_e"), "left_semi")
    got = cut(_spread(_Edges(on, "_s", "_d", least_hot, "_w"), first, None, by, hops), "entered")
    behind = got.join(tree.withColumnRenamed("node", "_n"), F.col("node") == F.col("root")).select(*by, F.col("_n").alias("node"), (F.col("depth") + F.col("dist")).alias("depth"))
    out = cut((got if keep_start else got.where("depth > 0")).unionByName(behind), "reached")
    return out.select(*by, "node", F.col("depth").cast("int").alias("depth"))


def _trees(links: DataFrame, least_hot: int = LEAST_HOT) -> DataFrame:
    """(node, root, dist) of (node, parent), one row per node: the topmost of the
    nodes above it, which has no parent, and how far up it is, by pointer
    doubling. Nodes on loops or below them have no root and are left out: when a
    round settles nothing, only they are left."""
    hot = lambda df, c: hot_keys(df, c, least=least_hot) if rows_where(s) >= least_hot else []
    s = links
    s = lookup_join(links, links.select(F.col("node").alias("_t")), "parent", "_t", hot(links, "parent"), "left")
    s = cut(s.select("node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("dist"), F.col("_t").isNull().alias("done")), "climbed", "not done")
    done = s.where("done")
    while rows_where(s) and rows_where(s) < rows_written(s):
        todo = s.where("not done")
        known = done.unionByName(todo).select(F.col("node").alias("_t"), F.col("root").alias("_r"), F.col("dist").alias("_w"), F.col("done").alias("_k"))
        j = lookup_join(todo, known, "root", "_t", hot(todo, "root"), "inner")
        s = cut(j.select("node", F.col("_r").alias("root"), (F.col("dist") + F.col("_w")).alias("dist"), F.col("_k").alias("done")), "climbed", "not done")
        done = done.unionByName(s.where("done"))
    return done.select("node", "root", "dist")


def _spread(e: _Edges, first: DataFrame, max_depth: int | None, by: Sequence[str], hops: int) -> DataFrame:
    """(by, node, depth) of what can be reached from the nodes of first, these at
    depth 0, by the shortest way.

    A round takes 4, 8 and then `hops` hops from the nodes reached last, one
    shuffle each, and writes what was not seen before, or only by a longer way,
    to the shared folder. So a lost executor costs one round, and there are about
    as many tables as the depth of the graph divided by `hops`. Hub nodes are
    split. Loops end because nodes seen before are not taken again; null ends
    lead nowhere. max_depth is only for edges of length 1."""
    # at is twice the depth, and 1 more for rows reached in the last hop
    seen = cut(first.select(*by, "node", F.lit(1).cast("long").alias("at")), "reached", "at % 2 = 1")
    front, left, most = seen, max_depth, min(FIRST_HOPS, hops)
    while rows_where(front) and (left is None or left > 0):
        n = most if left is None else min(most, left)
        most = min(hops, 2 * most)
        s = e.hops(e.parted(front.where("at % 2 = 1")), n, "at % 2 = 1", {"at": "at - at % 2"}, {"at": "at + 2 * _w"}, {"at": "min(at)"}, by)
        left = None if left is None else left - n
        # the parts of a hub carry the same depth
        new = s.where("part = 0").drop("part")
        old = seen.select(*[F.col(c).alias(f"_{c}") for c in (*by, "node", "at")])
        known = F.col("at").bitwiseOR(F.lit(1)) >= F.col("_at").bitwiseOR(F.lit(1))
        for c in (*by, "node"):
            known = known & (F.col(c) == F.col(f"_{c}"))
        with planned_once(first.sparkSession):
            front = cut(new.join(old, known, "left_anti").select(*seen.columns), "reached", "at % 2 = 1")
        seen = seen.unionByName(front)
    return seen.groupBy(*by, "node").agg(F.expr("CAST(min(at) DIV 2 AS INT) AS depth"))


def contract(edges: DataFrame, synthetic: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between real nodes, hops through synthetic ones (column `node`)
    made direct: real -> synthetic* -> real becomes real -> real. Self-loops are
    left out. Each round replaces the synthetic ends of the open paths by what
    lies behind them; paths already walked are not walked again."""
    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct(), "table-edges")
    syn = synthetic.select(F.col("node").alias("_n")).distinct()
    mark = lambda df, col: df.join(syn.withColumnRenamed("_n", "_m"), F.col(col) == F.col("_m"), "left").withColumn("is_syn", F.col("_m").isNotNull()).drop("_m")
    behind = cut(mark(e.join(syn, F.col("a") == F.col("_n"), "left_semi"), "b"), "behind")
    paths = cut(mark(e.join(syn, F.col("a") == F.col("_n"), "left_anti"), "b"), "paths", "is_syn")
    parts = [paths]
    while rows_where(parts[-1]):
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        open_ = parts[-1].where("is_syn").select("a", "b")
        nxt = open_.join(behind.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "is_syn"), F.col("b") == F.col("_a")).select("a", F.col("_b").alias("b"), "is_syn").distinct()
        parts.append(cut(nxt.join(seen.where("is_syn").select("a", "b"), ["a", "b"], "left_anti"), "paths", "is_syn"))
        if len(parts) > 12:  # keep the plan of the union short
            whole = seen.distinct()
            parts = [cut(whole, "paths"), parts[-1]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("not is_syn and a <> b").select(F.col("a").alias(src), F.col("b").alias(dst)).distinct()


def levels(nodes: DataFrame, edges: DataFrame, hops: int = HOPS, least_hot: int = LEAST_HOT) -> DataFrame:
    """(node, level, in_cycle): topological levels of nodes under edges (src,
    dst) between them: level 0 needs nothing, others come after all they need.
    Nodes on a loop or behind one get no level (null) and in_cycle true.

    Every node carries how many of its predecessors are still to come; in a hop
    the nodes that wait for none take the next level and count one off at each
    node behind them. A round is 4, 8 and then `hops` hops and one table of what
    still waits."""
    n = nodes.select("node").where(F.col("node").isNotNull()).distinct()
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst")
    e = e.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    e = _Edges(e, "src", "dst", least_hot)
    need = e.all.groupBy(F.col("_d").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    rest = e.parted(n.join(need, "node", "left").select("node", F.coalesce("need", F.lit(0)).cast("long").alias("need"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("turn")))
    rest = cut(rest, "waiting", "level IS NULL")
    parts: list[DataFrame] = []
    most = min(FIRST_HOPS, hops)
    while rows_where(rest):
        # `turn` is the level the next hop gives; it is the same in all rows
        s = e.hops(
            rest.where("level IS NULL"), most, "need = 0 AND level IS NULL",
            {"need": "need", "level": "IF(need = 0 AND level IS NULL, turn, level)", "turn": "turn + 1"}, {"need": "CAST(-1 AS BIGINT)", "level": "CAST(NULL AS INT)", "turn": "turn + 1"},
            {"need": "sum(need)", "level": "max(level)", "turn": "max(turn)"},
        )
        most = min(hops, 2 * most)
        with planned_once(edges.sparkSession):
            old, rest = rest, cut(s, "waiting", "level IS NULL")
        if rows_where(rest) == rows_where(old) and rest.where("level IS NOT NULL").isEmpty():
            parts.append(rest)
            break
        parts.append(rest.where("level IS NOT NULL"))
    out = n.select("node", F.lit(None).cast("int").alias("level"), F.lit(True).alias("in_cycle")).where(F.lit(False))
    for p in parts:
        out = out.unionByName(p.where("part = 0").select("node", "level", F.col("level").isNull().alias("in_cycle")))
    return out


#: Most tables of one rebuild order: it is a list for a person or a scheduler.
MOST_ORDERED = 50_000


def rebuild_order(nodes: DataFrame, edges: DataFrame) -> tuple[list[str], bool]:
    """Kahn's order on the driver, for at most MOST_ORDERED tables and twenty times
    as many edges: ready tables
    in sorted order, first in first out; on a loop the rest follows in input
    order and the flag is true. levels() is the form without a bound."""
    from collections import deque

    got = [r[0] for r in nodes.select("node").where(F.col("node").isNotNull()).limit(MOST_ORDERED + 1).collect()]
    if len(got) > MOST_ORDERED:
        raise ValueError(f"more than {MOST_ORDERED} tables: use levels()")
    names = list(dict.fromkeys(got))
    here = set(names)
    pairs = edges.where(F.col("src") != F.col("dst")).join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    after: dict[str, set[str]] = {}
    need = dict.fromkeys(names, 0)
    got_pairs = pairs.select("src", "dst").distinct().limit(20 * MOST_ORDERED + 1).collect()
    if len(got_pairs) > 20 * MOST_ORDERED:
        raise ValueError(f"more than {20 * MOST_ORDERED} edges: use levels()")
    for a, b in got_pairs:
        if a in here and b in here:
            after.setdefault(a, set()).add(b)
            need[b] += 1
    ready = deque(sorted(n for n in names if not need[n]))
    out: list[str] = []
    while ready:
        n = ready.popleft()
        out.append(n)
        for m in sorted(after.get(n, ())):
            need[m] -= 1
            if not need[m]:
                ready.append(m)
    if len(out) == len(names):
        return out, False
    done = set(out)
    return out + [n for n in names if n not in done], True
