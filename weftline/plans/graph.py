"""Composite graph operators: the questions people ask of the graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import closure as C
from ..schema import SYNTHETIC
from ..session import cut
from . import named as N
from .base import CORE, load_graph, sql, table_of

Graph = dict[str, DataFrame]


# ------------------------------------------------------------------- closures
def upstream(g: Graph, cols: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Columns the given ones (node) are made from, with least distance."""
    return C.closure(g["column_lineage"], cols, max_depth, src="dst_key", dst="src_key")


def downstream(g: Graph, cols: DataFrame, max_depth: int | None = None) -> DataFrame:
    return C.closure(g["column_lineage"], cols, max_depth)


def downstream_with_consumers(g: Graph, cols: DataFrame, max_depth: int | None = None) -> DataFrame:
    """downstream() and, as last nodes, the external consumers of its tables."""
    d = cut(downstream(g, cols, max_depth), "down")
    t = d.join(g["sql_column"].select(F.col("id").alias("node"), "table_qualified"), "node").groupBy("table_qualified").agg(F.min("depth").alias("depth"))
    e = t.join(N.external_consumers(g), "table_qualified").groupBy("name").agg((F.min("depth") + 1).alias("depth"))
    return d.select("node", "depth", F.lit("column").alias("what")).unionByName(e.select(F.col("name").alias("node"), "depth", F.lit("consumer").alias("what")))


def trace(g: Graph, cols: DataFrame, max_depth: int | None = None, view: str = "structural") -> DataFrame:
    """Edges upstream of cols with provenance: view 'structural' leaves inlined
    temp edges out, 'source_to_sink' follows only them."""
    inline = F.col("transform").eqNullSafe(F.lit("TEMP_INLINE"))
    e = g["column_lineage"].where(inline if view == "source_to_sink" else ~inline)
    seen = C.closure(e, cols, max_depth, src="dst_key", dst="src_key", keep_start=True).select(F.col("node").alias("_n"), "depth")
    if max_depth is not None:
        seen = seen.where(F.col("depth") < max_depth)
    j = e.join(seen, F.col("dst_key") == F.col("_n"))
    q = g["sql_query"].select(F.col("id").alias("query_id"), F.col("file_path").alias("file"), F.col("start_line").alias("line"))
    j = j.join(q, "query_id", "left")
    return j.select("src_key", "dst_key", (F.col("depth") + 1).alias("depth"), "transform", "confidence", "file", "line", X.assertion(F.col("confidence")).alias("assertion"), X.reason(F.col("transform"), F.col("confidence")).alias("reason"))


def rollup(g: Graph, cols: DataFrame) -> DataFrame:
    """Owning tables of columns (node): table_qualified, n_columns, depth."""
    c = g["sql_column"].select(F.col("id").alias("node"), "table_qualified")
    return cols.join(c, "node").groupBy("table_qualified").agg(F.count(F.lit(1)).alias("n_columns"), F.min("depth").alias("depth"))


def real_tables(g: Graph, tables: DataFrame, col: str = "table_qualified", noise: bool = True) -> DataFrame:
    """Without synthetic tables (cte, derived, temp) and noise."""
    syn = g["sql_table"].where(F.col("kind").isin(*SYNTHETIC)).select(F.col("qualified").alias("_s"))
    out = tables.join(syn, F.col(col) == F.col("_s"), "left_anti")
    return out.where(~X.is_noise(F.col(col))) if noise else out


def split_synthetic(g: Graph, tables: DataFrame) -> DataFrame:
    syn = g["sql_table"].where(F.col("kind").isin(*SYNTHETIC)).select(F.col("qualified").alias("_s"))
    return tables.join(syn, F.col("table_qualified") == F.col("_s"), "left").withColumn("synthetic", F.col("_s").isNotNull()).drop("_s")


def columns_of(g: Graph, tables: DataFrame) -> DataFrame:
    """Start nodes: the columns of tables (one column, table_qualified)."""
    return N.columns_of(g, tables).select(F.col("col_id").alias("node"))


def lineage_adjacency(g: Graph) -> DataFrame:
    """Edges between real tables by column lineage, synthetic ones contracted."""
    e = N.table_adjacency(g).select(F.col("upstream_table").alias("src"), F.col("downstream_table").alias("dst"))
    return C.contract(e, _synthetic(g))


def _synthetic(g: Graph) -> DataFrame:
    return g["sql_table"].where(F.col("kind").isin(*SYNTHETIC)).select(F.col("qualified").alias("node"))


def scope_lists(g: Graph, tables: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(what, name): all that a change of tables touches. what is 'file' (where
    they are defined or written), 'upstream' (tables they are written from),
    'column' and 'table' (made from them, noise and synthetic tables left out),
    or 'gating_join' (tables that lose rows with them, through reads and joins,
    also without a column of theirs)."""
    src = tables.select(F.col(tables.columns[0]).alias("_t"))
    hit = cut(downstream(g, columns_of(g, tables), max_depth), "hit")
    owner = g["sql_column"].select(F.col("id").alias("node"), "table_qualified")
    cols = real_tables(g, hit.join(owner, "node")).join(src, F.col("table_qualified") == F.col("_t"), "left_anti")
    cols = cut(cols.select("node", "table_qualified"), "affected")
    files = N.defining_files(g, tables).select("file_path").union(N.producer_files(g, tables).select("file_path"))
    up = N.direct_upstreams(g, tables).select(F.col("upstream_table").alias("table_qualified"))
    up = up.where(~X.is_noise(F.col("table_qualified")))
    gate = real_tables(g, row_reachability(g, tables), noise=False)
    parts = {"file": files, "upstream": up, "column": cols.select("node"), "table": cols.select("table_qualified"), "gating_join": gate.select("table_qualified")}
    out = None
    for what, df in parts.items():
        one = df.select(F.lit(what).alias("what"), F.col(df.columns[0]).alias("name")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def change_scope(g: Graph, tables: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row: how much of each kind scope_lists() has, with a risk label."""
    n = lambda k: F.count(F.when(F.col("what") == k, F.lit(1)))
    a = scope_lists(g, tables, max_depth).agg(n("table").alias("n_tables"), n("column").alias("n_columns"), n("upstream").alias("n_upstreams"), n("file").alias("n_files"), n("gating_join").alias("n_gating"))
    return a.withColumn("risk", X.risk_label(F.col("n_tables")))


def backfill_levels(g: Graph, tables: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(table_qualified, level, in_cycle) of tables and all real ones behind
    them: the order in which to fill them again."""
    hit = cut(downstream(g, columns_of(g, tables), max_depth), "hit")
    t = real_tables(g, rollup(g, hit)).select(F.col("table_qualified").alias("node")).union(tables.select(tables.columns[0])).distinct()
    lv = C.levels(t, lineage_adjacency(g))
    return lv.select(F.col("node").alias("table_qualified"), "level", "in_cycle")


def row_reachability(g: Graph, tables: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Tables that lose rows when tables are empty: over reads, synthetic ones
    contracted, sources left out."""
    e = N.reads_adjacency(g).select(F.col("source_table").alias("src"), F.col("dest_table").alias("dst"))
    e = C.contract(e, _synthetic(g))
    start = tables.select(F.col(tables.columns[0]).alias("node"))
    return C.closure(e, start, max_depth, src="src", dst="dst").select(F.col("node").alias("table_qualified"), "depth")


def empty_by_source(g: Graph, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What becomes empty with each of sources (one column) by itself: source,
    table_qualified, value_state ('full' when all its known columns are
    affected, 'partial', or null when it only loses rows), row_empty. A source
    is not reported as its own effect."""
    src = sources.select(F.col(sources.columns[0]).alias("source")).where(F.col("source").isNotNull()).distinct()
    start = N.columns_of(g, src).select(F.col("table_qualified").alias("source"), F.col("col_id").alias("node"))
    hit = cut(C.closure(g["column_lineage"], start, max_depth, by=["source"]), "hit")
    owner = g["sql_column"].select(F.col("id").alias("node"), "table_qualified")
    val = real_tables(g, hit.join(owner, "node").select("source", "table_qualified").distinct()).where("source <> table_qualified")
    # a table's columns and those of them that are hit, counted and compared
    hc = g["has_column"].select(F.col("src_key").alias("table_qualified"), F.col("dst_key").alias("node"))
    have = hc.groupBy("table_qualified").agg(F.count(F.lit(1)).alias("have"))
    got = hit.join(hc, "node").groupBy("source", "table_qualified").agg(F.count(F.lit(1)).alias("got"))
    val = val.join(have, "table_qualified", "left").join(got, ["source", "table_qualified"], "left")
    val = cut(val.select("source", "table_qualified", F.when(F.coalesce(F.col("have") == F.col("got"), F.lit(False)), "full").otherwise("partial").alias("value_state")), "values")
    e = C.contract(N.reads_adjacency(g).select(F.col("source_table").alias("src"), F.col("dest_table").alias("dst")), _synthetic(g))
    rows = C.closure(e, src.select("source", F.col("source").alias("node")), max_depth, src="src", dst="dst", by=["source"])
    rows = real_tables(g, rows.select("source", F.col("node").alias("table_qualified")))
    every = rows.unionByName(val.select("source", "table_qualified")).distinct()
    return every.join(val, ["source", "table_qualified"], "left").select("source", "table_qualified", "value_state", F.lit(True).alias("row_empty"))


def empty_propagation(g: Graph, tables: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What becomes empty with tables taken together: table_qualified,
    value_state ('full' when all its known columns are affected, 'partial', or
    null), row_empty."""
    src = tables.select(F.col(tables.columns[0]).alias("_src")).distinct()
    hit = cut(downstream(g, columns_of(g, tables), max_depth), "hit")
    val = real_tables(g, rollup(g, hit)).join(src, F.col("table_qualified") == F.col("_src"), "left_anti")
    hc = g["has_column"].select(F.col("src_key").alias("table_qualified"), F.col("dst_key").alias("node"))
    have = hc.groupBy("table_qualified").agg(F.count(F.lit(1)).alias("have"))
    got = hit.join(hc, "node").groupBy("table_qualified").agg(F.count(F.lit(1)).alias("got"))
    val = val.join(have, "table_qualified", "left").join(got, "table_qualified", "left")
    val = cut(val.select("table_qualified", F.when(F.coalesce(F.col("have") == F.col("got"), F.lit(False)), "full").otherwise("partial").alias("value_state")), "values")
    rows = real_tables(g, row_reachability(g, tables, max_depth)).select("table_qualified").unionByName(val.select("table_qualified")).distinct()
    return rows.join(val, "table_qualified", "left").select("table_qualified", "value_state", F.lit(True).alias("row_empty"))


def propagation_order(g: Graph, tables: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(table_qualified, level, in_cycle) of what empty_propagation() names: the
    order in which the loss travels."""
    hit = empty_propagation(g, tables, max_depth).select(F.col("table_qualified").alias("node"))
    lv = C.levels(hit, lineage_adjacency(g))
    return lv.select(F.col("node").alias("table_qualified"), "level", "in_cycle")


def find_usages(g: Graph, names: DataFrame | None = None) -> DataFrame:
    """Queries that use a table: read directly, else by lineage or a star."""
    a = N.table_usages(g, names).select("name", "file", "sql", "kind").distinct().withColumn("how", F.lit("direct"))
    b = N.usages_via_lineage(g, names)
    t = N._only(g["sql_table"], "name", names).select("name", F.col("qualified").alias("dst_key"))
    s = g["star_source"].join(t, "dst_key").select("name", F.col("src_key").alias("qid")).join(N._q(g, "sql", "kind"), "qid").join(N._query_files(g), "qid").select("name", "file", "sql", "kind")
    b = b.unionByName(s).distinct().join(a.select("name", "file", "sql"), ["name", "file", "sql"], "left_anti").withColumn("how", F.lit("via_lineage"))
    return a.unionByName(b)


def find_definition(g: Graph, tables: DataFrame | None = None, backup: str = r"(?i)(_bck|_bck_.*|_backup|_backup_.*)\.sql$") -> DataFrame:
    """Definitions with a backup flag; authoritative if it is the only one."""
    d = N.definitions(g, tables)
    n = d.groupBy("table_qualified").agg(F.count(F.lit(1)).alias("_n"))
    is_backup = F.col("file_path").rlike(backup)
    return d.join(n, "table_qualified").select("table_qualified", "kind", "file_path", is_backup.alias("is_backup"), (~is_backup & (F.col("_n") == 1)).alias("authoritative"))


def changed_tables(g: Graph, files: DataFrame) -> DataFrame:
    """Tables that files define or write."""
    own = N.tables_in_files(g, files).select("table_qualified").union(N.targets_of_files(g, files).select("table_qualified"))
    return cut(own.distinct(), "own")


def diff_order(g: Graph, files: DataFrame, presentation: tuple[str, ...] = ("mart.", "rpt.")) -> DataFrame:
    """(table_qualified, level, in_cycle, presentation): the order in which to
    rebuild the tables affected by a change of files, and which people read."""
    own = changed_tables(g, files)
    t = real_tables(g, rollup(g, downstream(g, columns_of(g, own)))).select("table_qualified").join(own, "table_qualified", "left_anti")
    lv = C.levels(t.select(F.col("table_qualified").alias("node")), lineage_adjacency(g))
    p = F.lit(False)
    for x in presentation:
        p = p | F.col("node").startswith(x)
    return lv.select(F.col("node").alias("table_qualified"), "level", "in_cycle", p.alias("presentation"))


def diff_gating(g: Graph, files: DataFrame) -> DataFrame:
    """Tables that lose rows with those a change of files touches, by joins too."""
    return row_reachability(g, changed_tables(g, files))


def diff_impact(g: Graph, files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Tables affected by a change of files, those the files touch at depth 0,
    with external consumers counted."""
    own = changed_tables(g, files)
    hit = downstream(g, columns_of(g, own), max_depth)
    t = real_tables(g, rollup(g, hit)).join(own.select(F.col("table_qualified").alias("_t")), F.col("table_qualified") == F.col("_t"), "left_anti").select("table_qualified", "depth")
    t = own.select("table_qualified", F.lit(0).alias("depth")).unionByName(t)
    c = N.external_consumers(g).groupBy("table_qualified").agg(F.count(F.lit(1)).alias("n"))
    return t.join(c, "table_qualified", "left").select("table_qualified", "depth", F.coalesce("n", F.lit(0)).alias("n_consumers"))


def analyze_unused(g: Graph, presentation: tuple[str, ...] = ("mart.", "rpt.")) -> DataFrame:
    """Unused tables but noise: presentation-layer ones may be read outside."""
    u = N.unused_tables(g).where(~X.is_noise(F.col("table_qualified")))
    p = F.lit(False)
    for x in presentation:
        p = p | F.col("table_qualified").startswith(x)
    c = g["consumed_by"].select(F.col("src_key").alias("_c")).distinct()
    u = u.join(c, F.col("table_qualified") == F.col("_c"), "left")
    return u.select("table_qualified", F.when(p, "presentation").otherwise("dead_code").alias("what"), F.col("_c").isNotNull().alias("has_consumer"), F.lit("heuristic").alias("assertion"), F.lit(0.5).alias("confidence"))


# ----------------------------------------------------------- two states of it
def similar_sets(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(left, right, score) of sets (key, item) with Jaccard >= least. Items are
    ranked by rarity; two sets that similar share an item among the first
    |x| - ceil(least * |x|) + 1 of each, so only those are joined, and common
    items hardly ever are."""
    a, b = a.select("key", "item").distinct(), b.select("key", "item").distinct()
    freq = a.unionByName(b).groupBy("item").agg(F.count(F.lit(1)).alias("f"))

    def heads(x: DataFrame) -> DataFrame:
        s = x.join(freq, "item").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("s"))
        s = s.withColumn("n", F.size("s"))
        k = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
        return s.select("key", F.transform("s", lambda v: v["item"]).alias("items"), F.slice(F.transform("s", lambda v: v["item"]), F.lit(1), k.cast("int")).alias("head"))

    x, y = heads(a), heads(b)
    p = x.select(F.col("key").alias("left"), F.explode("head").alias("item")).join(y.select(F.col("key").alias("right"), F.explode("head").alias("item")), "item").select("left", "right").distinct()
    p = p.join(x.select(F.col("key").alias("left"), F.col("items").alias("l")), "left").join(y.select(F.col("key").alias("right"), F.col("items").alias("r")), "right")
    return p.select("left", "right", X.jaccard(F.col("l"), F.col("r")).alias("score")).where(F.col("score") >= least)


def lost_producers(base: Graph, head: Graph, least: float = 0.6) -> DataFrame:
    """(lost_table, renamed_to): tables written in base and no more in head;
    renamed when a newly written real table agrees in columns and in consumers
    (both Jaccard >= least). In name order the first match wins, and a new table
    is taken once."""
    before, after = N.producer_tables(base), N.producer_tables(head)
    lost = before.join(after, "producer_table", "left_anti").select(F.lower("producer_table").alias("t")).distinct()
    new = real_tables(head, after.join(before, "producer_table", "left_anti").select(F.lower("producer_table").alias("table_qualified")).distinct(), noise=False).select(F.col("table_qualified").alias("t"))
    cols = lambda g: g["has_column"].select(F.lower("src_key").alias("key"), F.element_at(F.split("dst_key", r"\."), -1).alias("item"))
    cons = lambda g: N.reads_adjacency(g).select(F.lower("source_table").alias("key"), F.lower("dest_table").alias("item"))
    only = lambda s, who: s.join(who.select(F.col("t").alias("key")), "key", "left_semi")
    a = similar_sets(only(cols(base), lost), only(cols(head), new), least).select("left", "right")
    b = similar_sets(only(cons(base), lost), only(cons(head), new), least).select("left", "right")
    pairs = cut(a.join(b, ["left", "right"]), "renames")
    taken: DataFrame | None = None
    while True:  # greedy in name order: each round settles at least one table
        free = pairs if taken is None else pairs.join(taken.select("left"), "left", "left_anti").join(taken.select("right"), "right", "left_anti")
        want = free.groupBy("left").agg(F.min("right").alias("right"))
        got = want.groupBy("right").agg(F.min("left").alias("left")).select("left", "right")
        # a table may go ahead only if no smaller one could still want its match
        rival = free.select(F.col("left").alias("_l"), "right").join(got, "right").where("_l < left").select("right")
        got = cut(got.join(rival, "right", "left_anti"), "renamed")
        if got.isEmpty():
            break
        taken = got if taken is None else cut(taken.unionByName(got), "renamed")
    if taken is None:
        return lost.select(F.col("t").alias("lost_table"), F.lit(None).cast("string").alias("renamed_to"))
    return lost.join(taken, F.col("t") == F.col("left"), "left").select(F.col("t").alias("lost_table"), F.col("right").alias("renamed_to"))


def _lost(base: Graph, head: Graph) -> DataFrame:
    return cut(lost_producers(base, head).where("renamed_to is null").select(F.col("lost_table").alias("table_qualified")), "lost")


def pr_impact(base: Graph, head: Graph, max_depth: int | None = None) -> DataFrame:
    """Per genuinely lost producer, by empty propagation on the base graph: the
    first file that wrote it and how many did, the tables whose rows or values
    it takes along, those of them that lose all and some of their columns'
    values, and the risk by all tables reached."""
    lost = _lost(base, head)
    files = N.producer_files(base, lost).groupBy("table_qualified").agg(F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("n_files"))
    n = lambda c: F.count(F.when(c, F.lit(1)))
    hit = empty_by_source(base, lost, max_depth).groupBy(F.col("source").alias("table_qualified")).agg(
        F.count(F.lit(1)).alias("n_tables"), n(F.col("value_state") == "full").alias("n_full"), n(F.col("value_state") == "partial").alias("n_partial")
    )
    out = lost.join(files, "table_qualified", "left").join(hit, "table_qualified", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_tables", "n_full", "n_partial")]
    return out.select("table_qualified", "file_path", *zero).withColumn("risk", X.risk_label(F.col("n_tables")))


def pr_blast(base: Graph, head: Graph, max_depth: int | None = None) -> DataFrame:
    """The effects of all genuinely lost producers united: per table how many of
    them reach it, whether one takes all (fully) or some (partially) of its
    columns' values along, and its place in the order in which the loss travels."""
    hit = empty_by_source(base, _lost(base, head), max_depth).groupBy("table_qualified").agg(
        F.count(F.lit(1)).alias("n_lost"), F.max(F.coalesce(F.col("value_state") == "full", F.lit(False))).alias("fully"), F.max(F.coalesce(F.col("value_state") == "partial", F.lit(False))).alias("partially")
    )
    hit = cut(hit, "blast")
    lv = C.levels(hit.select(F.col("table_qualified").alias("node")), lineage_adjacency(base))
    return hit.join(lv.withColumnRenamed("node", "table_qualified"), "table_qualified")


# ------------------------------------------------------------------- the rest
def db_info(g: Graph) -> DataFrame:
    rows = None
    for k in ("repo", "file", "sql_table", "sql_column", "sql_query", "column_lineage", "selects_from", "star_source"):
        r = g[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n")
        rows = r if rows is None else rows.unionByName(r)
    modes = g["sql_query"].groupBy("parsing_mode").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("mode:"), F.coalesce("parsing_mode", F.lit("unknown"))).alias("what"), "n")
    return rows.unionByName(modes)


#: Row limit of free queries.
SQL_LIMIT = 500


def execute_sql(spark: SparkSession, g: Graph, query: str, limit: int = SQL_LIMIT) -> DataFrame:
    """A free query over the graph's relations as views. Only a single query is
    let through - its parsed plan decides, not its words - and it is limited to
    `limit` rows unless it has a limit of its own."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    names, todo = [], [plan]
    while todo:
        p = todo.pop()
        names.append(p.getClass().getSimpleName())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    writes = ("Command", "Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Replace", "Truncate", "Set", "Cache", "Refresh", "Load", "Compound", "Execute", "Call", "Add", "Rename", "Comment", "Analyze", "Repair")
    if any(n.startswith(writes) or n.endswith("Command") for n in names if not n.startswith("SetOperation")) or "UnresolvedTableValuedFunction" in names and re.search(r"(?i)\bread_files\b", query):
        raise ValueError("only queries are allowed")
    # the caller's own views of these names come back once the query is resolved
    own = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in g}
    for k, df in g.items():
        df.createOrReplaceTempView(k)
    try:
        out = spark.sql(query)
    finally:
        for k in g:
            if k in own:
                own[k].createOrReplaceTempView(k)
            else:
                spark.catalog.dropTempView(k)
    return out if {"GlobalLimit", "LocalLimit"} & set(names) else out.limit(limit)


def analyze(g: Graph, cols: DataFrame, up: bool, depth: int = 5, kinds: tuple[str, ...] | None = ("table", "external"), limit: int | None = 100) -> DataFrame:
    """What the command line lists: reached columns with the first file and line
    that read (upstream) or write them, tables of other kinds left out unless
    kinds is None; ordered by name, first `limit` rows."""
    if not 1 <= depth <= 100:
        raise ValueError("depth is 1 to 100")
    d = (upstream if up else downstream)(g, cols, depth).select(F.col("node").alias("id"))
    c = g["sql_column"].select("id", "table_qualified")
    key = "src_key" if up else "dst_key"
    # several edges, one row: smallest file and line over all of them
    e = g["column_lineage"].select(F.col(key).alias("id"), F.col("query_id").alias("qid")).join(N._q(g, "file_path", "start_line"), "qid").groupBy("id").agg(F.min("file_path").alias("file"), F.min("start_line").alias("line"))
    out = d.join(c, "id").join(e, "id", "left")
    if kinds is not None:
        k = g["sql_table"].select(F.col("qualified").alias("table_qualified"), "kind")
        out = out.join(k, "table_qualified", "left").where(F.col("kind").isNull() | F.col("kind").isin(*kinds))
    out = out.select("id", "table_qualified", "file", "line")
    return out if limit is None else out.orderBy("id").limit(limit)


def impact(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    """Queries that consume a table, each once: direct reads first."""
    t = None if tables is None else tables.select(F.lower(F.col(tables.columns[0])).alias("t"))
    sf = N._only(g["selects_from"], "dst_key", t).select(F.col("dst_key").alias("table_qualified"), F.col("src_key").alias("qid"))
    a = sf.join(N._q(g, "kind", "target_table"), "qid").select("table_qualified", F.col("qid").alias("id"), "kind", F.col("target_table").alias("target"), F.lit("direct").alias("how"))
    b = N.consumers_via_lineage(g, t).join(a.select("table_qualified", "id"), ["table_qualified", "id"], "left_anti").withColumn("how", F.lit("via_lineage"))
    return a.unionByName(b)


def failures(g: Graph) -> DataFrame:
    return g["file"].where("parse_failed").select("path", "dialect", F.coalesce("parse_cause", F.lit("")).alias("parse_cause"))


def find_like(g: Graph, what: str, text: str, limit: int | None = 50) -> DataFrame:
    """Tables, columns or query texts that contain text literally."""
    rel, col = {"table": ("sql_table", "qualified"), "column": ("sql_column", "id"), "pattern": ("sql_query", "sql")}[what]
    key = {"table": "qualified", "column": "id", "pattern": "id"}[what]
    out = g[rel].where(F.contains(F.lower(col), F.lit(text.lower()))).select(F.col(key).alias("key"))
    return out if limit is None else out.orderBy("key").limit(limit)


def viz_links(g: Graph) -> DataFrame:
    """Table-to-table links with multiplicity, self-loops left out."""
    q = N._q(g, "target_table").where("target_table <> ''")
    reads = g["selects_from"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("s")).unionByName(g["star_source"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("s")))
    a = reads.join(q, "qid").groupBy(F.col("s").alias("source"), F.col("target_table").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    b = g["column_lineage"].groupBy(table_of("src_key").alias("source"), table_of("dst_key").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    u = a.unionByName(b).where("source <> '' and target <> '' and source <> target")
    return u.groupBy("source", "target").agg(F.sum("n").alias("n"))


def viz_nodes(g: Graph) -> DataFrame:
    """Tables with the number of distinct neighbours and whether the catalog
    has columns of them."""
    l = viz_links(g).select("source", "target")
    both = l.unionByName(l.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    deg = both.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    cat = g["has_column"].select(F.col("src_key").alias("id"), F.lit(True).alias("c")).distinct()
    t = g["sql_table"].select(F.col("qualified").alias("id"), F.col("db").alias("schema"), "kind")
    return t.join(deg, "id", "left").join(cat, "id", "left").select("id", "schema", "kind", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("c", F.lit(False)).alias("cat"))


def mermaid(edges: DataFrame, limit: int = 500) -> str:
    """A flowchart of at most `limit` edges (src_key, dst_key, transform), for
    people: nodes numbered in name order."""
    rows = edges.select("src_key", "dst_key", F.coalesce("transform", F.lit("")).alias("t")).distinct().orderBy("src_key", "dst_key", "t").limit(limit).collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({r[0] for r in rows} | {r[1] for r in rows}))}
    esc = lambda s: s.replace('"', "#quot;")
    return "\n".join(["flowchart LR", *[f'  {i}["{esc(n)}"]' for n, i in ids.items()], *[f'  {ids[a]} -->|{t}| {ids[b]}' if t else f"  {ids[a]} --> {ids[b]}" for a, b, t in rows]])


# --------------------------------------------------------- over the test data
def _busiest(g: Graph) -> DataFrame:
    """The table whose columns feed most edges."""
    n = g["column_lineage"].groupBy(table_of("src_key").alias("table_qualified")).agg(F.count(F.lit(1)).alias("n"))
    n = n.join(g["sql_table"].select(F.col("qualified").alias("table_qualified")), "table_qualified", "left_semi")
    return n.orderBy(F.desc("n"), "table_qualified").limit(1).select("table_qualified")


def _with_seed(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = load_graph(spark, d, settled=CORE)
        return f(g, cut(_busiest(g), "seed"))

    return run


def _states(spark: SparkSession, d: str) -> tuple[Graph, Graph]:
    """Two states: base has the queries first seen in the first half of the
    time, head those of the second half, as after a rewrite of everything."""
    head = load_graph(spark, d, settled=CORE)
    q = spark.read.parquet(f"{d}/sql_query.parquet").where(F.col("id").isNotNull())
    lo, hi = q.agg(F.min("indexed_at"), F.max("indexed_at")).first()
    half = F.lit(lo + (hi - lo) / 2 if lo else None)
    first = q.groupBy("id").agg(F.min(F.struct("indexed_at", "target_table", "file_path")).alias("r")).select("id", "r.indexed_at", "r.target_table", "r.file_path")

    def state(rows: DataFrame) -> Graph:
        g = dict(head)
        g["sql_query"] = rows.drop("indexed_at")
        g["query_defined_in"] = rows.where(F.col("file_path").isNotNull()).select(F.col("id").alias("src_key"), F.col("file_path").alias("dst_key"))
        return g

    return state(first.where(F.col("indexed_at") <= half)), state(first.where(F.col("indexed_at") > half))


def producer_diff(base: Graph, head: Graph) -> DataFrame:
    """(producer_table, side): written in only one of two states."""
    a, b = N.producer_tables(base), N.producer_tables(head)
    lost = a.join(b, "producer_table", "left_anti").withColumn("side", F.lit("lost"))
    return lost.unionByName(b.join(a, "producer_table", "left_anti").withColumn("side", F.lit("new")))


def _plan(f, *args, **kw):
    return lambda spark, d: f(load_graph(spark, d), *args, **kw)


def _seed_cols(g: Graph, t: DataFrame) -> DataFrame:
    return columns_of(g, t)


def _hub_cols(g: Graph) -> DataFrame:
    """The column most edges lead to."""
    n = g["column_lineage"].groupBy("dst_key").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "dst_key").limit(1).select(F.col("dst_key").alias("node"))


def _noise(g: Graph) -> DataFrame:
    q = F.col("qualified")
    return g["sql_table"].select(q.alias("table_qualified"), X.is_noise(q, ["*_daily_*", "*_hist_*"], ["ref.tax_band"], ["^lake\\.rpt\\."]).alias("is_noise"), X.short_name(q).alias("short_name"))


def _reasons(g: Graph) -> DataFrame:
    e = g["column_lineage"].groupBy("transform", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return e.select("transform", "confidence", "n", X.reason(F.col("transform"), F.col("confidence")).alias("reason"), X.assertion(F.col("confidence")).alias("assertion"))


def _refs(g: Graph) -> DataFrame:
    r = F.col("src_key")
    e = g["column_lineage"].select("src_key").distinct()
    return e.select("src_key", X.ref_table(r).alias("table_id"), X.ref_column(r).alias("column_name"), X.bare_ref(r).alias("bare"))


QUERIES = {
    "g01_trace": lambda s, d: (lambda g: trace(g, cut(_hub_cols(g), "seed")))(load_graph(s, d)),
    "g01_trace_source_to_sink": lambda s, d: (lambda g: trace(g, cut(_hub_cols(g), "seed"), view="source_to_sink"))(load_graph(s, d)),
    "g02_upstream": lambda s, d: (lambda g: upstream(g, cut(_hub_cols(g), "seed")))(load_graph(s, d)),
    "g03_downstream_with_consumers": _with_seed(lambda g, t: downstream_with_consumers(g, _seed_cols(g, t))),
    "g04_closure": _with_seed(lambda g, t: downstream(g, _seed_cols(g, t))),
    "g05_rollup": _with_seed(lambda g, t: rollup(g, downstream(g, _seed_cols(g, t)))),
    "g06_split_synthetic": _with_seed(lambda g, t: split_synthetic(g, rollup(g, downstream(g, _seed_cols(g, t))))),
    "g07_contracted_reads": _plan(lambda g: C.contract(N.reads_adjacency(g).select(F.col("source_table").alias("src"), F.col("dest_table").alias("dst")), _synthetic(g))),
    "g08_levels": _plan(lambda g: C.levels(N.reads_adjacency(g).select(F.explode(F.array("source_table", "dest_table")).alias("node")), N.reads_adjacency(g).select(F.col("source_table").alias("src"), F.col("dest_table").alias("dst")))),
    "g09_row_reachability": lambda s, d: (lambda g: row_reachability(g, cut(N.hub_ranking(g, 1).select("table_qualified"), "seed")))(load_graph(s, d, settled=CORE)),
    "g10_find_usages": lambda s, d: find_usages(load_graph(s, d, texts=True)),
    "g11_find_definition": _plan(find_definition),
    "g12_change_scope": _with_seed(lambda g, t: change_scope(g, t)),
    "g13_backfill_levels": _with_seed(lambda g, t: backfill_levels(g, t)),
    "g14_diff_impact": lambda s, d: (lambda g: diff_impact(g, g["file"].where("parse_failed").select("path")))(load_graph(s, d, settled=CORE)),
    "g14_diff_order": lambda s, d: (lambda g: diff_order(g, g["file"].where("parse_failed").select("path")))(load_graph(s, d, settled=CORE)),
    "g14_diff_gating": lambda s, d: (lambda g: diff_gating(g, g["file"].where("parse_failed").select("path")))(load_graph(s, d, settled=CORE)),
    "g16_analyze_unused": _plan(analyze_unused),
    "g17_hub_without_noise": _plan(lambda g: N.hub_ranking(g, 10, g["sql_table"].where(X.is_noise(F.col("qualified"), ["*_code"])).select("qualified"))),
    "g12_scope_lists": _with_seed(lambda g, t: scope_lists(g, t)),
    "g18_propagation_order": _with_seed(lambda g, t: propagation_order(g, t)),
    "g18_empty_propagation": _with_seed(lambda g, t: empty_propagation(g, t)),
    "g19_producer_diff": lambda s, d: producer_diff(*_states(s, d)),
    "g19_lost_producers": lambda s, d: lost_producers(*_states(s, d)),
    "g20_pr_impact": lambda s, d: pr_impact(*_states(s, d)),
    "g20_pr_blast": lambda s, d: pr_blast(*_states(s, d)),
    "g25_db_info": _plan(db_info),
    "g26_execute_sql": lambda s, d: execute_sql(s, load_graph(s, d, texts=True), "SELECT kind, count(*) AS n FROM sql_table GROUP BY kind"),
    "g29_analyze_downstream": _with_seed(lambda g, t: analyze(g, _seed_cols(g, t), False)),
    "g29_analyze_upstream": lambda s, d: (lambda g: analyze(g, cut(_hub_cols(g), "seed"), True, kinds=None))(load_graph(s, d)),
    "g30_impact": _plan(impact),
    "g31_failures": _plan(failures),
    "g34_find_table": _plan(find_like, "table", "day"),
    "g34_find_column": _plan(find_like, "column", "flag", None),
    "g34_find_pattern": lambda s, d: find_like(load_graph(s, d, texts=True), "pattern", "Hold back", None),
    "g35_noise": _plan(_noise),
    "g37_viz_links": _plan(viz_links),
    "g37_viz_nodes": _plan(viz_nodes),
    "g38_reasons": _plan(_reasons),
    "g40_column_refs": _plan(_refs),
}

_T = "regexp_replace({}, '\\.?[^.]*$', '')"
_SEED = f""", seed AS (SELECT table_qualified FROM (SELECT {_T.format('src_key')} AS table_qualified, count(*) n FROM lineage_ GROUP BY 1) x
 WHERE EXISTS (SELECT 1 FROM table_ t WHERE t.qualified = x.table_qualified) ORDER BY n DESC, table_qualified LIMIT 1),
 scol AS (SELECT c.id AS node FROM seed s JOIN has_ h ON h.src_key = s.table_qualified JOIN column_ c ON c.id = h.dst_key),
 le AS (SELECT DISTINCT src_key, dst_key FROM lineage_)
"""
_HUB = ", hub AS (SELECT dst_key AS node FROM (SELECT dst_key, count(*) n FROM lineage_ GROUP BY 1) ORDER BY n DESC, dst_key LIMIT 1)\n"


def _reach(name: str, start: str, edges: str, src: str, dst: str, depth: int | None = None) -> str:
    """name(node, depth): least distances of what is reached, start nodes left
    out; name_r has them as well."""
    lim = f" AND r.depth < {depth}" if depth else ""
    new = f"SELECT e.{dst}, min(r.depth + 1) FROM {name}_r r JOIN {edges} e ON e.{src} = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.{name}_r q WHERE q.node = e.{dst}){lim} GROUP BY e.{dst}"
    return f", {name}_r(node, depth) USING KEY (node) AS (SELECT DISTINCT node, 0 AS depth FROM {start} UNION {new}), {name} AS (SELECT node, CAST(depth AS INTEGER) AS depth FROM {name}_r WHERE depth > 0)\n"


_NOISE = "regexp_matches(CASE WHEN contains({0}, '::') THEN string_split({0}, '::')[-1] ELSE string_split({0}, '.')[-1] END, '^(.*_bck|.*_bck_.*|.*_backup|.*_backup_[0-9].*)$')"
_ROLL = """, roll AS (SELECT c.table_qualified, count(*) AS n_columns, min(x.depth) AS depth FROM x JOIN column_ c ON c.id = x.node GROUP BY 1)\n"""
_REALS = f", realt AS (SELECT r.* FROM roll r WHERE NOT EXISTS (SELECT 1 FROM table_ t WHERE t.qualified = r.table_qualified AND t.kind IN ('cte','derived','temp')) AND NOT {_NOISE.format('r.table_qualified')})\n"
_SYN = ", syn AS (SELECT qualified AS node FROM table_ WHERE kind IN ('cte','derived','temp'))\n"
_CONTR = """, te AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {rel} WHERE {a} <> {b}),
 walk AS (SELECT a, b FROM te WHERE a NOT IN (SELECT node FROM syn) UNION SELECT w.a, te.b FROM walk w JOIN te ON te.a = w.b WHERE w.b IN (SELECT node FROM syn)),
 con AS (SELECT DISTINCT a AS src, b AS dst FROM walk WHERE b NOT IN (SELECT node FROM syn) AND a <> b)\n"""
_READCON = N._READS + _SYN + _CONTR.format(a="source_table", b="dest_table", rel="reads_adj")
_ADJ = """, tadj AS (SELECT DISTINCT s.table_qualified AS u, d.table_qualified AS v FROM lineage_ cl JOIN column_ s ON s.id = cl.src_key JOIN column_ d ON d.id = cl.dst_key WHERE s.table_qualified <> d.table_qualified)\n"""
_X_ALL = _SEED + _reach("x", "scol", "le", "src_key", "dst_key") + _ROLL + _REALS
_TRACE = _HUB + ", te AS (SELECT * FROM lineage_ WHERE {cond})" + _reach("x", "hub", "te", "dst_key", "src_key") + """
SELECT e.src_key, e.dst_key, CAST(r.depth + 1 AS INTEGER) AS depth, e.transform, e.confidence, q.file_path AS file, q.start_line AS line,
 CASE WHEN e.confidence IS NULL OR e.confidence >= 1.0 THEN 'fact' ELSE 'heuristic' END AS assertion, {reason} AS reason
FROM x_r r JOIN te e ON e.dst_key = r.node LEFT JOIN query_ q ON q.id = e.query_id"""
_REASON = """CASE WHEN {0}confidence IS NULL OR {0}confidence >= 1.0 THEN NULL WHEN {0}transform = 'STAR_EXPANSION' AND round({0}confidence, 1) = 0.8 THEN 'star-expansion: columns inferred from source table schema'
 WHEN {0}transform = 'UNKNOWN' AND round({0}confidence, 1) = 0.5 THEN 'column not found in resolved schema' WHEN {0}transform IS NULL AND round({0}confidence, 1) = 0.3 THEN 'scripting-block fallback: column lineage approximate'
 WHEN {0}transform = 'UNKNOWN' AND round({0}confidence, 1) = 0.0 THEN 'lineage extraction failed at index time' ELSE printf('inferred edge (confidence=%.2f)', {0}confidence) END"""
_VIZ = f""", vl AS (SELECT source, target, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT r.dst_key AS source, q.target_table AS target FROM reads_ r JOIN query_ q ON q.id = r.src_key WHERE q.target_table <> ''
 UNION ALL SELECT s.dst_key, q.target_table FROM star_ s JOIN query_ q ON q.id = s.src_key WHERE q.target_table <> ''
 UNION ALL SELECT {_T.format('src_key')}, {_T.format('dst_key')} FROM lineage_) WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2)\n"""
_DIFF = """, own AS (SELECT d.src_key AS table_qualified FROM defined_ d JOIN table_ t ON t.qualified = d.src_key JOIN file_ f ON f.path = d.dst_key WHERE f.parse_failed
 UNION SELECT q.target_table FROM query_ q JOIN file_ f ON f.path = q.file_path WHERE f.parse_failed AND q.target_table <> ''),
 scol AS (SELECT DISTINCT c.id AS node FROM own s JOIN table_ t ON t.qualified = s.table_qualified JOIN has_ h ON h.src_key = s.table_qualified JOIN column_ c ON c.id = h.dst_key), le AS (SELECT DISTINCT src_key, dst_key FROM lineage_)\n"""

# levels: what is on a loop or behind one has none, the rest the longest way to it
_LEVELS = """, ed AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst AND src IN (SELECT node FROM {nodes}) AND dst IN (SELECT node FROM {nodes})),
 rr AS (SELECT src AS a, dst AS b FROM ed UNION SELECT rr.a, ed.dst FROM rr JOIN ed ON ed.src = rr.b),
 bad AS (SELECT DISTINCT a AS node FROM rr WHERE a = b UNION SELECT rr.b FROM rr WHERE rr.a IN (SELECT a FROM rr WHERE a = b)),
 lv AS (SELECT node, 0 AS level FROM {nodes} WHERE node NOT IN (SELECT dst FROM ed) UNION SELECT ed.dst, lv.level + 1 FROM lv JOIN ed ON ed.src = lv.node WHERE ed.dst NOT IN (SELECT node FROM bad)),
 lvl AS (SELECT node, CAST(max(level) AS INTEGER) AS level, false AS in_cycle FROM lv GROUP BY node UNION ALL SELECT DISTINCT node, CAST(NULL AS INTEGER), true FROM bad)\n"""
_STATES = """, f AS (SELECT id, arg_min(target_table, (indexed_at, target_table, file_path)) AS t, arg_min(file_path, (indexed_at, target_table, file_path)) AS p, min(indexed_at) AS i FROM sql_query WHERE id IS NOT NULL GROUP BY 1),
 half AS (SELECT min(indexed_at) + (max(indexed_at) - min(indexed_at)) / 2 AS h FROM sql_query),
 bq AS (SELECT id, t, p FROM f, half WHERE i <= h AND t <> ''), hq AS (SELECT id, t, p FROM f, half WHERE i > h AND t <> ''),
 rs AS (SELECT src_key, dst_key FROM reads_ UNION SELECT src_key, dst_key FROM star_),
 ba AS (SELECT DISTINCT rs.dst_key AS s, bq.t AS d FROM rs JOIN bq ON bq.id = rs.src_key), ha AS (SELECT DISTINCT rs.dst_key AS s, hq.t AS d FROM rs JOIN hq ON hq.id = rs.src_key),
 lost AS (SELECT DISTINCT lower(t) AS t FROM bq WHERE t NOT IN (SELECT t FROM hq)),
 new AS (SELECT DISTINCT lower(t) AS t FROM hq WHERE t NOT IN (SELECT t FROM bq) AND lower(t) NOT IN (SELECT qualified FROM table_ WHERE kind IN ('cte','derived','temp'))),
 cs AS (SELECT lower(src_key) AS t, list(DISTINCT string_split(dst_key, '.')[-1]) AS x FROM has_ GROUP BY 1), lc AS (SELECT lower(s) AS t, list(DISTINCT lower(d)) AS x FROM ba GROUP BY 1), nc AS (SELECT lower(s) AS t, list(DISTINCT lower(d)) AS x FROM ha GROUP BY 1),
 cand AS (SELECT lost.t AS l, new.t AS n FROM lost JOIN cs c1 ON c1.t = lost.t JOIN lc ON lc.t = lost.t, new JOIN cs c2 ON c2.t = new.t JOIN nc ON nc.t = new.t
  WHERE len(list_intersect(c1.x, c2.x))::DOUBLE / len(list_distinct(list_concat(c1.x, c2.x))) >= 0.6 AND len(list_intersect(lc.x, nc.x))::DOUBLE / len(list_distinct(list_concat(lc.x, nc.x))) >= 0.6),
 ord AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM lost),
 gr AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS t, CAST(NULL AS VARCHAR) AS n, CAST([] AS VARCHAR[]) AS taken
  UNION ALL SELECT o.k, o.t, z.n, CASE WHEN z.n IS NULL THEN gr.taken ELSE list_append(gr.taken, z.n) END FROM gr JOIN ord o ON o.k = gr.k + 1, LATERAL (SELECT min(c.n) AS n FROM cand c WHERE c.l = o.t AND NOT list_contains(gr.taken, c.n)) z),
 lp AS (SELECT t AS lost_table, n AS renamed_to FROM gr WHERE k > 0)\n"""
_SCOPE = _X_ALL + _reach("y", "(SELECT table_qualified AS node FROM seed)", "con", "src", "dst") + f""", scope_ AS (
 SELECT 'file' AS what, d.dst_key AS name FROM defined_ d JOIN file_ f ON f.path = d.dst_key JOIN table_ t ON t.qualified = d.src_key WHERE d.src_key IN (SELECT table_qualified FROM seed)
 UNION SELECT 'file', q.file_path FROM query_ q JOIN file_ f ON f.path = q.file_path WHERE q.target_table IN (SELECT table_qualified FROM seed)
 UNION SELECT 'upstream', sf.dst_key FROM query_ q JOIN reads_ sf ON sf.src_key = q.id JOIN table_ t ON t.qualified = sf.dst_key WHERE q.target_table IN (SELECT table_qualified FROM seed) AND sf.dst_key <> q.target_table AND NOT {_NOISE.format('sf.dst_key')}
 UNION SELECT 'column', x.node FROM x JOIN column_ c ON c.id = x.node JOIN realt r ON r.table_qualified = c.table_qualified WHERE r.table_qualified NOT IN (SELECT table_qualified FROM seed)
 UNION SELECT 'table', table_qualified FROM realt WHERE table_qualified NOT IN (SELECT table_qualified FROM seed)
 UNION SELECT 'gating_join', node FROM y WHERE node NOT IN (SELECT node FROM syn))\n"""
# what each lost table takes along: s its name, t the table, state of its values
_BLAST = f""", sc AS (SELECT lp.lost_table AS s, c.id AS node FROM lp JOIN table_ t ON t.qualified = lp.lost_table JOIN has_ h ON h.src_key = t.qualified JOIN column_ c ON c.id = h.dst_key WHERE lp.renamed_to IS NULL),
 le AS (SELECT DISTINCT src_key, dst_key FROM lineage_),
 ch AS (SELECT s, node FROM sc UNION SELECT ch.s, le.dst_key FROM ch JOIN le ON le.src_key = ch.node),
 hitc AS (SELECT s, node FROM ch EXCEPT SELECT s, node FROM sc),
 hc AS (SELECT src_key AS t, count(*) AS n FROM has_ GROUP BY 1), gc AS (SELECT x.s, h.src_key AS t, count(*) AS n FROM hitc x JOIN has_ h ON h.dst_key = x.node GROUP BY 1, 2),
 vt AS (SELECT DISTINCT x.s, c.table_qualified AS t FROM hitc x JOIN column_ c ON c.id = x.node WHERE c.table_qualified <> x.s),
 va AS (SELECT vt.s, vt.t, CASE WHEN hc.n = gc.n THEN 'full' ELSE 'partial' END AS state FROM vt LEFT JOIN hc ON hc.t = vt.t LEFT JOIN gc ON gc.s = vt.s AND gc.t = vt.t
  WHERE vt.t NOT IN (SELECT node FROM syn) AND NOT {_NOISE.format('vt.t')}),
 rc AS (SELECT lost_table AS s, lost_table AS t FROM lp WHERE renamed_to IS NULL UNION SELECT rc.s, con.dst FROM rc JOIN con ON con.src = rc.t),
 eff AS (SELECT a.s, a.t, va.state FROM (SELECT s, t FROM rc WHERE s <> t AND t NOT IN (SELECT node FROM syn) AND NOT {_NOISE.format('t')} UNION SELECT s, t FROM va) a LEFT JOIN va ON va.s = a.s AND va.t = a.t)\n"""

ORACLE = {k: sql(v) for k, v in {
    "g08_levels": N._READS + ", nd AS (SELECT source_table AS node FROM reads_adj UNION SELECT dest_table FROM reads_adj), re AS (SELECT source_table AS src, dest_table AS dst FROM reads_adj)" + _LEVELS.format(edges="re", nodes="nd") + "SELECT * FROM lvl",
    "g13_backfill_levels": _X_ALL + _ADJ + _SYN + _CONTR.format(a="u", b="v", rel="tadj") + ", nd AS (SELECT table_qualified AS node FROM realt UNION SELECT table_qualified FROM seed)" + _LEVELS.format(edges="con", nodes="nd") + "SELECT node AS table_qualified, level, in_cycle FROM lvl",
    "g19_lost_producers": _STATES + "SELECT * FROM lp",
    "g20_pr_impact": _STATES + _SYN + _CONTR.format(a="s", b="d", rel="ba") + _BLAST + """
SELECT table_qualified, file_path, n_files, n_tables, n_full, n_partial, CASE WHEN n_tables = 0 THEN 'safe' WHEN n_tables <= 5 THEN 'low' WHEN n_tables <= 20 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT lost_table AS table_qualified,
 (SELECT min(bq.p) FROM bq JOIN file_ ON file_.path = bq.p WHERE bq.t = lost_table) AS file_path, (SELECT count(DISTINCT bq.p) FROM bq JOIN file_ ON file_.path = bq.p WHERE bq.t = lost_table) AS n_files,
 coalesce(z.n, 0) AS n_tables, coalesce(z.f, 0) AS n_full, coalesce(z.p, 0) AS n_partial FROM lp LEFT JOIN
 (SELECT s, count(*) AS n, count(*) FILTER (state = 'full') AS f, count(*) FILTER (state = 'partial') AS p FROM eff GROUP BY s) z ON z.s = lost_table WHERE renamed_to IS NULL)""",
    "g20_pr_blast": _STATES + _SYN + _CONTR.format(a="s", b="d", rel="ba") + _BLAST + _ADJ + """, te2 AS (SELECT DISTINCT u AS a, v AS b FROM tadj WHERE u <> v),
 walk2 AS (SELECT a, b FROM te2 WHERE a NOT IN (SELECT node FROM syn) UNION SELECT w.a, te2.b FROM walk2 w JOIN te2 ON te2.a = w.b WHERE w.b IN (SELECT node FROM syn)),
 con2 AS (SELECT DISTINCT a AS src, b AS dst FROM walk2 WHERE b NOT IN (SELECT node FROM syn) AND a <> b), nd AS (SELECT DISTINCT t AS node FROM eff)""" + _LEVELS.format(edges="con2", nodes="nd") + """
SELECT e.t AS table_qualified, count(*) AS n_lost, bool_or(coalesce(state = 'full', false)) AS fully, bool_or(coalesce(state = 'partial', false)) AS partially, any_value(l.level) AS level, any_value(l.in_cycle) AS in_cycle
FROM eff e JOIN lvl l ON l.node = e.t GROUP BY e.t""",
    "g01_trace": _TRACE.format(cond="transform IS DISTINCT FROM 'TEMP_INLINE'", reason=_REASON.format("e.")),
    "g01_trace_source_to_sink": _TRACE.format(cond="transform = 'TEMP_INLINE'", reason=_REASON.format("e.")),
    "g02_upstream": _HUB + _reach("x", "hub", "lineage_", "dst_key", "src_key") + "SELECT node, depth FROM x",
    "g03_downstream_with_consumers": _SEED + _reach("x", "scol", "le", "src_key", "dst_key") + """
SELECT node, depth, 'column' AS what FROM x UNION ALL
SELECT e.name, CAST(min(x.depth) + 1 AS INTEGER), 'consumer' FROM x JOIN column_ c ON c.id = x.node JOIN consumed_ k ON k.src_key = c.table_qualified JOIN table_ t ON t.qualified = c.table_qualified JOIN consumer_ e ON e.name = k.dst_key GROUP BY 1""",
    "g05_rollup": _SEED + _reach("x", "scol", "le", "src_key", "dst_key") + _ROLL + "SELECT * FROM roll",
    "g06_split_synthetic": _SEED + _reach("x", "scol", "le", "src_key", "dst_key") + _ROLL + "SELECT r.*, EXISTS (SELECT 1 FROM table_ t WHERE t.qualified = r.table_qualified AND t.kind IN ('cte','derived','temp')) AS synthetic FROM roll r",
    "g07_contracted_reads": _READCON + "SELECT * FROM con",
    "g10_find_usages": N._QF + """, a AS (SELECT DISTINCT t.name, qf.file, q.sql, q.kind FROM table_ t JOIN reads_ sf ON sf.dst_key = t.qualified JOIN query_ q ON q.id = sf.src_key JOIN qf ON qf.qid = q.id),
 b AS (SELECT DISTINCT t.name, qf.file, q.sql, q.kind FROM table_ t JOIN column_ c ON c.table_qualified = t.qualified JOIN lineage_ cl ON cl.src_key = c.id JOIN query_ q ON q.id = cl.query_id JOIN qf ON qf.qid = q.id
  UNION SELECT DISTINCT t.name, qf.file, q.sql, q.kind FROM table_ t JOIN star_ s ON s.dst_key = t.qualified JOIN query_ q ON q.id = s.src_key JOIN qf ON qf.qid = q.id)
SELECT *, 'direct' AS how FROM a UNION ALL SELECT *, 'via_lineage' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.name = b.name AND a.file = b.file AND a.sql = b.sql)""",
    "g11_find_definition": """SELECT table_qualified, kind, file_path, bk AS is_backup, NOT bk AND n = 1 AS authoritative FROM (SELECT t.qualified AS table_qualified, t.kind, f.path AS file_path,
 regexp_matches(f.path, '(?i)(_bck|_bck_.*|_backup|_backup_.*)\\.sql$') AS bk, count(*) OVER (PARTITION BY t.qualified) AS n FROM table_ t JOIN defined_ d ON d.src_key = t.qualified JOIN file_ f ON f.path = d.dst_key)""",
    "g16_analyze_unused": f"""SELECT t.qualified AS table_qualified, CASE WHEN starts_with(t.qualified, 'mart.') OR starts_with(t.qualified, 'rpt.') THEN 'presentation' ELSE 'dead_code' END AS what,
 EXISTS (SELECT 1 FROM consumed_ c WHERE c.src_key = t.qualified) AS has_consumer, 'heuristic' AS assertion, 0.5::DOUBLE AS confidence FROM table_ t WHERE NOT {_NOISE.format('t.qualified')}
 AND NOT EXISTS (SELECT 1 FROM reads_ r WHERE r.dst_key = t.qualified) AND NOT EXISTS (SELECT 1 FROM star_ s WHERE s.dst_key = t.qualified)
 AND NOT EXISTS (SELECT 1 FROM lineage_ cl JOIN column_ c ON c.id = cl.src_key WHERE c.table_qualified = t.qualified)""",
    "g17_hub_without_noise": N._HUBS + "SELECT *, CAST(row_number() OVER (ORDER BY downstream_dependents DESC, table_qualified) AS INTEGER) AS rank FROM h WHERE NOT regexp_matches(string_split(table_qualified, '.')[-1], '^.*_code$') ORDER BY downstream_dependents DESC, table_qualified LIMIT 10",
    "g04_closure": _SEED + _reach("x", "scol", "le", "src_key", "dst_key") + "SELECT node, depth FROM x",
    "g09_row_reachability": _READCON + N._HUBS + _reach("y", "(SELECT table_qualified AS node FROM h ORDER BY downstream_dependents DESC, table_qualified LIMIT 1)", "con", "src", "dst") + "SELECT node AS table_qualified, depth FROM y",
    "g12_change_scope": _READCON + _SCOPE + """
SELECT n_tables, n_columns, n_upstreams, n_files, n_gating, CASE WHEN n_tables = 0 THEN 'safe' WHEN n_tables <= 5 THEN 'low' WHEN n_tables <= 20 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT count(*) FILTER (what = 'table') AS n_tables,
 count(*) FILTER (what = 'column') AS n_columns, count(*) FILTER (what = 'upstream') AS n_upstreams, count(*) FILTER (what = 'file') AS n_files, count(*) FILTER (what = 'gating_join') AS n_gating FROM scope_)""",
    "g12_scope_lists": _READCON + _SCOPE + "SELECT * FROM scope_",
    "g14_diff_order": _DIFF + _reach("x", "scol", "le", "src_key", "dst_key") + _ROLL + _REALS + _SYN + _ADJ + _CONTR.format(a="u", b="v", rel="tadj") + """, nd AS (SELECT table_qualified AS node FROM realt WHERE table_qualified NOT IN (SELECT table_qualified FROM own))"""
    + _LEVELS.format(edges="con", nodes="nd") + "SELECT node AS table_qualified, level, in_cycle, starts_with(node, 'mart.') OR starts_with(node, 'rpt.') AS presentation FROM lvl",
    "g14_diff_gating": _READCON + _DIFF + _reach("y", "(SELECT table_qualified AS node FROM own)", "con", "src", "dst") + "SELECT node AS table_qualified, depth FROM y",
    "g18_propagation_order": _READCON + _X_ALL + _reach("y", "(SELECT table_qualified AS node FROM seed)", "con", "src", "dst") + f""", nd AS (SELECT node FROM y WHERE node NOT IN (SELECT node FROM syn) AND NOT {_NOISE.format('node')}
 UNION SELECT table_qualified FROM realt WHERE table_qualified NOT IN (SELECT table_qualified FROM seed))""" + _ADJ + """, te2 AS (SELECT DISTINCT u AS a, v AS b FROM tadj WHERE u <> v),
 walk2 AS (SELECT a, b FROM te2 WHERE a NOT IN (SELECT node FROM syn) UNION SELECT w.a, te2.b FROM walk2 w JOIN te2 ON te2.a = w.b WHERE w.b IN (SELECT node FROM syn)),
 con2 AS (SELECT DISTINCT a AS src, b AS dst FROM walk2 WHERE b NOT IN (SELECT node FROM syn) AND a <> b)""" + _LEVELS.format(edges="con2", nodes="nd") + "SELECT node AS table_qualified, level, in_cycle FROM lvl",
    "g14_diff_impact": _DIFF + _reach("x", "scol", "le", "src_key", "dst_key") + _ROLL + _REALS + """
SELECT z.table_qualified, CAST(z.depth AS INTEGER) AS depth, (SELECT count(*) FROM consumed_ k JOIN table_ t ON t.qualified = k.src_key WHERE k.src_key = z.table_qualified) AS n_consumers
FROM (SELECT table_qualified, 0 AS depth FROM own UNION ALL SELECT table_qualified, depth FROM realt WHERE table_qualified NOT IN (SELECT table_qualified FROM own)) z""",
    "g18_empty_propagation": _READCON + _X_ALL + _reach("y", "(SELECT table_qualified AS node FROM seed)", "con", "src", "dst") + f""", val AS (SELECT r.table_qualified,
 CASE WHEN (SELECT bool_and(EXISTS (SELECT 1 FROM x WHERE x.node = h.dst_key)) FROM has_ h WHERE h.src_key = r.table_qualified) THEN 'full' ELSE 'partial' END AS value_state FROM realt r WHERE r.table_qualified NOT IN (SELECT table_qualified FROM seed)),
 allt AS (SELECT node AS table_qualified FROM y WHERE node NOT IN (SELECT node FROM syn) AND NOT {_NOISE.format('node')} UNION SELECT table_qualified FROM val)
SELECT allt.table_qualified, val.value_state, true AS row_empty FROM allt LEFT JOIN val USING (table_qualified)""",
    "g19_producer_diff": """, f AS (SELECT id, arg_min(target_table, (indexed_at, target_table, file_path)) AS t, min(indexed_at) AS i FROM sql_query WHERE id IS NOT NULL GROUP BY 1),
 h AS (SELECT min(indexed_at) + (max(indexed_at) - min(indexed_at)) / 2 AS half FROM sql_query),
 a AS (SELECT DISTINCT t FROM f, h WHERE i <= half AND t <> ''), b AS (SELECT DISTINCT t FROM f, h WHERE i > half AND t <> '')
SELECT t AS producer_table, 'lost' AS side FROM a WHERE t NOT IN (SELECT t FROM b) UNION ALL SELECT t, 'new' FROM b WHERE t NOT IN (SELECT t FROM a)""",
    "g25_db_info": """SELECT 'repo' AS what, count(*) AS n FROM repo_ UNION ALL SELECT 'file', count(*) FROM file_ UNION ALL SELECT 'sql_table', count(*) FROM table_ UNION ALL SELECT 'sql_column', count(*) FROM column_
 UNION ALL SELECT 'sql_query', count(*) FROM query_ UNION ALL SELECT 'column_lineage', count(*) FROM lineage_ UNION ALL SELECT 'selects_from', count(*) FROM reads_ UNION ALL SELECT 'star_source', count(*) FROM star_
 UNION ALL SELECT 'mode:' || coalesce(parsing_mode, 'unknown'), count(*) FROM query_ GROUP BY 1""",
    "g26_execute_sql": "SELECT kind, count(*) AS n FROM table_ GROUP BY kind",
    "g29_analyze_downstream": _SEED + _reach("x", "scol", "le", "src_key", "dst_key", 5) + """SELECT x.node AS id, c.table_qualified, (SELECT min(q.file_path) FROM lineage_ l JOIN query_ q ON q.id = l.query_id WHERE l.dst_key = x.node) AS file,
 (SELECT min(q.start_line) FROM lineage_ l JOIN query_ q ON q.id = l.query_id WHERE l.dst_key = x.node) AS line FROM x JOIN column_ c ON c.id = x.node LEFT JOIN table_ t ON t.qualified = c.table_qualified
 WHERE t.kind IS NULL OR t.kind IN ('table', 'external') ORDER BY id LIMIT 100""",
    "g29_analyze_upstream": _HUB + _reach("x", "hub", "lineage_", "dst_key", "src_key", 5) + """SELECT x.node AS id, c.table_qualified, (SELECT min(q.file_path) FROM lineage_ l JOIN query_ q ON q.id = l.query_id WHERE l.src_key = x.node) AS file,
 (SELECT min(q.start_line) FROM lineage_ l JOIN query_ q ON q.id = l.query_id WHERE l.src_key = x.node) AS line FROM x JOIN column_ c ON c.id = x.node ORDER BY id LIMIT 100""",
    "g30_impact": """, a AS (SELECT r.dst_key AS table_qualified, q.id, q.kind, q.target_table AS target FROM reads_ r JOIN query_ q ON q.id = r.src_key),
 b AS (SELECT DISTINCT c.table_qualified, q.id, q.kind, q.target_table AS target FROM column_ c JOIN lineage_ cl ON cl.src_key = c.id JOIN query_ q ON q.id = cl.query_id UNION SELECT DISTINCT s.dst_key, q.id, q.kind, q.target_table FROM star_ s JOIN query_ q ON q.id = s.src_key)
SELECT *, 'direct' AS how FROM a UNION ALL SELECT *, 'via_lineage' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.table_qualified = b.table_qualified AND a.id = b.id)""",
    "g31_failures": "SELECT path, dialect, coalesce(parse_cause, '') AS parse_cause FROM file_ WHERE parse_failed",
    "g34_find_table": "SELECT qualified AS key FROM table_ WHERE contains(lower(qualified), 'day') ORDER BY 1 LIMIT 50",
    "g34_find_column": "SELECT id AS key FROM column_ WHERE contains(lower(id), 'flag')",
    "g34_find_pattern": "SELECT id AS key FROM query_ WHERE contains(lower(sql), 'hold back')",
    "g35_noise": "SELECT qualified AS table_qualified, lower(qualified) = 'ref.tax_band' OR regexp_matches(string_split(qualified, '.')[-1], '^(.*_daily_.*|.*_hist_.*)$') OR regexp_matches(qualified, '(?i)^lake\\.rpt\\.') AS is_noise, string_split(qualified, '.')[-1] AS short_name FROM table_",
    "g37_viz_links": _VIZ + "SELECT * FROM vl",
    "g37_viz_nodes": _VIZ + """, nb AS (SELECT source AS id, target AS o FROM vl UNION SELECT target, source FROM vl)
SELECT t.qualified AS id, t.db AS schema, t.kind, (SELECT count(*) FROM nb WHERE nb.id = t.qualified) AS deg, EXISTS (SELECT 1 FROM has_ h WHERE h.src_key = t.qualified) AS cat FROM table_ t""",
    "g38_reasons": f"SELECT transform, confidence, count(*) AS n, {_REASON.format('')} AS reason, CASE WHEN confidence IS NULL OR confidence >= 1.0 THEN 'fact' ELSE 'heuristic' END AS assertion FROM lineage_ GROUP BY transform, confidence",
    "g40_column_refs": """SELECT DISTINCT src_key, regexp_replace(lower(src_key), '\\.[^.]*$', '') AS table_id, string_split(lower(src_key), '.')[-1] AS column_name,
 CASE WHEN NOT contains(src_key, '::') AND len(string_split(src_key, '.')) >= 3 THEN array_to_string(string_split(src_key, '.')[2:], '.') ELSE src_key END AS bare FROM lineage_""",
}.items()}
