"""The named graph queries. Each takes the graph and, where the reference binds
one key, a DataFrame of keys, so one call answers for many; without keys it
answers for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from .base import load_graph, sql

Graph = dict[str, DataFrame]


def _only(df: DataFrame, col: str, keys: DataFrame | None) -> DataFrame:
    """Rows of df whose col is among keys (one column)."""
    if keys is None:
        return df
    k = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    return df.join(k, F.col(col) == F.col("_key"), "left_semi")


def _q(g: Graph, *cols: str) -> DataFrame:
    return g["sql_query"].select(F.col("id").alias("qid"), *cols)


def _query_files(g: Graph) -> DataFrame:
    """(qid, file): queries of files that exist."""
    e = g["query_defined_in"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("file"))
    return e.join(g["file"].select(F.col("path").alias("file")), "file", "left_semi")


def repo_files(g: Graph, prefix: str) -> DataFrame:
    return g["file"].where(F.col("path").startswith(prefix)).select("path")


def trace_column_lineage(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """One hop upstream with where it comes from."""
    e = _only(g["column_lineage"], "dst_key", ids).select("src_key", "dst_key", "transform", "confidence", "query_id")
    c = g["sql_column"].select(F.col("id").alias("src_key"), "col_name", "table_qualified")
    q = g["sql_query"].select(F.col("id").alias("query_id"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("sql").alias("expression"))
    t = g["sql_table"].select(F.col("qualified").alias("table_qualified"), F.col("kind").alias("table_kind"))
    j = lookup_join(e, c.withColumnRenamed("src_key", "_c"), "src_key", "_c", how="inner")
    j = lookup_join(j, q.withColumnRenamed("query_id", "_q"), "query_id", "_q")
    j = lookup_join(j, t.withColumnRenamed("table_qualified", "_t"), "table_qualified", "_t")
    return j.select("dst_key", F.col("src_key").alias("id"), "col_name", "table_qualified", "transform", "confidence", "file", "line", "expression", "table_kind")


def table_usages(g: Graph, names: DataFrame | None = None) -> DataFrame:
    """Queries that read a table, by the table's bare name."""
    t = _only(g["sql_table"], "name", names).select("name", F.col("qualified").alias("tab"))
    sf = g["selects_from"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("tab"))
    # a table may be read by most queries
    j = lookup_join(sf, t.withColumnRenamed("tab", "_t"), "tab", "_t", how="inner")
    return j.join(_q(g, "sql", "kind"), "qid").join(_query_files(g), "qid").select("name", "file", "sql", "kind")


def usages_via_lineage(g: Graph, names: DataFrame | None = None) -> DataFrame:
    """Queries that derive a column from a column of the table."""
    t = _only(g["sql_table"], "name", names).select("name", F.col("qualified").alias("table_qualified"))
    c = g["sql_column"].select(F.col("id").alias("src_key"), "table_qualified")
    e = g["column_lineage"].select("src_key", F.col("query_id").alias("qid"))
    # columns of one query and table are many: pairs first, texts afterwards
    pairs = lookup_join(e, c.withColumnRenamed("src_key", "_c"), "src_key", "_c", how="inner").select("qid", "table_qualified").distinct()
    pairs = lookup_join(pairs, t.withColumnRenamed("table_qualified", "_t"), "table_qualified", "_t", how="inner")
    return pairs.join(_q(g, "sql", "kind"), "qid").join(_query_files(g), "qid").select("name", "file", "sql", "kind").distinct()


def downstream_one(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    e = _only(g["column_lineage"], "src_key", ids).select("src_key", F.col("dst_key").alias("id"))
    return e.join(g["sql_column"].select("id", "col_name", "table_qualified"), "id").select("src_key", "id", "col_name", "table_qualified")


def upstream_one(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    e = _only(g["column_lineage"], "dst_key", ids).select("dst_key", F.col("src_key").alias("id"))
    return e.join(g["sql_column"].select("id", "col_name", "table_qualified"), "id").select("dst_key", "id", "col_name", "table_qualified")


def search_sql(g: Graph, text: str, limit: int | None = None) -> DataFrame:
    """Queries whose text holds `text` literally; a limit takes the first ones by
    file, statement and id."""
    q = g["sql_query"].where(F.contains(F.col("sql"), F.lit(text))).select(F.col("id").alias("qid"), "statement_index", "sql", "kind")
    j = q.join(_query_files(g), "qid")
    if limit is not None:
        j = j.orderBy("file", "statement_index", "qid").limit(limit)
    return j.select("file", "sql", "kind")


def dialects_and_repos(g: Graph) -> DataFrame:
    b = g["belongs_to"].select(F.col("src_key").alias("path_"), F.col("dst_key").alias("repo"))
    f = g["file"].select(F.col("path").alias("path_"), "dialect")
    j = b.join(f, "path_").groupBy("repo").agg(F.sort_array(F.collect_set("dialect")).alias("dialects"))
    return j.join(g["repo"].select(F.col("path").alias("repo"), "name"), "repo").select(F.col("repo").alias("path"), "name", "dialects")


def definitions(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    t = _only(g["sql_table"], "qualified", tables).select(F.col("qualified").alias("table_qualified"), "kind", "defined_in_file")
    d = g["defined_in"].select(F.col("src_key").alias("table_qualified"), F.col("dst_key").alias("file_path"))
    return t.join(d, "table_qualified").join(g["file"].select(F.col("path").alias("file_path")), "file_path", "left_semi").select("table_qualified", "kind", "defined_in_file", "file_path")


def defining_files(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    return definitions(g, tables).select("table_qualified", "file_path", "kind")


def producer_files(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    q = _only(g["sql_query"].where("target_table <> ''"), "target_table", tables).select(F.col("id").alias("qid"), "target_table")
    return q.join(_query_files(g), "qid").select(F.col("target_table").alias("table_qualified"), F.col("file").alias("file_path")).distinct()


def direct_upstreams(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    q = _only(g["sql_query"].where("target_table <> ''"), "target_table", tables).select(F.col("id").alias("qid"), "target_table")
    sf = g["selects_from"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("upstream_table"))
    src = g["sql_table"].select(F.col("qualified").alias("upstream_table"))
    j = q.join(sf, "qid").where(F.col("upstream_table") != F.col("target_table")).join(src, "upstream_table", "left_semi")
    j = j.join(_query_files(g), "qid", "left")
    return j.select(F.col("target_table").alias("table_qualified"), "upstream_table", F.col("file").alias("in_file")).distinct()


def columns_of(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    t = _only(g["sql_table"], "qualified", tables).select(F.col("qualified").alias("table_qualified"))
    hc = g["has_column"].select(F.col("src_key").alias("table_qualified"), F.col("dst_key").alias("col_id"))
    return t.join(hc, "table_qualified").join(g["sql_column"].select(F.col("id").alias("col_id"), "col_name"), "col_id").select("table_qualified", "col_id", "col_name")


def tables_in_files(g: Graph, files: DataFrame | None = None) -> DataFrame:
    d = _only(g["defined_in"], "dst_key", files).select(F.col("src_key").alias("table_qualified"), F.col("dst_key").alias("file_path"))
    return d.join(g["sql_table"].select(F.col("qualified").alias("table_qualified")), "table_qualified", "left_semi").select("file_path", "table_qualified")


def targets_of_files(g: Graph, files: DataFrame | None = None) -> DataFrame:
    e = _only(g["query_defined_in"], "dst_key", files).select(F.col("src_key").alias("qid"), F.col("dst_key").alias("file_path"))
    return e.join(_q(g, "target_table").where("target_table <> ''"), "qid").select("file_path", F.col("target_table").alias("table_qualified")).distinct()


def table_adjacency(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """Column edges inside a set of columns rolled up to pairs of tables."""
    e = _only(_only(g["column_lineage"], "src_key", ids), "dst_key", ids).select("src_key", "dst_key")
    c = g["sql_column"]
    a = c.select(F.col("id").alias("src_key"), F.col("table_qualified").alias("upstream_table"))
    b = c.select(F.col("id").alias("dst_key"), F.col("table_qualified").alias("downstream_table"))
    # most edges may lead to, or come from, a few columns
    e = lookup_join(e, a.withColumnRenamed("src_key", "_a"), "src_key", "_a", how="inner")
    p = lookup_join(e, b.withColumnRenamed("dst_key", "_b"), "dst_key", "_b", how="inner").where("upstream_table <> downstream_table").select("upstream_table", "downstream_table").distinct()
    k = g["sql_table"].select("qualified", "kind")
    p = p.join(k.select(F.col("qualified").alias("upstream_table"), F.col("kind").alias("upstream_kind")), "upstream_table", "left")
    p = p.join(k.select(F.col("qualified").alias("downstream_table"), F.col("kind").alias("downstream_kind")), "downstream_table", "left")
    return p.select("upstream_table", "upstream_kind", "downstream_table", "downstream_kind")


def table_kinds(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    return _only(g["sql_table"], "qualified", tables).select(F.col("qualified").alias("table_qualified"), "kind")


def unused_tables(g: Graph) -> DataFrame:
    """Tables nothing reads: by query, by star or by a column's value."""
    used = g["selects_from"].select(F.col("dst_key").alias("u")).union(g["star_source"].select("dst_key"))
    src = g["column_lineage"].select(F.col("src_key").alias("id")).distinct().join(g["sql_column"].select("id", "table_qualified"), "id")
    used = used.union(src.where("table_qualified <> ''").select("table_qualified"))
    return g["sql_table"].join(used.distinct(), F.col("qualified") == F.col("u"), "left_anti").select(F.col("qualified").alias("table_qualified"))


def hub_ranking(g: Graph, k: int | None = None, noise: DataFrame | None = None) -> DataFrame:
    """Tables by how many others are written from them; noise tables are left
    out before the limit, ranks are contiguous."""
    from pyspark.sql import Window as W

    sf = g["selects_from"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("tab"))
    pairs = sf.join(_q(g, "target_table").where("target_table <> ''"), "qid").where("target_table <> tab").select("tab", "target_table").distinct()
    n = pairs.groupBy("tab").agg(F.count(F.lit(1)).alias("downstream_dependents")).join(g["sql_table"].select(F.col("qualified").alias("tab")), "tab", "left_semi")
    if noise is not None:
        n = n.join(noise.select(F.col("qualified").alias("tab")), "tab", "left_anti")
    n = n.select(F.col("tab").alias("table_qualified"), "downstream_dependents")
    if k is None:
        return n
    top = n.orderBy(F.desc("downstream_dependents"), "table_qualified").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("downstream_dependents"), "table_qualified")))


def dependent_files(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    sf = _only(g["selects_from"], "dst_key", tables).select(F.col("src_key").alias("qid"), F.col("dst_key").alias("tab"))
    sf = sf.join(g["sql_table"].select(F.col("qualified").alias("tab")), "tab", "left_semi")
    return sf.join(_q(g), "qid", "left_semi").join(_query_files(g), "qid").select(F.col("tab").alias("table_qualified"), F.col("file").alias("path")).distinct()


def external_consumers(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    cb = _only(g["consumed_by"], "src_key", tables).select(F.col("src_key").alias("table_qualified"), F.col("dst_key").alias("name"))
    cb = cb.join(g["sql_table"].select(F.col("qualified").alias("table_qualified")), "table_qualified", "left_semi")
    return cb.join(g["external_consumer"], "name").select("table_qualified", "name", "consumer_type")


def reads_adjacency(g: Graph) -> DataFrame:
    q = _q(g, F.col("target_table").alias("dest_table")).where("dest_table <> ''")
    e = g["selects_from"].select(F.col("src_key").alias("qid"), F.col("dst_key").alias("source_table")).union(g["star_source"].select("src_key", "dst_key"))
    return e.join(q, "qid").select("source_table", "dest_table").distinct()


def producer_tables(g: Graph) -> DataFrame:
    return g["sql_query"].where("target_table <> ''").select(F.col("target_table").alias("producer_table")).distinct()


def consumers_via_lineage(g: Graph, tables: DataFrame | None = None) -> DataFrame:
    c = _only(g["sql_column"], "table_qualified", tables).select(F.col("id").alias("src_key"), "table_qualified")
    a = lookup_join(g["column_lineage"].select("src_key", F.col("query_id").alias("qid")), c.withColumnRenamed("src_key", "_c"), "src_key", "_c", how="inner").select("table_qualified", "qid")
    b = _only(g["star_source"], "dst_key", tables).select(F.col("dst_key").alias("table_qualified"), F.col("src_key").alias("qid"))
    j = a.union(b).distinct().join(_q(g, "kind", "target_table"), "qid")
    return j.select("table_qualified", F.col("qid").alias("id"), "kind", F.col("target_table").alias("target"))


def _plan(f, *args):
    return lambda spark, d: f(load_graph(spark, d), *args)


def _texts(f, *args):
    return lambda spark, d: f(load_graph(spark, d, texts=True), *args)


def _count(relation: str, where: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = load_graph(spark, d)[relation]
        return (df.where(where) if where else df).agg(F.count(F.lit(1)).alias("n"))

    return run


QUERIES = {
    "n05_repo_files": _plan(repo_files, "/srv/git/claims-etl"),
    "n06_trace_column_lineage": _texts(trace_column_lineage),
    "n07_table_usages": _texts(table_usages),
    "n08_downstream": _plan(downstream_one),
    "n09_upstream": _plan(upstream_one),
    "n10_search_sql": _texts(search_sql, "batch_no"),
    "n10_search_sql_top": _texts(search_sql, "batch_no", 20),
    "n11_dialects_and_repos": _plan(dialects_and_repos),
    "n16_count_join_resolved": _count("column_lineage", "transform = 'JOIN_COL_RESOLVED'"),
    "n17_count_star_sources": _count("star_source"),
    "n18_count_star_expansions": _count("column_lineage", "transform = 'STAR_EXPANSION'"),
    "n19_find_definition": _plan(definitions),
    "n20_defining_files": _plan(defining_files),
    "n21_producer_files": _plan(producer_files),
    "n22_direct_upstreams": _plan(direct_upstreams),
    "n23_columns_of_table": _plan(columns_of),
    "n24_tables_in_file": _plan(tables_in_files),
    "n25_targets_of_file": _plan(targets_of_files),
    "n26_table_adjacency": _plan(table_adjacency),
    "n27_table_kinds": _plan(table_kinds),
    "n28_unused_tables": _plan(unused_tables),
    "n29_hub_counts": _plan(hub_ranking),
    "n29_hub_ranking": _plan(hub_ranking, 10),
    "n30_dependent_files": _plan(dependent_files),
    "n31_external_consumers": _plan(external_consumers),
    "n33_count_consumers": _count("consumed_by"),
    "n34_reads_adjacency": _plan(reads_adjacency),
    "n35_usages_via_lineage": _texts(usages_via_lineage),
    "n36_producer_tables": _plan(producer_tables),
    "n37_consumers_via_lineage": _plan(consumers_via_lineage),
}

_QF = ", qf AS (SELECT x.src_key AS qid, x.dst_key AS file FROM qfile_ x SEMI JOIN file_ f ON f.path = x.dst_key)\n"
_HUBS = """, h AS (SELECT t.qualified AS table_qualified, CAST(count(DISTINCT q.target_table) AS BIGINT) AS downstream_dependents
 FROM table_ t JOIN reads_ sf ON sf.dst_key = t.qualified JOIN query_ q ON q.id = sf.src_key WHERE q.target_table <> '' AND q.target_table <> t.qualified GROUP BY 1)\n"""
_READS = """, reads_adj AS (SELECT sf.dst_key AS source_table, q.target_table AS dest_table FROM query_ q JOIN reads_ sf ON sf.src_key = q.id WHERE q.target_table <> ''
 UNION SELECT s.dst_key, q.target_table FROM query_ q JOIN star_ s ON s.src_key = q.id WHERE q.target_table <> '')\n"""

ORACLE = {k: sql(v) for k, v in {
    "n05_repo_files": "SELECT path FROM file_ WHERE starts_with(path, '/srv/git/claims-etl')",
    "n06_trace_column_lineage": """SELECT cl.dst_key, src.id, src.col_name, src.table_qualified, cl.transform, cl.confidence, q.file_path AS file, q.start_line AS line, q.sql AS expression, t.kind AS table_kind
FROM lineage_ cl JOIN column_ src ON src.id = cl.src_key LEFT JOIN query_ q ON q.id = cl.query_id LEFT JOIN table_ t ON t.qualified = src.table_qualified""",
    "n07_table_usages": _QF + "SELECT t.name, qf.file, q.sql, q.kind FROM table_ t JOIN reads_ sf ON sf.dst_key = t.qualified JOIN query_ q ON q.id = sf.src_key JOIN qf ON qf.qid = q.id",
    "n08_downstream": "SELECT cl.src_key, d.id, d.col_name, d.table_qualified FROM lineage_ cl JOIN column_ d ON d.id = cl.dst_key",
    "n09_upstream": "SELECT cl.dst_key, s.id, s.col_name, s.table_qualified FROM lineage_ cl JOIN column_ s ON s.id = cl.src_key",
    "n10_search_sql": _QF + "SELECT qf.file, q.sql, q.kind FROM query_ q JOIN qf ON qf.qid = q.id WHERE contains(q.sql, 'batch_no')",
    "n10_search_sql_top": _QF + "SELECT file, sql, kind FROM (SELECT qf.file, q.sql, q.kind FROM query_ q JOIN qf ON qf.qid = q.id WHERE contains(q.sql, 'batch_no') ORDER BY qf.file, q.statement_index, q.id LIMIT 20)",
    "n11_dialects_and_repos": "SELECT r.path, r.name, coalesce(list_sort(list(DISTINCT f.dialect) FILTER (f.dialect IS NOT NULL)), []) AS dialects FROM repo_ r JOIN belongs_ b ON b.dst_key = r.path JOIN file_ f ON f.path = b.src_key GROUP BY 1, 2",
    "n16_count_join_resolved": "SELECT count(*) AS n FROM lineage_ WHERE transform = 'JOIN_COL_RESOLVED'",
    "n17_count_star_sources": "SELECT count(*) AS n FROM star_",
    "n18_count_star_expansions": "SELECT count(*) AS n FROM lineage_ WHERE transform = 'STAR_EXPANSION'",
    "n19_find_definition": "SELECT t.qualified AS table_qualified, t.kind, t.defined_in_file, f.path AS file_path FROM table_ t JOIN defined_ d ON d.src_key = t.qualified JOIN file_ f ON f.path = d.dst_key",
    "n20_defining_files": "SELECT t.qualified AS table_qualified, f.path AS file_path, t.kind FROM table_ t JOIN defined_ d ON d.src_key = t.qualified JOIN file_ f ON f.path = d.dst_key",
    "n21_producer_files": _QF + "SELECT DISTINCT q.target_table AS table_qualified, qf.file AS file_path FROM query_ q JOIN qf ON qf.qid = q.id WHERE q.target_table <> ''",
    "n22_direct_upstreams": _QF + """SELECT DISTINCT q.target_table AS table_qualified, src.qualified AS upstream_table, qf.file AS in_file FROM query_ q JOIN reads_ sf ON sf.src_key = q.id
JOIN table_ src ON src.qualified = sf.dst_key LEFT JOIN qf ON qf.qid = q.id WHERE q.target_table <> '' AND src.qualified <> q.target_table""",
    "n23_columns_of_table": "SELECT t.qualified AS table_qualified, c.id AS col_id, c.col_name FROM table_ t JOIN has_ h ON h.src_key = t.qualified JOIN column_ c ON c.id = h.dst_key",
    "n24_tables_in_file": "SELECT d.dst_key AS file_path, t.qualified AS table_qualified FROM table_ t JOIN defined_ d ON d.src_key = t.qualified",
    "n25_targets_of_file": "SELECT DISTINCT x.dst_key AS file_path, q.target_table AS table_qualified FROM query_ q JOIN qfile_ x ON x.src_key = q.id WHERE q.target_table <> ''",
    "n26_table_adjacency": """SELECT DISTINCT s.table_qualified AS upstream_table, ut.kind AS upstream_kind, d.table_qualified AS downstream_table, dt.kind AS downstream_kind
FROM lineage_ cl JOIN column_ s ON s.id = cl.src_key JOIN column_ d ON d.id = cl.dst_key LEFT JOIN table_ ut ON ut.qualified = s.table_qualified
LEFT JOIN table_ dt ON dt.qualified = d.table_qualified WHERE s.table_qualified <> d.table_qualified""",
    "n27_table_kinds": "SELECT qualified AS table_qualified, kind FROM table_",
    "n28_unused_tables": """SELECT qualified AS table_qualified FROM table_ t WHERE NOT EXISTS (SELECT 1 FROM reads_ r WHERE r.dst_key = t.qualified)
AND NOT EXISTS (SELECT 1 FROM star_ s WHERE s.dst_key = t.qualified)
AND NOT EXISTS (SELECT 1 FROM lineage_ cl JOIN column_ c ON c.id = cl.src_key WHERE c.table_qualified = t.qualified)""",
    "n29_hub_counts": _HUBS + "SELECT * FROM h",
    "n29_hub_ranking": _HUBS + "SELECT *, CAST(row_number() OVER (ORDER BY downstream_dependents DESC, table_qualified) AS INTEGER) AS rank FROM h ORDER BY downstream_dependents DESC, table_qualified LIMIT 10",
    "n30_dependent_files": _QF + "SELECT DISTINCT t.qualified AS table_qualified, qf.file AS path FROM table_ t JOIN reads_ sf ON sf.dst_key = t.qualified JOIN query_ q ON q.id = sf.src_key JOIN qf ON qf.qid = q.id",
    "n31_external_consumers": "SELECT t.qualified AS table_qualified, e.name, e.consumer_type FROM table_ t JOIN consumed_ c ON c.src_key = t.qualified JOIN consumer_ e ON e.name = c.dst_key",
    "n33_count_consumers": "SELECT count(*) AS n FROM consumed_",
    "n34_reads_adjacency": _READS + "SELECT * FROM reads_adj",
    "n35_usages_via_lineage": _QF + """SELECT DISTINCT t.name, qf.file, q.sql, q.kind FROM table_ t JOIN column_ c ON c.table_qualified = t.qualified JOIN lineage_ cl ON cl.src_key = c.id
JOIN query_ q ON q.id = cl.query_id JOIN qf ON qf.qid = q.id""",
    "n36_producer_tables": "SELECT DISTINCT target_table AS producer_table FROM query_ WHERE target_table <> ''",
    "n37_consumers_via_lineage": """SELECT DISTINCT c.table_qualified, q.id, q.kind, q.target_table AS target FROM column_ c JOIN lineage_ cl ON cl.src_key = c.id JOIN query_ q ON q.id = cl.query_id
UNION SELECT DISTINCT s.dst_key, q.id, q.kind, q.target_table FROM star_ s JOIN query_ q ON q.id = s.src_key""",
}.items()}
