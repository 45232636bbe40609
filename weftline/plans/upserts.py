"""Upserts, passes and deletions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge as M
from ..operators import passes as P
from ..session import table
from .base import load_graph, sql



def _us():
    return F.unix_micros(F.col("indexed_at").cast("timestamp"))




def u01_has_column(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "sql_column").where(F.col("id").isNotNull() & F.col("table_qualified").isNotNull())
    source = F.when(F.col("deleted_at").isNotNull(), "information_schema").when(F.col("catalog").isNull(), "usage").otherwise("ddl")
    rows = c.select(F.col("table_qualified").alias("src_key"), F.col("id").alias("dst_key"), source.alias("source"), _us().alias("seq"))
    return M.merge_has_column(rows, "seq")


def u02_tables(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sql_table").where(F.col("qualified").isNotNull()).withColumn("seq", _us())
    return M.merge_tables(t, "seq").select("qualified", "kind", "defined_in_file")


def u03_dedup_tables(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sql_table").where(F.col("qualified").isNotNull()).withColumn("seq", _us())
    return M.dedup_tables(t, "seq").select("qualified", "kind", "defined_in_file")


def u04_dedup_lineage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "column_lineage").where(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull())
    e = e.select("src_key", "dst_key", F.coalesce("transform", F.lit("")).alias("transform"), _us().alias("seq"))
    return M.dedup_lineage(e, "seq").select("src_key", "dst_key", "transform", "seq")


def u05_last_wins(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "sql_query").where(F.col("id").isNotNull()).select("id", "kind", "target_table", _us().alias("seq"))
    return M.pick(q, ["id"], [F.col("seq")])


def u06_usage(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    return M.harvest_usage(g["column_lineage"], g["sql_column"], g["sql_table"], g["has_column"].where("source = 'ddl'"))


def u07_without_noise(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    noise = g["sql_table"].where(X.is_noise(F.col("qualified"), ["*_daily_*", "*_code"])).select("qualified")
    return M.exclude_tables(g["selects_from"], ["dst_key"], noise)


def u08_promoted(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    known = g["has_column"].select(F.col("src_key").alias("qualified"))
    return M.promote_derived(g["sql_table"], known).select("qualified", "kind")


def u09_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    have = g["sql_table"].where("kind <> 'table'").select("qualified", "db", "name", "kind")
    new = g["sql_column"].select(F.col("table_qualified").alias("qualified"), "db", F.col("table_name").alias("name"), F.lit("table").alias("kind")).distinct()
    return M.insert_absent(have, new, ["qualified"])


def k04_delete_files(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each relation without the files whose parsing failed."""
    g = load_graph(spark, d)
    g = M.delete_files(g, g["file"].where("parse_failed").select("path"))
    rows = None
    for k in ("file", "sql_table", "sql_column", "sql_query", "has_column", "selects_from", "column_lineage"):
        r = g[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("relation"), "n")
        rows = r if rows is None else rows.unionByName(r)
    return rows


def _graph(f):
    return lambda spark, d: f(load_graph(spark, d))


QUERIES = {
    **{f.__name__: f for f in (u01_has_column, u02_tables, u03_dedup_tables, u04_dedup_lineage, u05_last_wins, u06_usage, u07_without_noise, u08_promoted, u09_insert_absent, k04_delete_files)},
    "pass_star_edges": _graph(lambda g: P.star_edges(g).select("src_key", "dst_key", "query_id")),
    "pass_star_lineage": _graph(lambda g: P.star_lineage(P.star_edges(g))),
    "pass_expanded_stars": _graph(lambda g: P.expand_stars(g)["column_lineage"].select("src_key", "dst_key", "confidence")),
    "pass_join_columns": _graph(P.join_columns),
    "pass_resolved_joins": _graph(lambda g: P.resolve_joins(g)["column_lineage"].select("src_key", "dst_key", "confidence")),
    "pass_counts": _graph(P.pass_counts),
}

_US_SQL = "epoch_us(indexed_at)"
_STAR = """, se AS (SELECT DISTINCT c.id AS src_key, q.target_table || '.' || c.col_name AS dst_key, q.id AS query_id FROM star_ s JOIN query_ q ON q.id = s.src_key JOIN table_ t ON t.qualified = s.dst_key
 JOIN has_ h ON h.src_key = t.qualified JOIN column_ c ON c.id = h.dst_key JOIN table_ g ON g.qualified = q.target_table WHERE q.target_table <> '' AND q.target_table <> t.qualified)\n"""
_JOINS = """, ow AS (SELECT DISTINCT c.id AS src_key, m.dst_key, m.src_key AS query_id FROM bare_ m JOIN reads_ r ON r.src_key = m.src_key JOIN has_ h ON h.src_key = r.dst_key JOIN column_ c ON c.id = h.dst_key AND lower(c.col_name) = lower(m.bare_col)),
 jc AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id, dst_key) = 1 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM ow),
 jl AS (SELECT src_key, dst_key, 'JOIN_COL_RESOLVED' AS transform, confidence, query_id, false AS inferred_from_source_name FROM jc QUALIFY row_number() OVER (PARTITION BY src_key, dst_key ORDER BY confidence DESC, query_id DESC) = 1)\n"""
_GONE = """, gf AS (SELECT path FROM file_ WHERE parse_failed), gt AS (SELECT qualified FROM table_ WHERE defined_in_file IN (SELECT path FROM gf)), gq AS (SELECT id FROM query_ WHERE file_path IN (SELECT path FROM gf)),
 gc AS (SELECT dst_key FROM has_ h WHERE src_key IN (SELECT qualified FROM gt) AND source NOT IN ('information_schema', 'usage'))\n"""

ORACLE = {
    "u01_has_column": f"""SELECT table_qualified AS src_key, id AS dst_key, source, {_US_SQL} AS seq FROM (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'information_schema' WHEN catalog IS NULL THEN 'usage' ELSE 'ddl' END AS source
 FROM sql_column WHERE id IS NOT NULL AND table_qualified IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY table_qualified, id ORDER BY CASE source WHEN 'ddl' THEN 3 WHEN 'information_schema' THEN 2 ELSE 1 END DESC, indexed_at) = 1""",
    "u02_tables": """WITH r AS (SELECT * FROM sql_table WHERE qualified IS NOT NULL), g AS (SELECT qualified, bool_or(kind = 'temp') AS temp, max(indexed_at) FILTER (kind = 'derived') AS d,
 max(indexed_at) FILTER (kind <> 'derived') AS o, arg_max(kind, (indexed_at, kind)) FILTER (kind <> 'derived') AS k, arg_max(defined_in_file, (indexed_at, defined_in_file)) FILTER (defined_in_file <> '') AS f FROM r GROUP BY 1)
SELECT qualified, CASE WHEN temp THEN 'temp' WHEN k IS NULL THEN 'derived' WHEN d > o AND k NOT IN ('table', 'view') THEN 'derived' ELSE k END AS kind, coalesce(f, '') AS defined_in_file FROM g""",
    "u03_dedup_tables": """SELECT qualified, kind, defined_in_file FROM sql_table WHERE qualified IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY qualified ORDER BY coalesce(defined_in_file, '') <> '' DESC, kind IN ('cte', 'external') DESC, indexed_at, (catalog, db, name, kind, defined_in_file) DESC) = 1""",
    "u04_dedup_lineage": f"""SELECT src_key, dst_key, coalesce(transform, '') AS transform, {_US_SQL} AS seq FROM column_lineage WHERE src_key IS NOT NULL AND dst_key IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY src_key, dst_key ORDER BY coalesce(transform, '') <> 'TEMP_INLINE' DESC, indexed_at DESC, coalesce(transform, '') DESC) = 1""",
    "u05_last_wins": f"SELECT id, kind, target_table, {_US_SQL} AS seq FROM sql_query WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, kind DESC, target_table DESC) = 1",
    "u06_usage": sql("""SELECT DISTINCT c.table_qualified AS src_key, c.id AS dst_key, 'usage' AS source FROM lineage_ l JOIN column_ c ON c.id = l.src_key JOIN table_ t ON t.qualified = c.table_qualified
 WHERE t.kind IN ('table', 'view') AND contains(t.qualified, '.') AND NOT contains(t.qualified, '::') AND NOT EXISTS (SELECT 1 FROM has_ h WHERE h.source = 'ddl' AND h.src_key = c.table_qualified AND h.dst_key = c.id)"""),
    "u07_without_noise": sql("SELECT src_key, dst_key FROM reads_ r WHERE NOT EXISTS (SELECT 1 FROM table_ t WHERE t.qualified = r.dst_key AND regexp_matches(string_split(t.qualified, '.')[-1], '^(.*_daily_.*|.*_code)$'))"),
    "u08_promoted": sql("SELECT qualified, CASE WHEN kind = 'derived' AND EXISTS (SELECT 1 FROM has_ h WHERE h.src_key = qualified) THEN 'table' ELSE kind END AS kind FROM table_"),
    "u09_insert_absent": sql(""", have AS (SELECT qualified, db, name, kind FROM table_ WHERE kind <> 'table'), new AS (SELECT table_qualified AS qualified, db, table_name AS name, 'table' AS kind FROM column_ QUALIFY row_number() OVER (PARTITION BY table_qualified ORDER BY (db, table_name) DESC) = 1)
SELECT * FROM have UNION ALL SELECT * FROM new WHERE qualified NOT IN (SELECT qualified FROM have)"""),
    "k04_delete_files": sql(_GONE + """SELECT 'file' AS relation, count(*) AS n FROM file_ WHERE path NOT IN (SELECT path FROM gf) UNION ALL SELECT 'sql_table', count(*) FROM table_ WHERE qualified NOT IN (SELECT qualified FROM gt)
 UNION ALL SELECT 'sql_column', count(*) FROM column_ WHERE id NOT IN (SELECT dst_key FROM gc) UNION ALL SELECT 'sql_query', count(*) FROM query_ WHERE id NOT IN (SELECT id FROM gq)
 UNION ALL SELECT 'has_column', count(*) FROM has_ WHERE dst_key NOT IN (SELECT dst_key FROM gc) UNION ALL SELECT 'selects_from', count(*) FROM reads_ WHERE src_key NOT IN (SELECT id FROM gq)
 UNION ALL SELECT 'column_lineage', count(*) FROM lineage_ WHERE query_id IS NULL OR query_id NOT IN (SELECT id FROM gq)"""),
    "pass_star_edges": sql(_STAR + "SELECT * FROM se"),
    "pass_star_lineage": sql(_STAR + "SELECT src_key, dst_key, 'STAR_EXPANSION' AS transform, 0.8::DOUBLE AS confidence, min(query_id) AS query_id, false AS inferred_from_source_name FROM se GROUP BY 1, 2"),
    "pass_expanded_stars": sql(_STAR + "SELECT src_key, dst_key, max(confidence) AS confidence FROM (SELECT src_key, dst_key, confidence FROM lineage_ UNION ALL SELECT src_key, dst_key, 0.8::DOUBLE FROM se) GROUP BY 1, 2"),
    "pass_join_columns": sql(_JOINS + "SELECT * FROM jl"),
    "pass_resolved_joins": sql(_JOINS + "SELECT src_key, dst_key, max(confidence) AS confidence FROM (SELECT src_key, dst_key, confidence FROM lineage_ UNION ALL SELECT src_key, dst_key, confidence FROM jl) GROUP BY 1, 2"),
    "pass_counts": sql("SELECT 'star_sources' AS what, count(*) AS n FROM star_ UNION ALL SELECT 'star_expansions', count(*) FROM lineage_ WHERE transform = 'STAR_EXPANSION' UNION ALL SELECT 'join_col_resolved', count(*) FROM lineage_ WHERE transform = 'JOIN_COL_RESOLVED'"),
}
