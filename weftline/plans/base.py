"""The lineage graph of the test tables, and the same graph as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import pick
from ..session import cut, table


def table_of(col):
    """The owning table of a column id: all but the part after the last dot."""
    return F.regexp_replace(col, r"\.?[^.]*$", "")


def name_of(col):
    return F.element_at(F.split(col, r"\."), -1)


#: Relations that questions of several steps read again and again.
CORE = ("sql_table", "sql_column", "sql_query", "column_lineage")


def load_graph(spark: SparkSession, d: str, texts: bool = False, settled: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All relations, one row per key; statement texts only with texts, as a row
    is picked and shuffled whole. Relations in `settled` (of CORE) are written to
    the shared folder, so that they are picked once for all steps of a job.
    Files are the current versions; tables, columns, queries and edges the
    latest rows that are not deleted; what the tables do not hold follows from
    them:

    has_column from sql_column, with a source by what defines the table;
    star_source from star edges; join_col_resolve from resolved join columns;
    defined_in, query_defined_in and belongs_to from the path columns; external
    consumers from views of the mart and rpt layers."""
    t = lambda n: table(spark, d, n)
    keep = lambda n, df: cut(df, n) if n in settled else df
    g: dict[str, DataFrame] = {}
    g["repo"] = t("repo").dropDuplicates(["path"])
    f = t("src_file").where(F.col("path").isNotNull() & F.col("sha").isNotNull())
    g["file"] = pick(f.select("path", "indexed_at", "sha", "repo_path", "dialect", "parse_failed", "parse_cause"), ["path"], [F.col("indexed_at"), F.col("sha")]).drop("indexed_at")
    tab = t("sql_table").where(F.col("qualified").isNotNull())
    g["sql_table"] = keep("sql_table", pick(tab, ["qualified"], [F.col("indexed_at"), F.col("kind")]).drop("indexed_at"))
    c = t("sql_column").where(F.col("id").isNotNull())
    g["sql_column"] = keep("sql_column", pick(c, ["id"], [F.col("indexed_at"), F.col("deleted_at").isNull()]).where(F.col("deleted_at").isNull()).drop("indexed_at", "deleted_at"))
    q = t("sql_query").where(F.col("id").isNotNull())
    q = q if texts else q.drop("sql")
    g["sql_query"] = keep("sql_query", pick(q, ["id"], [F.col("indexed_at"), F.col("deleted_at").isNull()]).where(F.col("deleted_at").isNull()).drop("indexed_at", "deleted_at"))
    pair = F.col("src_key").isNotNull() & F.col("dst_key").isNotNull()
    g["selects_from"] = t("selects_from").where(pair).select("src_key", "dst_key").distinct()
    e = t("column_lineage").where(pair)
    g["column_lineage"] = keep("column_lineage", pick(e, ["src_key", "dst_key"], [F.col("indexed_at"), F.coalesce("transform", F.lit("")), F.coalesce("query_id", F.lit("")), F.coalesce("confidence", F.lit(0.0)), F.coalesce("inferred_from_source_name", F.lit(False))]).drop("indexed_at"))
    by = g["sql_table"].select(F.col("qualified").alias("_q"), "kind", "defined_in_file")
    src = F.when(F.col("_q").isNull(), "usage").when(F.col("kind") == "view", "star_expansion").when(F.col("defined_in_file") != "", "ddl").otherwise("information_schema")
    g["has_column"] = g["sql_column"].select("id", "table_qualified").join(by, F.col("table_qualified") == F.col("_q"), "left").select(F.col("table_qualified").alias("src_key"), F.col("id").alias("dst_key"), src.alias("source"))
    star = g["column_lineage"].where((F.col("transform") == "STAR_EXPANSION") & (F.coalesce("query_id", F.lit("")) != ""))
    g["star_source"] = star.select(F.col("query_id").alias("src_key"), table_of("src_key").alias("dst_key")).distinct()
    bare = g["column_lineage"].where((F.col("transform") == "JOIN_COL_RESOLVED") & (F.coalesce("query_id", F.lit("")) != ""))
    g["join_col_resolve"] = bare.groupBy(F.col("query_id").alias("src_key"), "dst_key").agg(F.min(name_of("src_key")).alias("bare_col"))
    g["defined_in"] = g["sql_table"].where("defined_in_file <> ''").select(F.col("qualified").alias("src_key"), F.col("defined_in_file").alias("dst_key"))
    g["query_defined_in"] = g["sql_query"].where(F.col("file_path").isNotNull()).select(F.col("id").alias("src_key"), F.col("file_path").alias("dst_key"))
    g["belongs_to"] = g["file"].where(F.col("repo_path").isNotNull()).select(F.col("path").alias("src_key"), F.col("repo_path").alias("dst_key"))
    seen = g["sql_table"].where("kind = 'view' and db in ('mart', 'rpt')")
    g["external_consumer"] = seen.select(F.concat(F.lit("board_"), "name").alias("name"), F.lit("dashboard").alias("consumer_type")).distinct()
    g["consumed_by"] = seen.select(F.col("qualified").alias("src_key"), F.concat(F.lit("board_"), "name").alias("dst_key"))
    return g


#: load_graph in SQL; a query's own text follows it.
GRAPH_SQL = """
WITH RECURSIVE repo_ AS (SELECT * FROM repo QUALIFY row_number() OVER (PARTITION BY path ORDER BY name) = 1),
file_ AS (SELECT path, repo_path, sha, dialect, parse_failed, parse_cause FROM src_file WHERE path IS NOT NULL AND sha IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, sha DESC) = 1),
table_ AS (SELECT qualified, catalog, db, name, kind, defined_in_file FROM sql_table WHERE qualified IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY qualified ORDER BY indexed_at DESC NULLS LAST, kind DESC NULLS LAST) = 1),
column_ AS (SELECT id, catalog, db, table_name, col_name, table_qualified FROM (SELECT * FROM sql_column WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, deleted_at IS NULL DESC) = 1) WHERE deleted_at IS NULL),
query_ AS (SELECT * EXCLUDE (indexed_at, deleted_at) FROM (SELECT * FROM sql_query WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, deleted_at IS NULL DESC) = 1) WHERE deleted_at IS NULL),
reads_ AS (SELECT DISTINCT src_key, dst_key FROM selects_from WHERE src_key IS NOT NULL AND dst_key IS NOT NULL),
lineage_ AS (SELECT * EXCLUDE (indexed_at) FROM column_lineage WHERE src_key IS NOT NULL AND dst_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src_key, dst_key ORDER BY indexed_at DESC NULLS LAST, coalesce(transform, '') DESC, coalesce(query_id, '') DESC, coalesce(confidence, 0) DESC, coalesce(inferred_from_source_name, false) DESC) = 1),
has_ AS (SELECT c.table_qualified AS src_key, c.id AS dst_key, CASE WHEN t.qualified IS NULL THEN 'usage' WHEN t.kind = 'view' THEN 'star_expansion'
  WHEN t.defined_in_file <> '' THEN 'ddl' ELSE 'information_schema' END AS source FROM column_ c LEFT JOIN table_ t ON t.qualified = c.table_qualified),
star_ AS (SELECT DISTINCT query_id AS src_key, regexp_replace(src_key, '\\.?[^.]*$', '') AS dst_key FROM lineage_ WHERE transform = 'STAR_EXPANSION' AND coalesce(query_id, '') <> ''),
bare_ AS (SELECT query_id AS src_key, dst_key, min(string_split(src_key, '.')[-1]) AS bare_col FROM lineage_ WHERE transform = 'JOIN_COL_RESOLVED' AND coalesce(query_id, '') <> '' GROUP BY 1, 2),
defined_ AS (SELECT qualified AS src_key, defined_in_file AS dst_key FROM table_ WHERE defined_in_file <> ''),
qfile_ AS (SELECT id AS src_key, file_path AS dst_key FROM query_ WHERE file_path IS NOT NULL),
belongs_ AS (SELECT path AS src_key, repo_path AS dst_key FROM file_ WHERE repo_path IS NOT NULL),
consumer_ AS (SELECT DISTINCT 'board_' || name AS name, 'dashboard' AS consumer_type FROM table_ WHERE kind = 'view' AND db IN ('mart', 'rpt')),
consumed_ AS (SELECT qualified AS src_key, 'board_' || name AS dst_key FROM table_ WHERE kind = 'view' AND db IN ('mart', 'rpt'))
"""


def sql(body: str) -> str:
    """A query over the graph: body starts with more CTEs (", x AS (...)") or
    with its SELECT."""
    return GRAPH_SQL + body
