"""Extraction from the SQL texts of the test tables. What a parser gives has no
SQL: `xf_` queries read a written fixture and are held against rows written by
hand, the tests hold more of it against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import tables as T
from ..operators import passes as P
from ..session import cut, table


def current_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, repo_path, sha, dialect, content) of current versions."""
    f = table(spark, d, "src_file").where(F.col("path").isNotNull() & F.col("sha").isNotNull() & F.col("indexed_at").isNotNull())
    top = f.groupBy("path").agg(F.max(F.struct("indexed_at", "sha", "repo_path", "dialect")).alias("v"), F.max(F.when(F.col("dialect").isNotNull(), F.struct("indexed_at", "dialect"))).alias("k"))
    cur = top.select(F.col("path").alias("_p"), F.col("v.sha").alias("_s"), F.col("v.repo_path").alias("repo_path"), F.coalesce("v.dialect", "k.dialect").alias("dialect"))
    t = table(spark, d, "file_text").dropDuplicates(["path", "sha"])
    return t.join(cur, (F.col("path") == F.col("_p")) & (F.col("sha") == F.col("_s"))).select("path", "repo_path", "sha", "dialect", "content")


def _st(spark: SparkSession, d: str) -> DataFrame:
    return T.extract_files(current_files(spark, d))


def _rel(name: str):
    return lambda s, d: T.graph_of(current_files(s, d))[name]


def x_clones(spark: SparkSession, d: str) -> DataFrame:
    st = cut(_st(spark, d), "statements")
    return T.clones(st, T.ddl_columns(st))


def x_resolved_graph(spark: SparkSession, d: str) -> DataFrame:
    """Lineage after all passes: stars expanded, bare join columns resolved."""
    g = P.resolve_joins(P.expand_stars(T.graph_of(current_files(spark, d))))
    return g["column_lineage"].groupBy("transform").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


# ------------------------------------------------------- a written fixture
#: Files with what the test tables' files lack (stars, bare join columns, clones)
#: and the plain cases beside them; the expected rows below are written by hand.
FIXTURE = [
    ("ddl.sql", "CREATE TABLE s.t (a INT, b VARCHAR(9));\nCREATE TABLE s.u (i INT, c INT);"),
    ("star.sql", "CREATE TABLE m.star AS SELECT * FROM s.t"),
    ("alias.sql", "INSERT INTO m.star2 SELECT x.* FROM s.u x"),
    ("join.sql", "INSERT INTO m.j (p, q) SELECT c, t.a FROM s.t t JOIN s.u u ON t.a = u.i"),
    ("cte.sql", "CREATE TABLE m.c AS WITH w AS (SELECT a AS k FROM s.t) SELECT k FROM w"),
    ("agg.sql", "CREATE VIEW m.v AS SELECT u.i, MAX(u.c) AS top, u.c + 1 AS nxt, 'x' AS lit FROM s.u u GROUP BY u.i"),
    ("clone.sql", "CREATE TABLE m.copy CLONE s.u"),
    ("comment.sql", "-- CREATE TABLE no.table AS SELECT 1\n"),
]


def _fixture(spark: SparkSession) -> DataFrame:
    rows = [(p, "fixture", str(i), "snowflake", t) for i, (p, t) in enumerate(FIXTURE)]
    return spark.createDataFrame(rows, "path string, repo_path string, sha string, dialect string, content string")


def _fixture_graph(spark: SparkSession) -> dict[str, DataFrame]:
    return P.resolve_joins(P.expand_stars(T.graph_of(_fixture(spark))))


def xf_statements(spark: SparkSession, d: str) -> DataFrame:
    return T.queries(T.extract_files(_fixture(spark))).select("file_path", "statement_index", "kind", "target_table", "start_line", "parse_failed")


def xf_reads(spark: SparkSession, d: str) -> DataFrame:
    """Which file reads which table."""
    g = _fixture_graph(spark)
    q = g["sql_query"].select(F.col("id").alias("src_key"), "file_path")
    return g["selects_from"].join(q, "src_key").select("file_path", F.col("dst_key").alias("table_qualified")).distinct()


def xf_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _fixture_graph(spark)["column_lineage"].select("src_key", "dst_key", "transform", "confidence").distinct()


def xf_star_sources(spark: SparkSession, d: str) -> DataFrame:
    return T.graph_of(_fixture(spark))["star_source"].select("dst_key", "qualifier", "target_table")


def xf_join_markers(spark: SparkSession, d: str) -> DataFrame:
    return T.graph_of(_fixture(spark))["join_col_resolve"].select("dst_key", "bare_col").distinct()


def xf_has_column(spark: SparkSession, d: str) -> DataFrame:
    return _fixture_graph(spark)["has_column"].select("src_key", "dst_key", "source")


def xf_clones(spark: SparkSession, d: str) -> DataFrame:
    st = cut(T.extract_files(_fixture(spark)), "statements")
    return T.clones(st, T.ddl_columns(st)).select("qualified", "col_name")


QUERIES = {
    "x_statements": lambda s, d: T.queries(_st(s, d)),
    "x_reads": lambda s, d: T.reads(_st(s, d)),
    "x_tables": _rel("sql_table"),
    "x_columns": _rel("sql_column"),
    "x_has_column": _rel("has_column"),
    "x_lineage": _rel("column_lineage"),
    "x_star_sources": _rel("star_source"),
    "x_join_markers": _rel("join_col_resolve"),
    "x_files": _rel("file"),
    "x_second_pass": lambda s, d: T.second_pass(_st(s, d)),
    "x_clones": x_clones,
    "x_resolved_graph": x_resolved_graph,
    **{f.__name__: f for f in (xf_statements, xf_reads, xf_lineage, xf_star_sources, xf_join_markers, xf_has_column, xf_clones)},
}


def _rows(cols: str, *rows: str) -> str:
    """SQL for rows written as 'a b c'."""
    values = ", ".join("(" + ", ".join("''" if x == "-" else f"'{x}'" for x in r.split()) + ")" for r in rows)
    names = [c.split(":") for c in cols.split()]
    out = ", ".join(f"CAST({n[0]} AS {n[1]}) AS {n[0]}" if len(n) > 1 else n[0] for n in names)
    return f"SELECT {out} FROM (VALUES {values}) t({', '.join(n[0] for n in names)})"


ORACLE = {
    "xf_statements": _rows(
        "file_path statement_index:BIGINT kind target_table start_line:BIGINT parse_failed:BOOLEAN",
        "ddl.sql 0 CREATE_TABLE s.t 1 false", "ddl.sql 1 CREATE_TABLE s.u 2 false", "star.sql 0 CREATE_TABLE m.star 1 false", "alias.sql 0 INSERT m.star2 1 false",
        "join.sql 0 INSERT m.j 1 false", "cte.sql 0 CREATE_TABLE m.c 1 false", "agg.sql 0 CREATE_VIEW m.v 1 false", "clone.sql 0 CREATE_TABLE m.copy 1 false",
    ),
    "xf_reads": _rows("file_path table_qualified", "star.sql s.t", "alias.sql s.u", "join.sql s.t", "join.sql s.u", "cte.sql s.t", "agg.sql s.u"),
    "xf_lineage": _rows(
        "src_key dst_key transform confidence:DOUBLE",
        "s.t.a m.star.a STAR_EXPANSION 0.8", "s.t.b m.star.b STAR_EXPANSION 0.8", "s.u.i m.star2.i STAR_EXPANSION 0.8", "s.u.c m.star2.c STAR_EXPANSION 0.8",
        "s.u.c m.j.p JOIN_COL_RESOLVED 0.9", "s.t.a m.j.q PASS_THROUGH 1", "s.t.a cte.sql::w.k CTE_PROJECTION 1", "cte.sql::w.k m.c.k PASS_THROUGH 1",
        "s.u.i m.v.i PASS_THROUGH 1", "s.u.c m.v.top AGGREGATION 1", "s.u.c m.v.nxt EXPRESSION 1",
    ),
    "xf_star_sources": _rows("dst_key qualifier target_table", "s.t - m.star", "s.u x m.star2"),
    "xf_join_markers": _rows("dst_key bare_col", "m.j.p c"),
    "xf_has_column": _rows(
        "src_key dst_key source",
        "s.t s.t.a ddl", "s.t s.t.b ddl", "s.u s.u.i ddl", "s.u s.u.c ddl", "m.star m.star.a star_expansion", "m.star m.star.b star_expansion", "m.star2 m.star2.i star_expansion",
        "m.star2 m.star2.c star_expansion", "m.c m.c.k ddl", "m.v m.v.i ddl", "m.v m.v.top ddl", "m.v m.v.nxt ddl", "m.v m.v.lit ddl", "m.copy m.copy.i ddl", "m.copy m.copy.c ddl",
    ),
    "xf_clones": _rows("qualified col_name", "m.copy i", "m.copy c"),
}
