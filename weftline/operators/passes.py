"""Passes over the whole graph after extraction: stars and bare join columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merge


def star_edges(graph: dict[str, DataFrame]) -> DataFrame:
    """One row per column a star brings into a target: src_key, dst_key, query
    and what the target's column looks like. Stars without target, or of a
    table into itself, bring nothing."""
    ss = graph["star_source"].select(F.col("src_key").alias("query_id"), F.col("dst_key").alias("src_table")).distinct()
    q = graph["sql_query"].where(F.col("target_table") != "").select(F.col("id").alias("query_id"), F.col("target_table"))
    t = graph["sql_table"]
    src = t.select(F.col("qualified").alias("src_table"))
    tgt = t.select(F.col("qualified").alias("target_table"), "catalog", "db", F.col("name").alias("table_name"))
    hc = graph["has_column"].select(F.col("src_key").alias("src_table"), F.col("dst_key").alias("src_key"))
    c = graph["sql_column"].select(F.col("id").alias("src_key"), "col_name")
    j = ss.join(q, "query_id").where(F.col("src_table") != F.col("target_table")).join(src, "src_table", "left_semi").join(hc, "src_table").join(c, "src_key").join(tgt, "target_table")
    return j.select("src_key", F.concat_ws(".", "target_table", "col_name").alias("dst_key"), "query_id", "target_table", "col_name", "catalog", "db", "table_name").distinct()


def expand_stars(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph with the columns, HAS_COLUMN rows (star_expansion) and lineage
    (STAR_EXPANSION, 0.8) that stars stand for. HAS_COLUMN precedence holds, and
    an edge of higher confidence stays."""
    e = star_edges(graph)
    g = dict(graph)
    cols = e.select(F.col("dst_key").alias("id"), "catalog", "db", "table_name", "col_name", F.col("target_table").alias("table_qualified"))
    g["sql_column"] = merge.insert_absent(graph["sql_column"].select(*cols.columns), cols, ["id"])
    hc = e.select(F.col("target_table").alias("src_key"), "dst_key", F.lit("star_expansion").alias("source")).distinct()
    g["has_column"] = merge.merge_has_column(merge.stamped(graph["has_column"].select("src_key", "dst_key", "source"), hc), "_seq").drop("_seq")
    g["column_lineage"] = merge.best_lineage(graph["column_lineage"], star_lineage(e))
    return g


def star_lineage(e: DataFrame) -> DataFrame:
    """COLUMN_LINEAGE rows of star_edges; of several queries for one edge the
    smallest id is named."""
    one = e.groupBy("src_key", "dst_key").agg(F.min("query_id").alias("query_id"))
    return one.select("src_key", "dst_key", F.lit("STAR_EXPANSION").alias("transform"), F.lit(0.8).alias("confidence"), "query_id", F.lit(False).alias("inferred_from_source_name"))


def join_columns(graph: dict[str, DataFrame]) -> DataFrame:
    """COLUMN_LINEAGE rows for bare join columns: which of a query's sources has
    a column of that name, letter case ignored. One owner: 0.9; several: 0.5
    each; none: nothing. Owners are counted by an aggregation joined back, as
    the marker's rows are few and a window would sort them."""
    m = graph["join_col_resolve"].select(F.col("src_key").alias("query_id"), "dst_key", F.lower("bare_col").alias("bare")).distinct()
    sf = graph["selects_from"].select(F.col("src_key").alias("query_id"), F.col("dst_key").alias("tab")).distinct()
    hc = graph["has_column"].select(F.col("src_key").alias("tab"), F.col("dst_key").alias("col_id"))
    c = graph["sql_column"].select(F.col("id").alias("col_id"), F.lower("col_name").alias("bare"))
    owned = hc.join(c, "col_id")
    o = m.join(sf, "query_id").join(owned, ["tab", "bare"]).select("query_id", "dst_key", "col_id")
    n = o.groupBy("query_id", "dst_key").agg(F.count(F.lit(1)).alias("n"))
    j = o.join(n, ["query_id", "dst_key"])
    conf = F.when(F.col("n") == 1, F.lit(0.9)).otherwise(F.lit(0.5))
    rows = j.select(F.col("col_id").alias("src_key"), "dst_key", F.lit("JOIN_COL_RESOLVED").alias("transform"), conf.alias("confidence"), "query_id", F.lit(False).alias("inferred_from_source_name"))
    return merge.pick(rows, ["src_key", "dst_key"], [F.col("confidence"), F.col("query_id")])


def resolve_joins(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    g = dict(graph)
    g["column_lineage"] = merge.best_lineage(graph["column_lineage"], join_columns(graph))
    return g


def pass_counts(graph: dict[str, DataFrame]) -> DataFrame:
    """(what, n): stars, star edges and resolved join columns."""
    t = graph["column_lineage"].groupBy().agg(
        F.count_if(F.col("transform") == "STAR_EXPANSION").alias("star_expansions"), F.count_if(F.col("transform") == "JOIN_COL_RESOLVED").alias("join_col_resolved")
    )
    s = graph["star_source"].agg(F.count(F.lit(1)).alias("star_sources"))
    kv = t.select(F.explode(F.create_map(F.lit("star_expansions"), "star_expansions", F.lit("join_col_resolved"), "join_col_resolved")).alias("what", "n"))
    return kv.unionByName(s.select(F.lit("star_sources").alias("what"), F.col("star_sources").alias("n")))
