"""Upserts: rows meet on a key and a rule says which one stays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, RELATIONS, SOURCE_RANK


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], least: bool = False) -> DataFrame:
    """One whole row per key: the greatest (or least) by order. An aggregation
    over structs, so equal keys meet before the shuffle and no group is ever
    sorted. Ties go to the greatest (least) remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    rank = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    row = F.struct(*rank, F.struct(*rest).alias("_r")) if rest else F.struct(*rank)
    agg = F.min(row) if least else F.max(row)
    out = df.groupBy(*keys).agg(agg.alias("_p"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_p._r.`{c}`").alias(c) for c in df.columns])


def stamped(existing: DataFrame | None, *batches: DataFrame, seq: str = "_seq") -> DataFrame:
    """existing (batch 0) and batches in one relation with their order in seq."""
    parts = [b.withColumn(seq, F.lit(i)) for i, b in enumerate(([existing] if existing is not None else []) + list(batches))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def upsert(existing: DataFrame | None, *batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last writer wins by key. Rows of one batch with the same key count by
    their greatest remaining columns."""
    s = stamped(existing, *batches)
    return pick(s, keys, [F.col("_seq")]).drop("_seq")


def source_rank(source: Column) -> Column:
    rank = F.lit(0)
    for name, n in SOURCE_RANK.items():
        rank = F.when(source == name, F.lit(n)).otherwise(rank)
    return rank


def merge_has_column(rows: DataFrame, seq: str) -> DataFrame:
    """The source of a column edge gives way only to one of strictly higher
    rank: the highest rank stays, of equal ranks the earliest row."""
    return pick(rows, ["src_key", "dst_key"], [source_rank(F.col("source")), -F.col(seq)])


def merge_tables(rows: DataFrame, seq: str) -> DataFrame:
    """Tables with a guarded kind. In order of seq: a table or view never
    becomes derived, a temp table stays temp, else the later kind wins; an empty
    defined_in_file never replaces one that is set; other columns are the last
    row's. The order-dependent rule has a closed form over three maxima, so the
    groups are not sorted."""
    last = lambda c, when=None: F.max(F.when(when, F.struct(F.col(seq), F.col(c))) if when is not None else F.struct(F.col(seq), F.col(c)))
    derived = F.col("kind") == "derived"
    g = rows.groupBy("qualified").agg(
        F.max(F.struct(seq, "catalog", "db", "name", "kind")).alias("_l"),
        last("kind", ~derived).alias("_k"),
        F.max(F.col("kind") == "temp").alias("_temp"),
        F.max(F.when(derived, F.col(seq))).alias("_d"),
        last("defined_in_file", F.col("defined_in_file") != "").alias("_f"),
    )
    after = F.col("_d") > F.col(f"_k.{seq}")
    kind = F.when(F.coalesce("_temp", F.lit(False)), "temp").when(F.col("_k").isNull(), F.col("_l.kind")).when(after & ~F.col("_k.kind").isin("table", "view"), "derived").otherwise(F.col("_k.kind"))
    return g.select("qualified", "_l.catalog", "_l.db", "_l.name", kind.alias("kind"), F.coalesce("_f.defined_in_file", F.lit("")).alias("defined_in_file"))


def dedup_tables(rows: DataFrame, seq: str) -> DataFrame:
    """Rows of one batch: one that names a file goes before one that does not,
    cte and external before table, then the earliest."""
    has = (F.coalesce("defined_in_file", F.lit("")) != "").cast("int")
    rank = F.when(F.col("kind").isin("cte", "external"), 1).otherwise(0)
    return pick(rows, ["qualified"], [has, rank, -F.col(seq)])


def dedup_lineage(rows: DataFrame, seq: str) -> DataFrame:
    """Last row of an edge wins, but an inlined temp edge never replaces a
    structural one."""
    structural = (~F.col("transform").eqNullSafe(F.lit("TEMP_INLINE"))).cast("int")
    return pick(rows, ["src_key", "dst_key"], [structural, F.col(seq)])


def best_lineage(*parts: DataFrame) -> DataFrame:
    """Edges from several passes: the higher confidence stays, so a star or join
    edge does not push out a parsed one."""
    return pick(stamped(None, *parts), ["src_key", "dst_key"], [F.col("confidence"), -F.col("_seq")]).drop("_seq")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose key is new are added."""
    new = pick(incoming, keys, [F.lit(0)])
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def harvest_usage(lineage: DataFrame, columns: DataFrame, tables: DataFrame, has_column: DataFrame) -> DataFrame:
    """HAS_COLUMN rows (source usage) for columns that lineage reads: of a table
    or view with a qualified name outside any file's namespace, and not there
    already."""
    real = tables.where(F.col("kind").isin("table", "view") & F.col("qualified").contains(".") & ~F.col("qualified").contains("::")).select("qualified")
    used = lineage.select(F.col("src_key").alias("id")).distinct().join(columns.select("id", "table_qualified"), "id")
    rows = used.join(real, F.col("table_qualified") == F.col("qualified"), "left_semi").select(F.col("table_qualified").alias("src_key"), F.col("id").alias("dst_key"), F.lit("usage").alias("source"))
    return rows.join(has_column.select("src_key", "dst_key"), ["src_key", "dst_key"], "left_anti")


def promote_derived(tables: DataFrame, catalogued: DataFrame) -> DataFrame:
    """Derived tables the catalog knows become tables."""
    c = catalogued.select(F.col("qualified").alias("_q")).distinct()
    j = tables.join(c, F.col("qualified") == F.col("_q"), "left")
    kind = F.when(F.col("_q").isNotNull() & (F.col("kind") == "derived"), "table").otherwise(F.col("kind"))
    return j.withColumn("kind", kind).drop("_q")


def exclude_tables(rows: DataFrame, cols: Sequence[str], noise: DataFrame) -> DataFrame:
    """Rows none of whose cols names a table of noise (one column, qualified)."""
    for i, c in enumerate(cols):
        rows = rows.join(noise.select(F.col("qualified").alias(f"_n{i}")).distinct(), F.col(c) == F.col(f"_n{i}"), "left_anti")
    return rows


def delete_files(graph: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The graph without what the files (one column, path) brought in: the file,
    its tables and their columns (unless the catalog or usage vouches for
    them), its queries with their edges, and lineage of these queries."""
    g = dict(graph)
    p = paths.select(F.col("path").alias("_f")).distinct()
    gone_t = g["sql_table"].join(p, F.col("defined_in_file") == F.col("_f"), "left_semi").select(F.col("qualified").alias("_t"))
    gone_q = g["sql_query"].join(p, F.col("file_path") == F.col("_f"), "left_semi").select(F.col("id").alias("_q"))
    mine = g["has_column"].join(gone_t, F.col("src_key") == F.col("_t"), "left_semi")
    kept = mine.where(F.col("source").isin("information_schema", "usage"))
    gone_c = mine.join(kept.select("dst_key"), "dst_key", "left_anti").select(F.col("dst_key").alias("_c"))
    anti = lambda df, col, who, key: df.join(who, F.col(col) == F.col(key), "left_anti")
    g["has_column"] = anti(g["has_column"], "dst_key", gone_c, "_c")
    g["sql_column"] = anti(g["sql_column"], "id", gone_c, "_c")
    g["column_lineage"] = anti(g["column_lineage"], "query_id", gone_q, "_q")
    for e in ("selects_from", "star_source", "join_col_resolve", "query_defined_in"):
        if e in g:
            g[e] = anti(g[e], "src_key", gone_q, "_q")
    g["sql_query"] = anti(g["sql_query"], "id", gone_q, "_q")
    g["sql_table"] = anti(g["sql_table"], "qualified", gone_t, "_t")
    if "defined_in" in g:
        g["defined_in"] = anti(g["defined_in"], "dst_key", p, "_f")
    g["file"] = anti(g["file"], "path", p, "_f")
    if "belongs_to" in g:
        g["belongs_to"] = anti(g["belongs_to"], "src_key", p, "_f")
    return g


def empty_graph(spark) -> dict[str, DataFrame]:
    """All relations without rows."""
    return {n: spark.createDataFrame([], s) for n, s in RELATIONS.items()}


def key_of(relation: str) -> list[str]:
    return KEYS[relation]
