"""Queries of the general data problems over the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import incremental as I
from ..operators import references as R
from ..operators import skew as S
from ..session import cut, job_dir, table

CARRIED = ("PASS_THROUGH", "RENAME", "STAR_EXPANSION")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for rel in ("selects_from", "column_lineage"):
        e = table(spark, d, rel).select("src_key", "dst_key", "indexed_at")
        out.append(S.key_profile(e, "dst_key", "src_key", "indexed_at").withColumn("relation", F.lit(rel)))
    return out[0].unionByName(out[1])


def p2_key_profile(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d)
    return p.select("relation", "dst_key", F.col("n_rows").alias("n_edges"), F.col("n_distinct").alias("n_sources"), F.col("mode").alias("top_source"), F.col("mode_rows").alias("top_edges"), F.col("last_time").alias("last_indexed_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = cut(_profiles(spark, d).select("relation", "dst_key", "n_rows"), "profile")
    # two totals, one per relation
    total = p.groupBy(F.col("relation").alias("_r")).agg(F.sum("n_rows").alias("_t"))
    j = p.join(F.broadcast(total), F.col("relation") == F.col("_r"))
    return j.where((F.col("n_rows") * 100 >= F.col("_t")) & F.col("dst_key").isNotNull()).select("relation", "dst_key")


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "column_lineage").select("dst_key", "confidence")
    w = S.weighted_percentiles(e, "dst_key", "confidence", [0.1, 0.5, 0.9])
    return w.select("dst_key", "point", F.col("value").alias("confidence"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "column_lineage").where(F.col("transform").isin(*CARRIED))
    return H.parent_links(e, "src_key", "dst_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(_links(spark, d), sizes=False)
    return h.select(F.col("node").alias("node_key"), F.col("root").alias("root_key"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(_links(spark, d), paths=True)
    return h.select(F.col("node").alias("node_key"), F.col("root").alias("root_key"), "depth", F.array_join("path", " > ").alias("path"), "n_descendants")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(_links(spark, d), paths=True, sizes=False)
    p = H.descendants(h)
    return p.select(F.col("ancestor").alias("ancestor_key"), F.col("node").alias("node_key"), "distance")


def p3_loops(spark: SparkSession, d: str) -> DataFrame:
    return H.loops(H.hierarchy(_links(spark, d), sizes=False))


def _ledger(spark: SparkSession) -> I.Ledger:
    """A ledger of its own for a query, in the shared folder; a pipeline keeps
    one and calls I.pending() on it again and again."""
    return I.Ledger(spark, f"{job_dir(spark)}/ledger-{uuid.uuid4().hex}")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "src_file").select("path", "sha", "indexed_at"), table(spark, d, "file_done"), table(spark, d, "index_run")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pending(spark, d).select("path", "sha")


def p4_pending(spark: SparkSession, d: str) -> DataFrame:
    p = I.pending(_ledger(spark), *_versions(spark, d))
    return p.select("path", "sha", F.col("seen_at").alias("indexed_at"), "reason")


def p4_resumed(spark: SparkSession, d: str) -> DataFrame:
    """p4_pending as a sequence of runs: one that sees the first half of the
    time, one that dies before its commit, one that dies after it, and a last
    one that finds nothing new."""
    led, v = _ledger(spark), _versions(spark, d)
    lo, hi = v[0].agg(F.min("indexed_at"), F.max("indexed_at")).first()
    if lo is not None:
        I.pending(led, *v, upto=lo + (hi - lo) / 2)
        for when in ("before", "after"):
            try:
                I.pending(led, *v, fail=when)
            except RuntimeError:
                pass
    return I.pending(led, *v).select("path", "sha", F.col("seen_at").alias("indexed_at"), "reason")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "column_lineage").select("src_key", "dst_key", F.when(F.col("query_id") != "", F.col("query_id")).alias("query_id"), "indexed_at")
    e = e.where(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull())
    # what stands behind query_id is looked up row by row; then one aggregation
    # gives an edge's time and the states of all its query ids
    q = R.check(e, ["query_id"], table(spark, d, "sql_query").select("id", "indexed_at", "deleted_at"), ["id"], "indexed_at", "deleted_at")
    has = lambda s: F.max(F.coalesce(F.col("ref_state") == s, F.lit(False)))
    edges = q.groupBy("src_key", "dst_key").agg(
        F.min("indexed_at").alias("t"), has("missing").alias("q_missing"), has("deleted").alias("q_deleted"), F.max(F.when(F.col("ref_state") == "alive", F.col("first_seen"))).alias("q_seen")
    )
    edges = cut(edges, "edges")
    period = F.date_format("t", "yyyy-MM").alias("period")
    late = F.col("q_seen") > F.col("t")
    found = F.filter(F.array(F.when(F.col("q_missing"), "missing"), F.when(F.col("q_deleted"), "deleted"), F.when(late, "late")), lambda x: x.isNotNull())
    to_q = edges.select(F.lit("sql_query").alias("ref_table"), period, "src_key", "dst_key", F.explode(found).alias("status"))
    cols = table(spark, d, "sql_column").select("id", "indexed_at", "deleted_at")
    to_col = R.orphans(edges.select("src_key", "dst_key", "t"), ["src_key"], cols, ["id"], "t", "indexed_at", "deleted_at")
    return to_col.select(F.lit("sql_column").alias("ref_table"), period, "src_key", "dst_key", "status").unionByName(to_q)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "period", "status").agg(F.count(F.lit(1)).alias("n_orphans"))


def p6_composite(spark: SparkSession, d: str) -> DataFrame:
    """Column keys of edges as composite references (catalog, db, table_name,
    col_name): short keys leave catalog, or catalog and db, null and match any
    column that agrees on the rest (MATCH PARTIAL)."""
    e = table(spark, d, "column_lineage").select("src_key").where(F.col("src_key").isNotNull()).groupBy("src_key").agg(F.count(F.lit(1)).alias("n_edges"))
    part = F.split("src_key", "\\.")
    n = F.size(part)
    for i, c in enumerate(("col_name", "table_name", "db", "catalog")):
        e = e.withColumn(c, F.when(n > i, F.element_at(part, -1 - i)))
    t = table(spark, d, "sql_column").select(F.coalesce("catalog", F.lit("")).alias("catalog"), F.coalesce("db", F.lit("")).alias("db"), "table_name", "col_name")
    keys = ["catalog", "db", "table_name", "col_name"]
    return R.orphans(e, keys, t, keys, match="partial").select("src_key", *keys, "n_edges")


QUERIES = {f.__name__: f for f in (p2_found, p2_key_profile, p2_confidence, p3_found, p3_paths, p3_descendants, p3_loops, p4_found, p4_pending, p4_resumed, p6_found, p6_report, p6_composite)}

_PROFILE = """
  SELECT '{rel}' AS relation, dst_key, CAST(sum(w) AS BIGINT) AS n_edges, CAST(count(src_key) AS BIGINT) AS n_sources,
         arg_min(src_key, (-w, src_key)) FILTER (src_key IS NOT NULL) AS top_source,
         CAST(max(w) FILTER (src_key IS NOT NULL) AS BIGINT) AS top_edges, max(last) AS last_indexed_at
  FROM (SELECT dst_key, src_key, count(*) AS w, max(indexed_at) AS last FROM {rel} GROUP BY ALL) GROUP BY dst_key"""

_TREE = """
WITH RECURSIVE l AS (SELECT dst_key AS node, min(src_key) AS parent FROM column_lineage
    WHERE transform IN ('PASS_THROUGH','RENAME','STAR_EXPANSION') AND src_key IS NOT NULL AND dst_key IS NOT NULL GROUP BY dst_key),
 k AS (SELECT node FROM l UNION SELECT parent FROM l),
 t AS (SELECT node, node AS root, 0 AS depth, [node] AS path FROM k WHERE node NOT IN (SELECT node FROM l)
       UNION ALL SELECT l.node, t.root, t.depth + 1, list_append(t.path, l.node) FROM t JOIN l ON l.parent = t.node),
 u AS (SELECT node FROM k WHERE node NOT IN (SELECT node FROM t)),
 w AS (SELECT node AS start, node AS at FROM u UNION SELECT w.start, l.parent FROM w JOIN l ON l.node = w.at),
 onloop AS (SELECT w.start AS node FROM w JOIN l ON l.node = w.at WHERE l.parent = w.start GROUP BY 1),
 low AS (SELECT w.start AS node, min(w.at) AS root FROM w WHERE w.at IN (SELECT node FROM onloop) GROUP BY 1)"""

ORACLE = {
    "p2_key_profile": _PROFILE.format(rel="selects_from") + " UNION ALL " + _PROFILE.format(rel="column_lineage"),
    "p2_found": """
SELECT 'selects_from' AS relation, dst_key FROM selects_from WHERE dst_key IS NOT NULL GROUP BY dst_key HAVING count(*) * 100 >= (SELECT count(*) FROM selects_from)
UNION ALL
SELECT 'column_lineage', dst_key FROM column_lineage WHERE dst_key IS NOT NULL GROUP BY dst_key HAVING count(*) * 100 >= (SELECT count(*) FROM column_lineage)""",
    "p2_confidence": " UNION ALL ".join(
        f"SELECT dst_key, {p}::DOUBLE AS point, quantile_disc(confidence, {p}) AS confidence FROM column_lineage WHERE dst_key IS NOT NULL AND confidence IS NOT NULL GROUP BY dst_key"
        for p in (0.1, 0.5, 0.9)
    ),
    "p3_found": _TREE + """
SELECT node AS node_key, root AS root_key, CAST(depth AS BIGINT) AS depth FROM t UNION ALL SELECT node, root, CAST(-1 AS BIGINT) FROM low""",
    "p3_descendants": _TREE + """
SELECT path[i] AS ancestor_key, node AS node_key, CAST(depth - i + 1 AS BIGINT) AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM t)""",
    "p3_loops": _TREE + """
SELECT root AS loop_key, CAST(count(*) FILTER (node IN (SELECT node FROM onloop)) AS BIGINT) AS n_nodes,
  CAST(count(*) FILTER (node NOT IN (SELECT node FROM onloop)) AS BIGINT) AS n_keys_below FROM low GROUP BY root""",
    "p4_pending": """
WITH cur AS (SELECT path, sha, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, sha DESC) rn
   FROM src_file WHERE sha IS NOT NULL AND path IS NOT NULL AND indexed_at IS NOT NULL) WHERE rn = 1),
 done AS (SELECT path, sha FROM (SELECT f.path, f.sha, row_number() OVER (PARTITION BY f.path ORDER BY r.finished_at DESC, r.run_id DESC, f.done_at DESC, f.sha DESC) rn
   FROM file_done f JOIN index_run r USING (run_id) WHERE r.status = 'success' AND r.finished_at IS NOT NULL) WHERE rn = 1)
SELECT c.path, c.sha, c.indexed_at, CASE WHEN d.path IS NULL THEN 'new' ELSE 'changed' END AS reason
FROM cur c LEFT JOIN done d USING (path) WHERE d.path IS NULL OR d.sha IS DISTINCT FROM c.sha""",
    "p6_composite": """
WITH e AS (SELECT src_key, string_split(src_key, '.') AS p, CAST(count(*) AS BIGINT) AS n_edges FROM column_lineage WHERE src_key IS NOT NULL GROUP BY src_key),
 k AS (SELECT src_key, n_edges, p[-1] AS col_name, p[-2] AS table_name, CASE WHEN len(p) > 2 THEN p[-3] END AS db, CASE WHEN len(p) > 3 THEN p[-4] END AS catalog FROM e),
 c AS (SELECT DISTINCT coalesce(catalog, '') AS catalog, coalesce(db, '') AS db, table_name, col_name FROM sql_column)
SELECT src_key, catalog, db, table_name, col_name, n_edges FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE (k.catalog IS NULL OR c.catalog = k.catalog)
  AND (k.db IS NULL OR c.db = k.db) AND (k.table_name IS NULL OR c.table_name = k.table_name) AND c.col_name = k.col_name)""",
}
ORACLE["p4_resumed"] = ORACLE["p4_pending"]
ORACLE["p4_found"] = f"SELECT path, sha FROM ({ORACLE['p4_pending']})"
ORACLE["p3_paths"] = _TREE + """, sub AS (SELECT a, count(*) AS n FROM (SELECT unnest(path[:depth]) AS a FROM t) GROUP BY a)
SELECT t.node AS node_key, t.root AS root_key, CAST(t.depth AS BIGINT) AS depth, array_to_string(t.path, ' > ') AS path, CAST(coalesce(sub.n, 0) AS BIGINT) AS n_descendants
FROM t LEFT JOIN sub ON sub.a = t.node UNION ALL SELECT node, root, CAST(-1 AS BIGINT), NULL, NULL FROM low"""
_REFS = """
WITH e AS (SELECT src_key, dst_key, min(indexed_at) AS t FROM column_lineage WHERE src_key IS NOT NULL AND dst_key IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT id, min(indexed_at) AS seen, bool_or(deleted_at IS NULL) AS alive FROM sql_column WHERE id IS NOT NULL GROUP BY id),
 q AS (SELECT id, min(indexed_at) AS seen, bool_or(deleted_at IS NULL) AS alive FROM sql_query WHERE id IS NOT NULL GROUP BY id),
 r AS (SELECT 'sql_column' AS ref_table, e.src_key, e.dst_key, e.t, c.seen, c.alive FROM e LEFT JOIN c ON c.id = e.src_key
   UNION ALL SELECT 'sql_query', e.src_key, e.dst_key, e.t, q.seen, q.alive
   FROM (SELECT DISTINCT src_key, dst_key, query_id FROM column_lineage WHERE query_id <> '') x JOIN e USING (src_key, dst_key) LEFT JOIN q ON q.id = x.query_id),
 o AS (SELECT DISTINCT ref_table, strftime(t, '%Y-%m') AS period, src_key, dst_key,
   CASE WHEN alive IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted' WHEN seen > t THEN 'late' END AS status FROM r)
"""
ORACLE["p6_found"] = _REFS + "SELECT * FROM o WHERE status IS NOT NULL"
ORACLE["p6_report"] = _REFS + "SELECT ref_table, period, status, CAST(count(*) AS BIGINT) AS n_orphans FROM o WHERE status IS NOT NULL GROUP BY 1, 2, 3"
