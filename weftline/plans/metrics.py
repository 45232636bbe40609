"""Coverage and health of a graph. Every metric is a one-row or small DataFrame;
existence tests are joins with distinct keys, never NOT IN."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import SYNTHETIC, WRITE_KINDS
from ..session import cut
from .base import load_graph, sql, table_of

Graph = dict[str, DataFrame]


def rate(part, whole):
    """Percentage; 0.0 where there is nothing to count."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def band(pct, good: float, fair: float, high_is_bad: bool = True):
    """Colour of a percentage by two thresholds."""
    if high_is_bad:
        return F.when(pct <= good, "green").when(pct <= fair, "yellow").otherwise("red")
    return F.when(pct >= good, "green").when(pct >= fair, "yellow").otherwise("red")


def _edges(g: Graph, no_temp: bool = False) -> DataFrame:
    """Lineage edges with their table and what the catalog knows: col_known,
    table_known, synthetic."""
    e = g["column_lineage"]
    if no_temp:
        e = e.where(~F.col("transform").eqNullSafe(F.lit("TEMP_INLINE")))
    # many edges share a target: flags are looked up once per key, so a hot key
    # is one row of the join
    keys = e.select("dst_key").distinct().withColumn("dst_table", table_of("dst_key"))
    cols = g["has_column"].select(F.col("dst_key").alias("_c")).distinct()
    tabs = g["has_column"].select(F.col("src_key").alias("_t")).distinct()
    syn = g["sql_table"].where(F.col("kind").isin(*SYNTHETIC)).select(F.col("qualified").alias("_y"), F.col("kind").alias("_kind"))
    keys = keys.join(cols, F.col("dst_key") == F.col("_c"), "left").join(tabs, F.col("dst_table") == F.col("_t"), "left").join(syn, F.col("dst_table") == F.col("_y"), "left")
    flags = keys.select("dst_key", "dst_table", F.col("_c").isNotNull().alias("col_known"), F.col("_t").isNotNull().alias("table_known"), F.col("_kind").alias("synthetic"))
    n = e.groupBy("dst_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("inferred_from_source_name").alias("n_inferred"))
    return n.join(flags, "dst_key")


def _sum(cond, n: str = "n"):
    return F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0)).cast("long")


def catalog_coverage(g: Graph) -> DataFrame:
    a = g["has_column"].agg(F.count_distinct("src_key").alias("catalogued_tables"))
    b = g["sql_table"].agg(F.count(F.lit(1)).alias("total_tables"))
    return a.join(b).withColumn("pct", rate(F.col("catalogued_tables"), F.col("total_tables")))


def edge_health(g: Graph) -> DataFrame:
    return _edges(g).agg(_sum(F.col("table_known")).alias("good_edges"), _sum(F.lit(True)).alias("total_edges")).withColumn("pct", rate(F.col("good_edges"), F.col("total_edges")))


def edge_health_strict(g: Graph) -> DataFrame:
    return _edges(g, True).agg(_sum(F.col("col_known")).alias("good_edges"), _sum(F.lit(True)).alias("total_edges")).withColumn("pct", rate(F.col("good_edges"), F.col("total_edges")))


def edge_health_scoped(g: Graph) -> DataFrame:
    real = F.col("synthetic").isNull()
    return _edges(g, True).agg(_sum(F.col("col_known") & real).alias("good_edges"), _sum(real).alias("total_edges")).withColumn("pct", rate(F.col("good_edges"), F.col("total_edges")))


def phantom_rate(g: Graph) -> DataFrame:
    a = g["column_lineage"].agg(F.count_if("inferred_from_source_name").alias("phantom"), F.count(F.lit(1)).alias("total"))
    return a.withColumn("pct", rate(F.col("phantom"), F.col("total")))


def phantom_split(g: Graph) -> DataFrame:
    ck, tk = F.col("col_known"), F.col("table_known")
    return _edges(g).agg(_sum(ck, "n_inferred").alias("confirmed"), _sum(~ck & tk, "n_inferred").alias("contradicted"), _sum(~tk, "n_inferred").alias("unverified"))


def blindspots(g: Graph) -> DataFrame:
    return _edges(g).where("not table_known").agg(F.count_distinct("dst_table").alias("blindspots"))


def blindspots_weighted(g: Graph) -> DataFrame:
    """Tables by edges into columns the catalog does not know, with running
    total, grand total and rank."""
    bad = _edges(g).where("not col_known and synthetic is null").groupBy("dst_table").agg(F.sum("n").alias("bad_edges"))
    return running(bad, [F.desc("bad_edges"), F.col("dst_table")], "bad_edges")


def running(df: DataFrame, order: list, value: str) -> DataFrame:
    """df with running_total, grand_total and rank over a total order, without
    one task that holds everything: rows are sorted by ranges, each range is
    summed on its own, and the sums of the ranges before it (one number per
    range reaches the driver) are added."""
    cols = df.columns
    # as one table on disk: its files are the ranges, so nothing is ranged twice
    part = cut(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = {r[0]: (r[1] or 0, r[2]) for r in part.groupBy("_range").agg(F.sum(value), F.count(F.lit(1))).collect()}
    before, total, n = [], 0, 0
    for k in sorted(sums):
        before += [F.lit(k), F.struct(F.lit(total).cast("long").alias("t"), F.lit(n).cast("int").alias("n"))]
        total, n = total + sums[k][0], n + sums[k][1]
    w = W.partitionBy("_range").orderBy(*order)
    at = F.create_map(*before)[F.col("_range")] if before else F.lit(None).cast("struct<t:bigint,n:int>")
    return part.select(
        *cols, (F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + at["t"]).cast("long").alias("running_total"),
        F.lit(total).cast("long").alias("grand_total"), (F.row_number().over(w) + at["n"]).cast("int").alias("rank"),
    )


def tables_for_share(g: Graph, share: float = 0.8) -> DataFrame:
    """How many of the worst tables hold `share` of the bad edges."""
    b = blindspots_weighted(g)
    return b.agg(F.count_if(F.col("running_total") - F.col("bad_edges") < F.col("grand_total") * share).alias("tables"))


def fingerprint(g: Graph) -> DataFrame:
    n = lambda r, name: g[r].agg(F.count(F.lit(1)).alias(name))
    return n("file", "files").join(n("sql_table", "tables")).join(n("sql_column", "columns")).join(n("sql_query", "queries")).join(n("column_lineage", "edges"))


def degraded_parse(g: Graph) -> DataFrame:
    a = g["sql_query"].agg(F.count_if("parse_failed").alias("degraded"), F.count(F.lit(1)).alias("total"))
    return a.withColumn("pct", rate(F.col("degraded"), F.col("total")))


def degraded_by_dir(g: Graph) -> DataFrame:
    """By first folder under the repository a query's file lies in."""
    r = g["repo"].select(F.col("path").alias("root"))
    f = g["sql_query"].where(F.col("file_path").isNotNull()).select("file_path", "parse_failed", F.regexp_extract("file_path", r"^(/[^/]+/[^/]+/[^/]+)/", 1).alias("_root"))
    f = f.join(r, F.col("_root") == F.col("root"))
    rest = F.substring(F.col("file_path"), F.length("root") + 2, F.length("file_path"))
    top = F.when(F.instr(rest, "/") > 0, F.split_part(rest, F.lit("/"), F.lit(1))).otherwise("(root)")
    return f.groupBy("root", top.alias("top_dir")).agg(F.count_if("parse_failed").alias("degraded"), F.count(F.lit(1)).alias("total"))


def _writes(g: Graph) -> DataFrame:
    return g["sql_query"].where(F.col("kind").isin(*WRITE_KINDS))


def zero_edge_writes(g: Graph) -> DataFrame:
    e = g["column_lineage"].select(F.col("query_id").alias("_q")).distinct()
    j = _writes(g).select("id").join(e, F.col("id") == F.col("_q"), "left")
    return j.agg(F.count_if(F.col("_q").isNull()).alias("zero_edge_writes"), F.count(F.lit(1)).alias("total_writes"))


def cte_collisions(g: Graph) -> DataFrame:
    syn = g["sql_table"].where(F.col("kind").isin("cte", "derived")).select(F.col("qualified").alias("t"))
    e = g["column_lineage"].select("dst_key", "query_id", table_of("dst_key").alias("t")).join(syn, "t", "left_semi")
    f = e.join(g["sql_query"].select(F.col("id").alias("query_id"), "file_path"), "query_id", "left").select("dst_key", "file_path").distinct()
    n = f.groupBy("dst_key").agg(F.count("file_path").alias("nf"))
    return n.agg(F.count_if(F.col("nf") > 1).alias("cte_collisions"))


def rescuable_unqualified(g: Graph) -> DataFrame:
    """Bad edges into a bare table name that the catalog has with a schema: the
    last part of the catalogued name is compared, so the test is an equality."""
    last = g["has_column"].where(F.col("src_key").contains(".")).select(F.element_at(F.split("src_key", r"\."), -1).alias("_l")).distinct()
    bad = _edges(g).where("not col_known and instr(dst_table, '.') = 0")
    return bad.join(last, F.col("dst_table") == F.col("_l"), "left_semi").agg(_sum(F.lit(True)).alias("rescuable"))


def info_schema_rows(g: Graph) -> DataFrame:
    return g["has_column"].where("source = 'information_schema'").agg(F.count(F.lit(1)).alias("n"))


def cte_source_gap(g: Graph) -> DataFrame:
    q = _writes(g).where("target_table <> ''").select("id")
    real = g["column_lineage"].where("inferred_from_source_name = false").select(F.col("query_id").alias("id")).distinct()
    return q.join(real, "id", "left_semi").join(g["selects_from"].select(F.col("src_key").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def resolvable_write_edges(g: Graph) -> DataFrame:
    q = _writes(g).where("target_table <> ''").select(F.col("id").alias("query_id"))
    q = q.join(g["selects_from"].select(F.col("src_key").alias("query_id")), "query_id", "left_semi")
    e = g["column_lineage"].where(~F.col("transform").eqNullSafe(F.lit("TEMP_INLINE")))
    return e.join(q, "query_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def transitive_edges(g: Graph) -> DataFrame:
    return g["column_lineage"].where("transform = 'TEMP_INLINE'").agg(F.count(F.lit(1)).alias("n"))


def qualify_failures(g: Graph) -> DataFrame:
    return g["sql_query"].agg(F.count_if("qualify_failed").alias("n"))


def by_transform(g: Graph) -> DataFrame:
    return g["column_lineage"].groupBy("transform").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def column_edge_counts(g: Graph) -> DataFrame:
    """Per catalogued column the edges in and out of it; columns without either
    are what extraction misses."""
    i = g["column_lineage"].groupBy(F.col("dst_key").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    o = g["column_lineage"].groupBy(F.col("src_key").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    c = g["has_column"].select(F.col("dst_key").alias("id"), "source").join(i, "id", "left").join(o, "id", "left")
    return c.select("id", "source", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def usage(calls: DataFrame, feedback: DataFrame, now) -> DataFrame:
    """Usage of the tools: calls in all and in the last 7 days, share of free
    SQL, and the rate of true positives if at least five were judged. calls:
    (tool, called_at); feedback: (verdict: TP, FP, FN)."""
    a = calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("called_at") > F.lit(now) - F.expr("INTERVAL 7 DAYS")).alias("calls_7d"), F.count_if(F.col("tool") == "execute_sql").alias("sql_calls")
    )
    b = feedback.agg(F.count_if(F.col("verdict") == "TP").alias("tp"), F.count(F.lit(1)).alias("judged"))
    j = a.join(b)
    return j.select("calls", "calls_7d", rate(F.col("sql_calls"), F.col("calls")).alias("sql_pct"), F.when(F.col("judged") >= 5, rate(F.col("tp"), F.col("judged"))).alias("tp_pct"))


def top_tools(calls: DataFrame, k: int = 3) -> DataFrame:
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tool").limit(k)


def _usage(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    calls = ev.select(F.when(F.col("event_type") == "view", "execute_sql").otherwise(F.col("event_type")).alias("tool"), F.col("ts").alias("called_at"))
    judged = ev.where(F.col("value").isNotNull()).select(F.when(F.col("value") > 50, "TP").otherwise("FP").alias("verdict"))
    return usage(calls, judged, ev.agg(F.max("ts")).first()[0])


_FUNCS = {
    "m01_catalog_coverage": catalog_coverage, "m02_edge_health": edge_health, "m03_edge_health_strict": edge_health_strict, "m04_edge_health_scoped": edge_health_scoped,
    "m05_phantom_rate": phantom_rate, "m06_phantom_split": phantom_split, "m07_blindspots": blindspots, "m08_blindspots_weighted": blindspots_weighted,
    "m08_tables_for_80_pct": tables_for_share, "m09_fingerprint": fingerprint, "m10_degraded_parse": degraded_parse, "m11_degraded_by_dir": degraded_by_dir,
    "m12_zero_edge_writes": zero_edge_writes, "m13_cte_collisions": cte_collisions, "m14_rescuable": rescuable_unqualified, "m15_info_schema_rows": info_schema_rows,
    "m16_cte_source_gap": cte_source_gap, "m17_resolvable_write_edges": resolvable_write_edges, "m18_transitive_edges": transitive_edges, "m19_qualify_failures": qualify_failures,
    "m_by_transform": by_transform, "m_column_edge_counts": column_edge_counts,
}


def _plan(f):
    return lambda spark, d: f(load_graph(spark, d))


QUERIES = {**{k: _plan(f) for k, f in _FUNCS.items()}, "m20_usage": _usage}

_T = "regexp_replace(cl.dst_key, '\\.?[^.]*$', '')"
_COL = "EXISTS (SELECT 1 FROM has_ h WHERE h.dst_key = cl.dst_key)"
_TAB = f"EXISTS (SELECT 1 FROM has_ h WHERE h.src_key = {_T})"
_REAL = f"NOT EXISTS (SELECT 1 FROM table_ t WHERE t.qualified = {_T} AND t.kind IN ('cte','derived','temp'))"
_W = "('INSERT','MERGE','CREATE_TABLE','UPDATE')"
_B = "CAST({} AS BIGINT)"


def _cnt(cond: str) -> str:
    return f"CAST(count(*) FILTER ({cond}) AS BIGINT)"


def _pct(a: str, b: str) -> str:
    return f"coalesce(100.0::DOUBLE * {a} / nullif({b}, 0), 0.0::DOUBLE)"


_NOTEMP = "cl.transform IS DISTINCT FROM 'TEMP_INLINE'"
_BLIND = f""", bad AS (SELECT {_T} AS dst_table FROM lineage_ cl WHERE NOT {_COL} AND {_REAL}),
 per AS (SELECT dst_table, CAST(count(*) AS BIGINT) AS bad_edges FROM bad GROUP BY 1),
 ranked AS (SELECT dst_table, bad_edges, CAST(sum(bad_edges) OVER (ORDER BY bad_edges DESC, dst_table ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total,
  CAST(sum(bad_edges) OVER () AS BIGINT) AS grand_total, CAST(row_number() OVER (ORDER BY bad_edges DESC, dst_table) AS INTEGER) AS rank FROM per)
"""

ORACLE = {k: sql(v) for k, v in {
    "m01_catalog_coverage": f"SELECT a AS catalogued_tables, b AS total_tables, {_pct('a', 'b')} AS pct FROM (SELECT (SELECT count(DISTINCT src_key) FROM has_) AS a, (SELECT count(*) FROM table_) AS b)",
    "m02_edge_health": f"SELECT a AS good_edges, b AS total_edges, {_pct('a', 'b')} AS pct FROM (SELECT {_cnt(_TAB)} AS a, count(*) AS b FROM lineage_ cl)",
    "m03_edge_health_strict": f"SELECT a AS good_edges, b AS total_edges, {_pct('a', 'b')} AS pct FROM (SELECT {_cnt(_COL)} AS a, count(*) AS b FROM lineage_ cl WHERE {_NOTEMP})",
    "m04_edge_health_scoped": f"SELECT a AS good_edges, b AS total_edges, {_pct('a', 'b')} AS pct FROM (SELECT {_cnt(_COL)} AS a, count(*) AS b FROM lineage_ cl WHERE {_NOTEMP} AND {_REAL})",
    "m05_phantom_rate": f"SELECT a AS phantom, b AS total, {_pct('a', 'b')} AS pct FROM (SELECT {_cnt('inferred_from_source_name')} AS a, count(*) AS b FROM lineage_)",
    "m06_phantom_split": f"SELECT {_cnt(_COL)} AS confirmed, {_cnt(f'NOT {_COL} AND {_TAB}')} AS contradicted, {_cnt(f'NOT {_TAB}')} AS unverified FROM lineage_ cl WHERE inferred_from_source_name",
    "m07_blindspots": f"SELECT count(DISTINCT {_T}) AS blindspots FROM lineage_ cl WHERE NOT {_TAB}",
    "m08_blindspots_weighted": _BLIND + "SELECT * FROM ranked",
    "m08_tables_for_80_pct": _BLIND + f"SELECT {_cnt('running_total - bad_edges < grand_total * 0.8::DOUBLE')} AS tables FROM ranked",
    "m09_fingerprint": "SELECT (SELECT count(*) FROM file_) AS files, (SELECT count(*) FROM table_) AS tables, (SELECT count(*) FROM column_) AS columns, (SELECT count(*) FROM query_) AS queries, (SELECT count(*) FROM lineage_) AS edges",
    "m10_degraded_parse": f"SELECT a AS degraded, b AS total, {_pct('a', 'b')} AS pct FROM (SELECT {_cnt('parse_failed')} AS a, count(*) AS b FROM query_)",
    "m11_degraded_by_dir": f"""SELECT r.path AS root, CASE WHEN instr(substr(q.file_path, length(r.path) + 2), '/') > 0 THEN split_part(substr(q.file_path, length(r.path) + 2), '/', 1) ELSE '(root)' END AS top_dir,
 {_cnt('q.parse_failed')} AS degraded, count(*) AS total FROM query_ q JOIN repo_ r ON starts_with(q.file_path, r.path || '/') GROUP BY 1, 2""",
    "m12_zero_edge_writes": f"SELECT {_cnt('NOT EXISTS (SELECT 1 FROM lineage_ cl WHERE cl.query_id = q.id)')} AS zero_edge_writes, count(*) AS total_writes FROM query_ q WHERE kind IN {_W}",
    "m13_cte_collisions": f"""SELECT {_cnt('nf > 1')} AS cte_collisions FROM (SELECT cl.dst_key, count(DISTINCT q.file_path) AS nf FROM lineage_ cl LEFT JOIN query_ q ON q.id = cl.query_id
 WHERE {_T} IN (SELECT qualified FROM table_ WHERE kind IN ('cte','derived')) GROUP BY 1)""",
    "m14_rescuable": f"SELECT count(*) AS rescuable FROM lineage_ cl WHERE NOT {_COL} AND instr({_T}, '.') = 0 AND EXISTS (SELECT 1 FROM has_ h WHERE ends_with(h.src_key, '.' || {_T}))",
    "m15_info_schema_rows": "SELECT count(*) AS n FROM has_ WHERE source = 'information_schema'",
    "m16_cte_source_gap": f"""SELECT count(*) AS n FROM query_ q WHERE kind IN {_W} AND target_table <> '' AND EXISTS (SELECT 1 FROM lineage_ cl WHERE cl.query_id = q.id AND cl.inferred_from_source_name = false)
 AND NOT EXISTS (SELECT 1 FROM reads_ r WHERE r.src_key = q.id)""",
    "m17_resolvable_write_edges": f"SELECT count(*) AS n FROM lineage_ cl JOIN query_ q ON q.id = cl.query_id WHERE q.kind IN {_W} AND q.target_table <> '' AND {_NOTEMP} AND EXISTS (SELECT 1 FROM reads_ r WHERE r.src_key = q.id)",
    "m18_transitive_edges": "SELECT count(*) AS n FROM lineage_ WHERE transform = 'TEMP_INLINE'",
    "m19_qualify_failures": f"SELECT {_cnt('qualify_failed')} AS n FROM query_",
    "m_by_transform": "SELECT transform, count(*) AS n, avg(confidence) AS mean_confidence FROM lineage_ GROUP BY 1",
    "m_column_edge_counts": """SELECT h.dst_key AS id, h.source, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM has_ h LEFT JOIN (SELECT dst_key, count(*) n FROM lineage_ GROUP BY 1) i ON i.dst_key = h.dst_key
 LEFT JOIN (SELECT src_key, count(*) n FROM lineage_ GROUP BY 1) o ON o.src_key = h.dst_key""",
}.items()}
ORACLE["m20_usage"] = f"""WITH a AS (SELECT count(*) AS calls, {_cnt("ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")} AS calls_7d, {_cnt("event_type = 'view'")} AS s FROM events),
b AS (SELECT {_cnt('value > 50')} AS tp, count(*) AS judged FROM events WHERE value IS NOT NULL)
SELECT calls, calls_7d, {_pct('s', 'calls')} AS sql_pct, CASE WHEN judged >= 5 THEN {_pct('tp', 'judged')} END AS tp_pct FROM a, b"""
