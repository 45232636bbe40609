"""Sources and streaming operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dominant_causes, glob_regex, skip_counts
from ..sources import files as S
from ..streaming import watch as W
from ..session import table
from .base import load_graph, sql


def s02_ignored(spark: SparkSession, d: str) -> DataFrame:
    f = load_graph(spark, d)["file"]
    return f.select("path", S.ignored(F.col("path"), ["backup/", "*.hql", "fix_*_0[0-9a-f]?.sql"]).alias("ignored"))


def s04_catalog(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    c = table(spark, d, "sql_column").where(F.col("id").isNotNull()).select(F.col("table_qualified").alias("qualified"), "catalog", "db", F.col("table_name").alias("name"), "col_name").where(F.col("qualified").isNotNull() & F.col("col_name").isNotNull())
    g = S.apply_catalog(g, c.dropDuplicates(["qualified", "col_name"]))
    return g["has_column"].groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def s06_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Warnings for consumers declared on the ten most written tables."""
    g = load_graph(spark, d)
    t = table(spark, d, "selects_from").groupBy(F.col("dst_key").alias("table")).agg(F.count(F.lit(1)).alias("n")).where(F.col("table").isNotNull())
    decl = t.select(F.concat(F.lit("app_"), "table").alias("name"), F.lit("application").alias("consumer_type"), "table")
    return S.declared_consumers(g, decl, ("mart.", "rpt."))[1]


def s07_delta(spark: SparkSession, d: str) -> DataFrame:
    """Changes between the state at half time and now."""
    f = table(spark, d, "src_file").where(F.col("path").isNotNull() & F.col("sha").isNotNull() & F.col("indexed_at").isNotNull())
    lo, hi = f.agg(F.min("indexed_at"), F.max("indexed_at")).first()
    half = F.lit(lo + (hi - lo) / 2 if lo else None).cast(f.schema["indexed_at"].dataType)
    state = lambda x: x.groupBy("path").agg(F.max(F.struct("indexed_at", "sha")).alias("v")).select("path", "v.sha")
    return S.delta(state(f.where(F.col("indexed_at") <= half)), state(f))


_RULES = [("*.party_master", "hub", "red"), ("mart.*", "mart", None), ("*_daily_*", "daily", "blue"), ("lake.*", "lake", "green")]


def s08_facets(spark: SparkSession, d: str) -> DataFrame:
    t = load_graph(spark, d)["sql_table"]
    rules = spark.createDataFrame([(i, glob_regex(p), l, c) for i, (p, l, c) in enumerate(_RULES)], "pos int, regex string, label string, color string")
    f = S.facets(t, rules)
    return f.select("qualified", F.array_join("labels", "|").alias("labels"), "color")


def x30_causes(spark: SparkSession, d: str) -> DataFrame:
    """Dominant cause per file of messages built from the claimed causes."""
    return dominant_causes(_messages(spark, d))


def x31_skip_counts(spark: SparkSession, d: str) -> DataFrame:
    s = skip_counts(_messages(spark, d))
    return s.select("path", F.explode(F.from_json("skip_counts", "map<string,int>")).alias("bucket", "n"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "src_file").where(F.col("path").isNotNull())
    c = F.col("parse_cause")
    m = (
        F.when(c == "timeout", "timeout:30s").when(c == "worker_error", "worker_error:Eof:").when(c == "E1", "col_lineage:a:Cannot find column 'NULL'").when(c == "E2", "col_lineage:a:Cannot find column 'YEAR(x)'")
        .when(c == "E3", "col_lineage:a:Cannot find column: Unexpected token").when(c == "E5", "col_lineage:a:Cannot find column 'x'").when(c == "E8", "col_lineage_skip:dynamic_source").when(c == "qualify_failed", "col_lineage_skip:qualify_failed:x")
        .when(c == "func_fallback", "col_lineage_skip:func_fallback:x").when(c == "pure_ddl_skip", "col_lineage_skip:pure_ddl_file").otherwise(c)
    )
    return f.select("path", m.alias("message"))


def w_debounce(spark: SparkSession, d: str) -> DataFrame:
    return W.debounce(table(spark, d, "events"), "user_id", "ts", "6 hours", None)


def w_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    r = e.select(F.when(F.col("event_type") == "purchase", "index").otherwise("reindex").alias("kind"), F.col("user_id").cast("string").alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return W.coalesce_requests(r)


QUERIES = {f.__name__: f for f in (s02_ignored, s04_catalog, s06_consumers, s07_delta, s08_facets, x30_causes, x31_skip_counts, w_debounce, w_coalesce)}

_CAUSE = "CASE WHEN parse_cause IN ('timeout','worker_error','E1','E2','E3','E5','E8','qualify_failed','func_fallback','pure_ddl_skip') THEN parse_cause ELSE 'other' END"
ORACLE = {
    "s02_ignored": sql("SELECT path, regexp_matches(path, '(^|/)backup/') OR regexp_matches(path, '\\.hql$') OR regexp_matches(path, '(^|/)fix_[^/]*_0[0-9a-f][^/]\\.sql$') OR regexp_matches(path, '(_bck|_backup)(_[^/]*)?\\.sql$') AS ignored FROM file_"),
    "s04_catalog": sql(""", c AS (SELECT DISTINCT table_qualified AS q, table_qualified || '.' || col_name AS id FROM sql_column WHERE id IS NOT NULL AND table_qualified IS NOT NULL AND col_name IS NOT NULL),
 u AS (SELECT src_key, dst_key, CASE source WHEN 'ddl' THEN 3 WHEN 'information_schema' THEN 2 WHEN 'usage' THEN 1 ELSE 0 END AS r, 0 AS s, source FROM has_ UNION ALL SELECT q, id, 2, 1, 'information_schema' FROM c)
SELECT source, count(*) AS n FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY src_key, dst_key ORDER BY r DESC, s) = 1) GROUP BY 1"""),
    "s06_consumers": sql("""SELECT 'app_' || x.t AS name, lower(x.t) AS "table", CASE WHEN k.qualified IS NULL THEN 'unknown table' ELSE 'outside the presentation layer' END AS warning FROM (SELECT DISTINCT dst_key AS t FROM selects_from WHERE dst_key IS NOT NULL) x
 LEFT JOIN table_ k ON k.qualified = lower(x.t) WHERE k.qualified IS NULL OR NOT (starts_with(lower(x.t), 'mart.') OR starts_with(lower(x.t), 'rpt.'))"""),
    "s07_delta": """WITH f AS (SELECT * FROM src_file WHERE path IS NOT NULL AND sha IS NOT NULL AND indexed_at IS NOT NULL), h AS (SELECT min(indexed_at) + (max(indexed_at) - min(indexed_at)) / 2 AS half FROM f),
 b AS (SELECT path, arg_max(sha, (indexed_at, sha)) AS sha FROM f, h WHERE indexed_at <= half GROUP BY 1), a AS (SELECT path, arg_max(sha, (indexed_at, sha)) AS sha FROM f GROUP BY 1)
SELECT path, CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'M' END AS change FROM b FULL JOIN a USING (path) WHERE a.path IS NULL OR b.path IS NULL OR a.sha IS DISTINCT FROM b.sha""",
    "s08_facets": sql("""SELECT qualified, array_to_string(list_filter([CASE WHEN q LIKE '%.party^_master' ESCAPE '^' THEN 'hub' END, CASE WHEN starts_with(q, 'mart.') THEN 'mart' END, CASE WHEN contains(q, '_daily_') THEN 'daily' END, CASE WHEN starts_with(q, 'lake.') THEN 'lake' END], lambda x: x IS NOT NULL), '|') AS labels,
 CASE WHEN q LIKE '%.party^_master' ESCAPE '^' THEN 'red' WHEN contains(q, '_daily_') THEN 'blue' WHEN starts_with(q, 'lake.') THEN 'green' END AS color FROM (SELECT qualified, lower(qualified) AS q FROM table_)
WHERE q LIKE '%.party^_master' ESCAPE '^' OR starts_with(q, 'mart.') OR contains(q, '_daily_') OR starts_with(q, 'lake.')"""),
    "x30_causes": f"""WITH m AS (SELECT path, {_CAUSE} AS b FROM src_file WHERE path IS NOT NULL), n AS (SELECT path, b, count(*) AS n FROM m WHERE b <> 'other' GROUP BY 1, 2),
 t AS (SELECT path, b FROM n QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, list_position(['timeout','worker_error','E8','E3','E2','E5','E1','qualify_failed','func_fallback','pure_ddl_skip'], b)) = 1)
SELECT p.path, coalesce(t.b, '') AS parse_cause, coalesce(t.b, '') IN ('E1','E2','E3','E5','E8','timeout','worker_error','func_fallback','qualify_failed') AS parse_failed FROM (SELECT DISTINCT path FROM m) p LEFT JOIN t USING (path)""",
    "x31_skip_counts": f"SELECT path, {_CAUSE} AS bucket, CAST(count(*) AS INTEGER) AS n FROM src_file WHERE path IS NOT NULL GROUP BY 1, 2",
    "w_debounce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id AS key, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM k GROUP BY user_id, i""",
    "w_coalesce": """WITH r AS (SELECT CASE WHEN event_type = 'purchase' THEN 'index' ELSE 'reindex' END AS kind, CAST(user_id AS VARCHAR) AS path, ts AS "at", event_id AS seq FROM events),
 o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind, path ORDER BY "at" DESC, seq DESC) = 1)
SELECT o.* FROM o LEFT JOIN (SELECT * FROM o WHERE kind = 'index') f ON f.path = o.path WHERE o.kind = 'index' OR f.path IS NULL OR (o."at", o.seq) > (f."at", f.seq)""",
}
