"""SQL files, catalogs, manifests and declarations as DataFrames."""

from __future__ import annotations

import subprocess
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NOISE_GLOBS, glob_regex

#: Backup scripts that are never read, and their dated forms.
IGNORED = ["*_bck.sql", "*_bck_*.sql", "*_backup.sql", "*_backup_*.sql"]
IGNORED_DATED = ["*_[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9].sql", "*_[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].sql"]
DIALECTS = (None, "ansi", "snowflake", "bigquery", "postgres", "tsql")


def dialect(name: str | None) -> str:
    """The dialect a name stands for: unknown ones are read as ansi."""
    return name if name in DIALECTS and name else "ansi"


def wildmatch_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ** crosses folders, * and ? do
    not; one without a slash matches at any depth, a leading slash anchors, a
    trailing one means a folder."""
    p, out, i = pattern.strip(), "", 0
    anchored = p.startswith("/") or "/" in p.rstrip("/")
    folder = p.endswith("/")
    p = p.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", j + 1
        else:
            out, i = out + ("\\" if p[i] in r".^$+{}()|\[]" else "") + p[i], i + 1
    head = "^" if anchored else "(?:^|/)"
    return head + out + ("/" if folder else "(?:/|$)")


def ignored(path, patterns: Sequence[str] = ()):
    """Whether a repository-relative path matches a pattern; a later pattern
    with ! takes a path back in."""
    out = F.lit(False)
    for p in [*IGNORED, *patterns]:
        if p.startswith("!"):
            out = out & ~path.rlike(wildmatch_regex(p[1:]))
        elif p.strip() and not p.startswith("#"):
            out = out | path.rlike(wildmatch_regex(p))
    return F.coalesce(out, F.lit(False))


def tracked(root: str) -> list[str] | None:
    """SQL files git tracks under root, or None without git."""
    try:
        r = subprocess.run(["git", "-C", root, "ls-files", "--cached", "-z", "*.sql"], capture_output=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted(x for x in r.stdout.decode("utf-8", "replace").split("\0") if x) if r.returncode == 0 else None


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """(path, content, sha) of all .sql files under root, path relative to it.
    The listing and the reading are Spark's, so any file system works. only
    keeps to a list of paths, such as tracked()'s."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    full = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:(//)?", "")
    df = df.select(F.substring(full, F.length(F.lit(base)) + 1 if "://" not in base else F.instr(full, base) + len(base), F.length(full)).alias("path"), F.col("value").alias("content"), F.sha1(F.col("value").cast("binary")).alias("sha"))
    df = df.where(~ignored(F.col("path"), patterns))
    if only is not None:
        keep = spark.createDataFrame([(p,) for p in only], "_p string")
        df = df.join(keep, F.col("path") == F.col("_p"), "left_semi")
    return df


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): A, M or D between two states (path, sha). A renamed file
    is a D and an A."""
    b, a = before.select(F.col("path").alias("_b"), F.col("sha").alias("_bs")), after.select(F.col("path").alias("_a"), F.col("sha").alias("_as"))
    j = b.join(a, F.col("_b") == F.col("_a"), "full_outer")
    change = F.when(F.col("_b").isNull(), "A").when(F.col("_a").isNull(), "D").when(~F.col("_bs").eqNullSafe(F.col("_as")), "M")
    return j.select(F.coalesce("_b", "_a").alias("path"), change.alias("change")).where(F.col("change").isNotNull())


_NAMES = {"table_schema": ("table_schema", "schema", "schema_name"), "table_name": ("table_name", "table"), "column_name": ("column_name", "column"), "table_catalog": ("table_catalog", "catalog", "database")}


def catalog_csv(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(qualified, catalog, db, name, col_name) of an information-schema export:
    comma or semicolon by its header; names trimmed, in lower case, schema
    aliases folded; rows without schema, table or column left out; each column
    once. Missing header columns are an error."""
    head = spark.read.text(path).first()
    sep = ";" if head and head[0].count(";") > head[0].count(",") else ","
    df = spark.read.csv(path, header=True, sep=sep)
    have = {c.strip().strip("﻿").lower(): c for c in df.columns}
    got = {}
    for k, names in _NAMES.items():
        got[k] = next((have[n] for n in names if n in have), None)
    missing = [k for k in ("table_schema", "table_name", "column_name") if got[k] is None]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}")
    col = lambda k: F.lower(F.trim(F.col(f"`{got[k]}`"))) if got[k] else F.lit(None).cast("string")
    db = col("table_schema")
    for a, b in (aliases or {}).items():
        db = F.when(db == a.lower(), b.lower()).otherwise(db)
    r = df.select(col("table_catalog").alias("catalog"), db.alias("db"), col("table_name").alias("name"), col("column_name").alias("col_name"))
    r = r.where((F.col("db") != "") & (F.col("name") != "") & (F.col("col_name") != ""))
    return r.select(F.concat_ws(".", "db", "name").alias("qualified"), "catalog", "db", "name", "col_name").dropDuplicates(["qualified", "col_name"])


def apply_catalog(graph: dict[str, DataFrame], catalog: DataFrame) -> dict[str, DataFrame]:
    """The graph with a catalog's tables (if absent), columns and HAS_COLUMN
    rows (information_schema, by precedence); derived tables it knows become
    tables."""
    from ..operators import merge as M

    g = dict(graph)
    t = catalog.select("qualified", "catalog", "db", "name", F.lit("table").alias("kind"), F.lit("").alias("defined_in_file")).dropDuplicates(["qualified"])
    g["sql_table"] = M.promote_derived(M.insert_absent(graph["sql_table"], t, ["qualified"]), catalog)
    cid = F.concat_ws(".", "qualified", "col_name")
    c = catalog.select(cid.alias("id"), "catalog", "db", F.col("name").alias("table_name"), "col_name", F.col("qualified").alias("table_qualified"))
    g["sql_column"] = M.upsert(graph["sql_column"].select(*c.columns), c, keys=["id"])
    h = catalog.select(F.col("qualified").alias("src_key"), cid.alias("dst_key"), F.lit("information_schema").alias("source"))
    g["has_column"] = M.merge_has_column(M.stamped(graph["has_column"].select("src_key", "dst_key", "source"), h), "_seq").drop("_seq")
    return g


def dbt_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(qualified, col_name) from a dbt manifest's models that are tables or
    views. Read with a fixed schema: the file's many other parts are skipped."""
    node = T.StructType([
        T.StructField("resource_type", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("name", T.StringType()), T.StructField("alias", T.StringType()),
        T.StructField("config", T.StructType([T.StructField("materialized", T.StringType())])), T.StructField("columns", T.MapType(T.StringType(), T.StructType([T.StructField("name", T.StringType())]))),
    ])
    df = spark.read.schema(T.StructType([T.StructField("nodes", T.MapType(T.StringType(), node))])).json(path, multiLine=True)
    n = df.select(F.explode("nodes").alias("k", "n")).where(F.col("n.resource_type").isin("table", "view", "model", "seed", "snapshot", "source") & ~F.coalesce(F.col("n.config.materialized"), F.lit("")).isin("ephemeral"))
    n = n.select(F.lower(F.concat_ws(".", "n.schema", F.coalesce("n.alias", "n.name"))).alias("qualified"), F.explode_outer("n.columns").alias("col", "c"))
    return n.select("qualified", F.lower("col").alias("col_name"))


def declared_consumers(graph: dict[str, DataFrame], declared: DataFrame, prefixes: Sequence[str] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """The graph with external consumers (name, consumer_type, table), and
    warnings (name, table, warning): unknown tables get no edge, tables outside
    the presentation prefixes get one and a warning."""
    d = declared.select("name", "consumer_type", F.lower("table").alias("table")).distinct()
    known = d.join(graph["sql_table"].select(F.col("qualified").alias("_q")), F.col("table") == F.col("_q"), "left").withColumn("ok", F.col("_q").isNotNull()).drop("_q")
    inside = F.lit(not prefixes)
    for p in prefixes:
        inside = inside | F.col("table").startswith(p)
    g = dict(graph)
    g["external_consumer"] = d.select("name", "consumer_type").dropDuplicates(["name"])
    g["consumed_by"] = known.where("ok").select(F.col("table").alias("src_key"), F.col("name").alias("dst_key")).distinct()
    warn = F.when(~F.col("ok"), "unknown table").when(~inside, "outside the presentation layer")
    return g, known.select("name", "table", warn.alias("warning")).where(F.col("warning").isNotNull())


def facet_rules(spark: SparkSession, path: str) -> DataFrame:
    """(pos, regex, label, color) of a facet file: pattern,label[,color]."""
    df = spark.read.csv(path, schema="pattern string, label string, color string", comment="#")
    rows = [(i, glob_regex(r[0].strip().lower()), r[1].strip(), (r[2] or "").strip() or None) for i, r in enumerate(df.where("pattern is not null and label is not null").collect()) if r[0].strip().lower() != "pattern"]
    return spark.createDataFrame(rows, "pos int, regex string, label string, color string")


def facets(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """(qualified, labels, color) of tables that match a rule, letter case
    ignored: all labels, the first rule's colour. The rules are a hand-written
    list of bounded size, applied as one expression per table."""
    rows = rules.orderBy("pos").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 facet rules")
    q = F.lower("qualified")
    hits = F.filter(F.array(*[F.when(q.rlike(r["regex"]), F.struct(F.lit(r["label"]).alias("label"), F.lit(r["color"]).alias("color"))) for r in rows]), lambda x: x.isNotNull())
    t = tables.select("qualified", hits.alias("_h")).where(F.size("_h") > 0)
    colors = F.filter(F.transform("_h", lambda x: x["color"]), lambda x: x.isNotNull())
    return t.select("qualified", F.array_distinct(F.transform("_h", lambda x: x["label"])).alias("labels"), F.try_element_at(colors, F.lit(1)).alias("color"))


@dataclass(frozen=True)
class Config:
    """Settings of a repository (a TOML file); everything has a default."""

    dialect: str = "snowflake"
    schema_aliases: dict[str, str] = field(default_factory=dict)
    noise_globs: tuple[str, ...] = tuple(NOISE_GLOBS)
    ignored_tables: tuple[str, ...] = ()
    noise_regexes: tuple[str, ...] = ()
    filter_at_index: bool = False
    ignore_patterns: tuple[str, ...] = ()
    presentation: tuple[str, ...] = ()
    catalog_path: str | None = None
    consumers: tuple[tuple[str, str, str], ...] = ()


def read_config(path: str, section: str = "lineage") -> Config:
    """Settings from a TOML file's section; a missing or broken file, and values
    of the wrong kind, give the defaults."""
    try:
        c = tomllib.loads(Path(path).read_text()).get(section, {})
    except (OSError, ValueError):
        return Config()
    noise = c.get("noise_filter") if isinstance(c.get("noise_filter"), dict) else {}
    words = lambda v, d=(): tuple(x.lower() for x in v if isinstance(x, str)) if isinstance(v, list) else d
    al = c.get("schema_aliases") if isinstance(c.get("schema_aliases"), dict) else {}
    cons = [(str(x["name"]), str(x.get("type", "")), str(t).lower()) for x in c.get("consumers", []) if isinstance(x, dict) and "name" in x for t in x.get("tables", [])]
    return Config(
        dialect=c.get("dialect") if c.get("dialect") in DIALECTS[1:] else "snowflake", schema_aliases={str(k).lower(): str(v).lower() for k, v in al.items()},
        noise_globs=words(noise.get("ignore_table_patterns"), tuple(NOISE_GLOBS)), ignored_tables=words(noise.get("ignored_tables")), noise_regexes=tuple(x for x in noise.get("ignore_regexes", []) if isinstance(x, str)),
        filter_at_index=bool(noise.get("index_filter", False)), ignore_patterns=tuple(x for x in c.get("ignore", []) if isinstance(x, str)), presentation=words(c.get("presentation_prefixes")),
        catalog_path=c.get("catalog_path") if isinstance(c.get("catalog_path"), str) else None, consumers=tuple(cons),
    )
