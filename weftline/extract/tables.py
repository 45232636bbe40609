"""Extraction over a DataFrame of files, and its rows as graph relations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dominant_causes, skip_counts
from ..operators import merge as M
from ..session import cut, rows_where, rows_written, ship

if TYPE_CHECKING:
    import pandas as pd


_EDGE = "struct<src_table:string,src_col:string,dst_table:string,dst_col:string,transform:string,confidence:double,ordinal:int,fallback:string>"
_ROW = f"""path string, statement_index long, kind string, sql string, start_line long, target_table string, role string, parsing_mode string, confidence double, parse_failed boolean,
 reads array<string>, edges array<{_EDGE}>, stars array<struct<tab:string,qualifier:string>>, bare array<struct<dst_col:string,bare_col:string>>, columns array<string>, donor string, errors array<string>"""


def extract_files(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per statement of files (path, dialect, content), with what it
    reads, writes and derives. A file is parsed by one task, files are spread
    over all of them; a text the parser fails on gives one OTHER statement with
    a worker_error. Null texts give no rows."""
    ship(files.sparkSession)
    f = files.select("path", "dialect", "content").where(F.col("path").isNotNull() & F.col("content").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        from .lineage import Out, extract

        names = [x.split()[0] for x in _ROW.replace("\n", " ").split(", ")]
        for b in batches:
            rows = []
            for path, dialect, text in zip(b["path"], b["dialect"], b["content"]):
                try:
                    got = extract(path, text, dialect, aliases)
                except Exception as e:  # one odd file must not end the job
                    got = [Out(0, "OTHER", text, 1, parse_failed=True, errors=[f"worker_error:{type(e).__name__}:{e}"])]
                for o in got:
                    edges = [(e.src_table, e.src_col, e.dst_table, e.dst_col, e.transform, e.confidence, e.ordinal, e.fallback) for e in o.edges]
                    rows.append((path, o.index, o.kind, o.sql, o.line, o.target, o.role, o.mode, o.confidence, o.parse_failed, o.reads, [dict(zip(_FIELDS, e)) for e in edges], [{"tab": t, "qualifier": q} for t, q in o.stars], [{"dst_col": d, "bare_col": c} for d, c in o.bare], o.columns, o.donor, o.errors))
            yield pd.DataFrame(rows, columns=names)

    return f.mapInPandas(run, _ROW)


_FIELDS = ("src_table", "src_col", "dst_table", "dst_col", "transform", "confidence", "ordinal", "fallback")


def _id():
    return F.concat_ws(":", "path", F.col("statement_index").cast("string"))


def queries(st: DataFrame) -> DataFrame:
    quality = F.exists("errors", lambda e: e.startswith("col_lineage_skip:qualify_failed"))
    return st.select(_id().alias("id"), F.col("path").alias("file_path"), "statement_index", "sql", "kind", "target_table", "parse_failed", quality.alias("qualify_failed"), "confidence", "parsing_mode", "start_line")


def reads(st: DataFrame) -> DataFrame:
    return st.select(_id().alias("src_key"), F.explode("reads").alias("dst_key")).distinct()


def ddl_columns(st: DataFrame) -> DataFrame:
    """(qualified, pos, col_name, seq): columns that DDL and view bodies give
    their tables. Of several definitions of a table the first by file and
    statement counts as a whole."""
    d = st.where(F.size("columns") > 0).select(F.col("target_table").alias("qualified"), F.struct("path", "statement_index").alias("o"), "columns")
    one = M.pick(d, ["qualified"], [F.col("o")], least=True)
    return one.select("qualified", F.posexplode("columns").alias("pos", "col_name"))


def clones(st: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qualified, pos, col_name) for tables made by CLONE or LIKE: the columns
    of the first table along the chain that has any, found by pointer doubling;
    chains that end in a loop, or at a table without columns, give none."""
    d = st.where(F.col("donor") != "").groupBy(F.col("target_table").alias("qualified")).agg(F.min("donor").alias("donor"))
    have = catalog.select(F.col("qualified").alias("_h")).distinct()
    s = d.join(have, F.col("qualified") == F.col("_h"), "left_anti").join(have, F.col("donor") == F.col("_h"), "left")
    s = cut(s.select("qualified", "donor", F.col("_h").isNotNull().alias("found")), "clones", "not found")
    n, reach = rows_written(s), 1
    while rows_where(s) and reach < 2 * n:
        t = s.select(F.col("qualified").alias("_q"), F.col("donor").alias("_d"), F.col("found").alias("_f"))
        nxt = s.where("not found").join(t, F.col("donor") == F.col("_q")).select("qualified", F.col("_d").alias("donor"), F.col("_f").alias("found"))
        s, reach = cut(s.where("found").unionByName(nxt), "clones", "not found"), 2 * reach
    c = catalog.select(F.col("qualified").alias("donor"), "pos", "col_name")
    return s.where("found").join(c, "donor").select("qualified", "pos", "col_name")


def second_pass(st: DataFrame) -> DataFrame:
    """Files whose reading needs other files: they read a table another file
    defines."""
    d = st.where(F.col("kind").isin("CREATE_TABLE", "CREATE_VIEW") & (F.size("columns") > 0)).select(F.col("target_table").alias("t"), F.col("path").alias("_p")).distinct()
    r = st.select("path", F.explode("reads").alias("t")).distinct()
    return r.join(d, "t").where(F.col("path") != F.col("_p")).select("path").distinct()


def lineage(st: DataFrame, catalog: DataFrame) -> DataFrame:
    """COLUMN_LINEAGE rows. Values that an INSERT without column list places by
    position take the target's column name from the catalog; beyond it, or
    without one, the source's name with the inferred flag. Self-loops stay out;
    structural edges go before inlined ones, later before earlier."""
    e = st.select("path", "statement_index", _id().alias("query_id"), F.explode("edges").alias("e")).select("path", "statement_index", "query_id", "e.*")
    cat = catalog.select(F.col("qualified").alias("_q"), F.col("pos").alias("_p"), F.col("col_name").alias("_c"))
    by_pos = e.where("ordinal >= 0").join(cat, (F.col("dst_table") == F.col("_q")) & (F.col("ordinal") == F.col("_p")), "left")
    by_pos = by_pos.select(*e.columns, F.coalesce("_c", "fallback").alias("name"), F.col("_c").isNull().alias("inferred"))
    named = e.where("ordinal < 0").select(*e.columns, F.col("dst_col").alias("name"), F.lit(False).alias("inferred"))
    rows = named.unionByName(by_pos).where(F.col("name").isNotNull())
    rows = rows.select(
        F.concat_ws(".", "src_table", "src_col").alias("src_key"), F.concat_ws(".", "dst_table", "name").alias("dst_key"), "transform", "confidence", "query_id",
        F.col("inferred").alias("inferred_from_source_name"), F.struct("path", "statement_index").alias("_o"),
    ).where("src_key <> dst_key")
    return M.dedup_lineage(rows, "_o").drop("_o")


def tables(st: DataFrame) -> DataFrame:
    """SqlTable rows. Tables that are only read or inserted into: a bare name
    with exactly one defined table of that name is that table, other insert
    targets are derived."""
    made = st.where(F.col("kind").isin("CREATE_TABLE", "CREATE_VIEW") & (F.col("target_table") != ""))
    made = made.select(F.col("target_table").alias("qualified"), F.col("role").alias("kind"), F.col("path").alias("defined_in_file"), F.struct("path", "statement_index").alias("o"))
    made = cut(M.pick(made, ["qualified"], [F.col("o")]).drop("o"), "made")
    last = lambda c: F.element_at(F.split(F.col(c), r"\."), -1)
    real = made.where(F.col("qualified").contains(".") & ~F.col("qualified").contains("::")).withColumn("n", last("qualified"))
    only = real.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.min("qualified").alias("_full")).where("c = 1").select("n", "_full")
    put = st.where((F.col("kind") == "INSERT") & (F.col("target_table") != "")).select(F.col("target_table").alias("qualified")).distinct()
    put = put.join(made.select("qualified"), "qualified", "left_anti").withColumn("n", last("qualified"))
    put = put.join(only, "n", "left").withColumn("promoted", ~F.col("qualified").contains(".") & F.col("_full").isNotNull())
    put = put.select(F.when(F.col("promoted"), F.col("_full")).otherwise(F.col("qualified")).alias("qualified"), F.when(F.col("promoted"), "table").otherwise("derived").alias("kind"))
    read = st.select(F.explode("reads").alias("qualified")).distinct().select("qualified", F.lit("table").alias("kind"))
    cte = st.select(F.explode("edges").alias("e")).select(F.col("e.dst_table").alias("qualified")).distinct().where(F.col("qualified").contains("::")).select("qualified", F.lit("cte").alias("kind"))
    seen = put.unionByName(read).unionByName(cte).join(made.select("qualified"), "qualified", "left_anti").groupBy("qualified").agg(F.max(F.struct((F.col("kind") == "cte").alias("c"), (F.col("kind") == "table").alias("t"), "kind")).alias("k"))
    rows = made.unionByName(seen.select("qualified", F.col("k.kind").alias("kind"), F.lit("").alias("defined_in_file")))
    p = F.split(F.col("qualified"), r"\.")
    ns = F.col("qualified").contains("::")
    return rows.select(
        "qualified", F.when(~ns & (F.size(p) > 2), F.element_at(p, -3)).alias("catalog"), F.when(~ns & (F.size(p) > 1), F.element_at(p, -2)).alias("db"),
        F.when(ns, F.element_at(F.split("qualified", "::"), -1)).otherwise(F.element_at(p, -1)).alias("name"), "kind", "defined_in_file",
    )


def refresh(old: DataFrame, changes: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Statement rows after changes (path, change: A, M, D): rows of changed
    files go, those of added and modified ones are extracted again from files.
    What depends on other files is not in these rows but in the joins of
    from_statements, so an incremental graph equals a full one."""
    touched = changes.select(F.col("path").alias("_p")).distinct()
    again = files.join(changes.where("change <> 'D'").select(F.col("path").alias("_p")).distinct(), F.col("path") == F.col("_p"), "left_semi")
    kept = old.join(touched, F.col("path") == F.col("_p"), "left_anti")
    return kept.unionByName(extract_files(again, aliases).select(*old.columns))


def graph_of(files: DataFrame, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All relations from files (path, repo_path, sha, dialect, content): one
    extraction, written once, feeds them."""
    return from_statements(cut(extract_files(files, aliases), "statements"), files)


def from_statements(st: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """All relations from statement rows and the files they are of."""
    cat = ddl_columns(st)
    cat = cut(cat.unionByName(clones(st, cat)), "catalog")
    t = cut(tables(st), "tables")
    g: dict[str, DataFrame] = {"sql_table": t, "sql_query": queries(st), "selects_from": reads(st), "column_lineage": lineage(st, cat)}
    ends = g["column_lineage"].select(F.explode(F.array("src_key", "dst_key")).alias("id"))
    ends = ends.unionByName(cat.select(F.concat_ws(".", "qualified", "col_name").alias("id"))).distinct()
    tab, name = F.regexp_replace("id", r"\.[^.]*$", ""), F.element_at(F.split("id", r"\."), -1)
    c = ends.select("id", name.alias("col_name"), tab.alias("table_qualified"))
    g["sql_column"] = c.join(t.select(F.col("qualified").alias("table_qualified"), "catalog", "db", F.col("name").alias("table_name")), "table_qualified", "left").select("id", "catalog", "db", "table_name", "col_name", "table_qualified")
    g["has_column"] = cat.select(F.col("qualified").alias("src_key"), F.concat_ws(".", "qualified", "col_name").alias("dst_key"), F.lit("ddl").alias("source")).distinct()
    g["star_source"] = st.select(_id().alias("src_key"), F.explode("stars").alias("s"), "target_table").select("src_key", F.col("s.tab").alias("dst_key"), "s.qualifier", "target_table", F.lit(0.8).alias("confidence")).dropDuplicates(["src_key", "dst_key"])
    bare = st.select(_id().alias("src_key"), "target_table", F.explode("bare").alias("b"))
    g["join_col_resolve"] = bare.select("src_key", F.concat_ws(".", "target_table", "b.dst_col").alias("dst_key"), "b.bare_col").distinct()
    g["defined_in"] = t.where("defined_in_file <> ''").select(F.col("qualified").alias("src_key"), F.col("defined_in_file").alias("dst_key"))
    g["query_defined_in"] = g["sql_query"].select(F.col("id").alias("src_key"), F.col("file_path").alias("dst_key"))
    said = st.select("path", F.explode("errors").alias("message"))
    cols = [c for c in ("path", "repo_path", "sha", "dialect") if c in files.columns]
    # files whose statements are all DDL have no column lineage by design
    pure = st.groupBy("path").agg(F.min(F.col("kind").isin("CREATE_TABLE", "CREATE_VIEW", "OTHER") & (F.size("reads") == 0)).alias("p")).where("p").select("path", F.lit("col_lineage_skip:pure_ddl_file").alias("message"))
    said = said.unionByName(pure)
    f = files.select(*cols).join(dominant_causes(said), "path", "left").join(skip_counts(said), "path", "left")
    g["file"] = f.select(*cols, F.coalesce("parse_failed", F.lit(False)).alias("parse_failed"), F.coalesce("parse_cause", F.lit("")).alias("parse_cause"), "skip_counts")
    if "repo_path" in cols:
        g["belongs_to"] = files.where(F.col("repo_path").isNotNull()).select(F.col("path").alias("src_key"), F.col("repo_path").alias("dst_key"))
    return g
