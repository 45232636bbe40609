"""One object for what a user does: index a folder, keep it up to date, ask."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import tables as T
from .functions import text as X
from .operators import merge as M
from .operators import passes as P
from .plans import graph as G
from .plans import metrics as H
from .plans import named as N
from .session import cut, ship
from .sinks import store as K
from .sources import files as S

Graph = dict[str, DataFrame]


class Engine:
    """A graph store with its settings. Reads see the current snapshot; index()
    and refresh() make a new one current when it is complete."""

    def __init__(self, spark: SparkSession, path: str, config: S.Config | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or S.Config()
        self.store = K.GraphStore(spark, f"{self.path}/graph")
        ship(spark)

    # ------------------------------------------------------------- writing
    def _files(self, root: str, name: str | None, tracked_only: bool) -> DataFrame:
        only = S.tracked(root) if tracked_only else None
        f = S.scan(self.spark, root, self.config.ignore_patterns, only)
        return f.select("path", F.lit(name or root).alias("repo_path"), "sha", F.lit(self.config.dialect).alias("dialect"), "content")

    def _finish(self, st: DataFrame, files: DataFrame, root: str, name: str | None) -> Graph:
        """Relations of statements, then the passes: stars, catalog, stars
        again, usage, join columns, consumers."""
        g = T.from_statements(st, files)
        g = P.expand_stars(g)
        if self.config.catalog_path:
            c = S.catalog_csv(self.spark, self.config.catalog_path, self.config.schema_aliases)
            g = P.expand_stars(S.apply_catalog(g, c))
        u = M.harvest_usage(g["column_lineage"], g["sql_column"], g["sql_table"], g["has_column"])
        g["has_column"] = M.merge_has_column(M.stamped(g["has_column"], u), "_seq").drop("_seq")
        g = P.resolve_joins(g)
        g["repo"] = self.spark.createDataFrame([(name or root, (name or root).rstrip("/").split("/")[-1])], "path string, name string")
        decl = self.spark.createDataFrame(list(self.config.consumers), "name string, consumer_type string, table string")
        g, _ = S.declared_consumers(g, decl, self.config.presentation)
        if self.config.filter_at_index:
            noise = g["sql_table"].where(self._noise(F.col("qualified"))).select("qualified")
            g["sql_table"] = M.exclude_tables(g["sql_table"], ["qualified"], noise)
            g["selects_from"] = M.exclude_tables(g["selects_from"], ["dst_key"], noise)
        return {**g, "statements": st}

    def _noise(self, col):
        return X.is_noise(col, self.config.noise_globs, self.config.ignored_tables, self.config.noise_regexes)

    def index(self, root: str, name: str | None = None, sha: str | None = None, tracked_only: bool = False) -> DataFrame:
        """A full graph of the .sql files under root; raises, and keeps the old
        one, if there are none. Returns db_info()."""
        files = cut(self._files(root, name, tracked_only), "files")
        st = cut(T.extract_files(files, self.config.schema_aliases), "statements")
        self.store.write(self._finish(st, files, root, name), sha)
        return self.info()

    def refresh(self, root: str, name: str | None = None, sha: str | None = None, tracked_only: bool = False) -> DataFrame:
        """Bring the graph up to date: only files that changed are read by the
        parser. Returns (path, change); the graph is the one index() would
        give."""
        old = self.store.read()
        files = cut(self._files(root, name, tracked_only), "files")
        if "statements" not in old:
            self.index(root, name, sha, tracked_only)
            return files.select("path", F.lit("A").alias("change"))
        ch = cut(S.delta(old["file"], files), "delta")
        if ch.isEmpty():
            return ch
        st = cut(T.refresh(old["statements"], ch, files, self.config.schema_aliases), "statements")
        self.store.write(self._finish(st, files, root, name), sha)
        return ch

    def load_catalog(self, path: str) -> DataFrame:
        """Take in a catalog export; returns db_info()."""
        g = S.apply_catalog(self.store.read(), S.catalog_csv(self.spark, path, self.config.schema_aliases))
        self.store.write(P.resolve_joins(P.expand_stars(g)))
        return self.info()

    def reset(self) -> None:
        self.store.clear()

    # ------------------------------------------------------------- reading
    def graph(self) -> Graph:
        return self.store.read()

    def _one(self, value: str, col: str) -> DataFrame:
        return self.spark.createDataFrame([(value.lower(),)], f"{col} string")

    def _column(self, g: Graph, ref: str) -> DataFrame:
        """The column of a reference; without a hit the reference without its
        first part is tried."""
        want = self._one(ref, "node")
        hit = g["column_lineage"].where((F.col("src_key") == ref.lower()) | (F.col("dst_key") == ref.lower()))
        if hit.isEmpty():
            want = want.select(X.bare_ref(F.col("node")).alias("node"))
        return want

    def info(self) -> DataFrame:
        return G.db_info(self.graph())

    def trace(self, column: str, max_depth: int | None = None, view: str = "structural") -> DataFrame:
        g = self.graph()
        return G.trace(g, self._column(g, column), max_depth, view)

    def upstream(self, column: str, depth: int = 5, all_kinds: bool = False) -> DataFrame:
        g = self.graph()
        return G.analyze(g, self._column(g, column), True, depth, None if all_kinds else ("table", "external"))

    def downstream(self, column: str, depth: int = 5, all_kinds: bool = False) -> DataFrame:
        g = self.graph()
        return G.analyze(g, self._column(g, column), False, depth, None if all_kinds else ("table", "external"))

    def dependents(self, column: str, max_depth: int | None = None) -> DataFrame:
        g = self.graph()
        return G.downstream_with_consumers(g, self._column(g, column), max_depth)

    def usages(self, table: str) -> DataFrame:
        """By qualified or bare name."""
        g = self.graph()
        names = g["sql_table"].where((F.col("qualified") == table.lower()) | (F.col("name") == table.lower())).select("name")
        return G.find_usages(g, names)

    def definition(self, table: str) -> DataFrame:
        return G.find_definition(self.graph(), self._one(table, "qualified"))

    def impact(self, table: str) -> DataFrame:
        return G.impact(self.graph(), self._one(table, "qualified"))

    def change_scope(self, table: str) -> DataFrame:
        return G.change_scope(self.graph(), self._one(table, "table_qualified"))

    def backfill_order(self, table: str) -> tuple[list[str], bool]:
        g = self.graph()
        lv = G.backfill_levels(g, self._one(table, "table_qualified"))
        from .operators.closure import rebuild_order

        return rebuild_order(lv.select(F.col("table_qualified").alias("node")), G.lineage_adjacency(g))

    def scope_change(self, table: str) -> dict:
        """Definition, scope and rebuild order together; what fails becomes a
        hint beside the rest."""
        out: dict = {"hints": []}
        parts: dict[str, Callable] = {
            "definition": lambda: [r.asDict() for r in self.definition(table).collect()],
            "scope": lambda: self.change_scope(table).first().asDict(),
            "backfill_order": lambda: self.backfill_order(table)[0],
        }
        for k, f in parts.items():
            try:
                out[k] = f()
            except Exception as e:
                out[k] = None
                out["hints"].append(f"{k}: {type(e).__name__}: {e}"[:300])
        return out

    def diff_impact(self, paths: list[str]) -> DataFrame:
        return G.diff_impact(self.graph(), self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def empty_impact(self, tables: list[str]) -> DataFrame:
        return G.empty_propagation(self.graph(), self.spark.createDataFrame([(t.lower(),) for t in tables], "table_qualified string"))

    def pr_impact(self, base: Graph) -> DataFrame:
        """What the current graph lost against an earlier one (read before)."""
        return G.pr_impact(base, self.graph())

    def pr_blast(self, base: Graph) -> DataFrame:
        """The effects of all lost producers united."""
        return G.pr_blast(base, self.graph())

    def scope_lists(self, table: str) -> DataFrame:
        return G.scope_lists(self.graph(), self._one(table, "table_qualified"))

    def unused(self) -> DataFrame:
        return G.analyze_unused(self.graph(), self.config.presentation or ("mart.", "rpt."))

    def hubs(self, k: int = 10) -> DataFrame:
        g = self.graph()
        return N.hub_ranking(g, k, g["sql_table"].where(self._noise(F.col("qualified"))).select("qualified"))

    def failures(self) -> DataFrame:
        return G.failures(self.graph())

    def find(self, what: str, text: str, limit: int = 50) -> DataFrame:
        return G.find_like(self.graph(), what, text, limit)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        return N.search_sql(self.graph(), text, limit)

    def repos(self) -> DataFrame:
        return N.dialects_and_repos(self.graph())

    def sql(self, query: str) -> DataFrame:
        return G.execute_sql(self.spark, self.graph(), query)

    def page(self) -> str:
        g = self.graph()
        return K.html_page(G.viz_nodes(g), G.viz_links(g))

    def diagram(self, column: str, max_depth: int = 5) -> str:
        return G.mermaid(self.trace(column, max_depth))

    def coverage(self) -> DataFrame:
        """(metric, value) of the health percentages with their colour."""
        g, out = self.graph(), None
        # good and fair bounds: high is good for health, bad for the rest
        for name, f, good, fair, bad in (
            ("catalog_coverage", H.catalog_coverage, 50, 30, False), ("edge_health", H.edge_health, 50, 30, False), ("edge_health_strict", H.edge_health_strict, 50, 30, False),
            ("edge_health_scoped", H.edge_health_scoped, 50, 30, False), ("phantom_rate", H.phantom_rate, 10, 20, True), ("degraded_parse", H.degraded_parse, 10, 20, True),
        ):
            r = f(g).select(F.lit(name).alias("metric"), F.col("pct").alias("value"), H.band(F.col("pct"), good, fair, bad).alias("band"))
            out = r if out is None else out.unionByName(r)
        return out

    # ------------------------------------------------------------ feedback
    def submit_feedback(self, tool: str, verdict: str, note: str = "") -> None:
        """Append a verdict (TP, FP, FN) on an answer."""
        if verdict not in ("TP", "FP", "FN"):
            raise ValueError("verdict is TP, FP or FN")
        row = [(tool, verdict, note, datetime.now(timezone.utc).replace(tzinfo=None))]
        self.spark.createDataFrame(row, "tool string, verdict string, note string, given_at timestamp").coalesce(1).write.mode("append").parquet(f"{self.path}/feedback")

    def feedback(self) -> DataFrame:
        return self.spark.read.schema("tool string, verdict string, note string, given_at timestamp").parquet(f"{self.path}/feedback")
