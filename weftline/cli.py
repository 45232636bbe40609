"""python -m weftline.cli --store DIR COMMAND ...: the engine from a shell."""

from __future__ import annotations

import argparse
import sys

from .api import Engine
from .session import local_session
from .sources.files import read_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    p.add_argument("--store", required=True, help="folder of the graph")
    p.add_argument("--config", help="TOML file with settings")
    p.add_argument("--rows", type=int, default=100, help="rows to print")
    s = p.add_subparsers(dest="cmd", required=True)
    for name in ("index", "refresh"):
        c = s.add_parser(name)
        c.add_argument("root")
        c.add_argument("--name")
        c.add_argument("--sha")
        c.add_argument("--tracked-only", action="store_true")
    for name in ("info", "repos", "unused", "failures", "coverage", "reset"):
        s.add_parser(name)
    for name in ("trace", "upstream", "downstream", "dependents"):
        c = s.add_parser(name)
        c.add_argument("column")
        c.add_argument("--depth", type=int, default=5 if name in ("upstream", "downstream") else None)
    for name in ("usages", "definition", "impact", "change-scope", "scope-lists", "backfill-order"):
        s.add_parser(name).add_argument("table")
    s.add_parser("empty-impact").add_argument("tables", nargs="+")
    c = s.add_parser("pr-impact")
    c.add_argument("base", help="folder of the graph before the change")
    c.add_argument("--union", action="store_true", help="all effects united instead of one row per lost table")
    s.add_parser("diff-impact").add_argument("paths", nargs="+")
    c = s.add_parser("find")
    c.add_argument("what", choices=("table", "column", "pattern"))
    c.add_argument("text")
    s.add_parser("search").add_argument("text")
    s.add_parser("hubs").add_argument("-k", type=int, default=10)
    s.add_parser("sql").add_argument("query")
    s.add_parser("catalog").add_argument("csv")
    s.add_parser("page").add_argument("out")
    return p


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    e = engine or Engine(local_session(), a.store, read_config(a.config) if a.config else None)
    run = {
        "index": lambda: e.index(a.root, a.name, a.sha, a.tracked_only), "refresh": lambda: e.refresh(a.root, a.name, a.sha, a.tracked_only), "info": e.info, "repos": e.repos, "unused": e.unused,
        "failures": e.failures, "coverage": e.coverage, "reset": e.reset, "trace": lambda: e.trace(a.column, a.depth), "upstream": lambda: e.upstream(a.column, a.depth), "downstream": lambda: e.downstream(a.column, a.depth),
        "dependents": lambda: e.dependents(a.column, a.depth), "usages": lambda: e.usages(a.table), "definition": lambda: e.definition(a.table), "impact": lambda: e.impact(a.table), "change-scope": lambda: e.change_scope(a.table), "scope-lists": lambda: e.scope_lists(a.table),
        "pr-impact": lambda: (e.pr_blast if a.union else e.pr_impact)(Engine(e.spark, a.base).graph()),
        "backfill-order": lambda: e.backfill_order(a.table)[0], "empty-impact": lambda: e.empty_impact(a.tables), "diff-impact": lambda: e.diff_impact(a.paths), "find": lambda: e.find(a.what, a.text),
        "search": lambda: e.search(a.text), "hubs": lambda: e.hubs(a.k), "sql": lambda: e.sql(a.query), "catalog": lambda: e.load_catalog(a.csv), "page": lambda: open(a.out, "w").write(e.page()) and None,
    }
    got = run[a.cmd]()
    if isinstance(got, list):
        print("\n".join(got))
    elif got is not None:
        for r in got.limit(a.rows).collect():
            print("\t".join("" if x is None else str(x) for x in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
