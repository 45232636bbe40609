"""Lineage of one file: statements to reads, writes and column edges."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lexer import Statement, normalise, statements, tokenize
from .parse import Item, Parsed, Query, Ref, Select, Source, parse_statement

#: Deepest chain of temp tables that is inlined.
TEMP_DEPTH = 8
DIALECTS = ("ansi", "snowflake", "bigquery", "postgres", "tsql")
_DML = ("select", "insert", "update", "delete", "merge", "with")


@dataclass
class Edge:
    src_table: str
    src_col: str
    dst_table: str
    dst_col: str | None  # None: by position in the target's catalog
    transform: str
    confidence: float
    ordinal: int = -1
    fallback: str | None = None  # name if the catalog has no such position


@dataclass
class Out:
    """What one statement brings."""

    index: int
    kind: str
    sql: str
    line: int
    target: str = ""
    role: str = "table"
    mode: str = "sqlglot"
    confidence: float = 1.0
    parse_failed: bool = False
    reads: list[str] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    stars: list[tuple[str, str]] = field(default_factory=list)  # (table, qualifier)
    bare: list[tuple[str, str]] = field(default_factory=list)  # (target column, bare name)
    columns: list[str] = field(default_factory=list)  # catalogued by this statement
    donor: str = ""
    errors: list[str] = field(default_factory=list)


class _File:
    def __init__(self, path: str, aliases: dict[str, str]) -> None:
        self.path, self.aliases = path, aliases
        self.schema: str | None = None
        self.temps: set[str] = set()
        self.known: dict[str, list[str]] = {}  # columns of tables this file defines

    def table(self, ref: Ref) -> str:
        """The key of a table: active schema for bare names, schema aliases, and
        the file's namespace for its temp tables."""
        parts = list(ref.parts)
        if len(parts) == 1 and self.schema and parts[0] not in self.temps:
            parts.insert(0, self.schema)
        if len(parts) > 1:
            parts[-2] = self.aliases.get(parts[-2], parts[-2])
        name = ".".join(p for p in parts if p)
        return f"{self.path}::{name}" if name in self.temps else name


class _Scope:
    """Names one SELECT sees."""

    def __init__(self, f: _File, ctes: dict[str, Query], sel: Select) -> None:
        self.f, self.ctes, self.sel = f, ctes, sel

    def is_cte(self, s: Source) -> bool:
        return s.ref is not None and len(s.ref.parts) == 1 and s.ref.parts[0] in self.ctes

    def key(self, s: Source) -> str:
        assert s.ref is not None
        return f"{self.f.path}::{s.ref.parts[0]}" if self.is_cte(s) else self.f.table(s.ref)

    def outputs(self, s: Source) -> list[str] | None:
        """Column names a source is known to have."""
        if s.columns:
            return list(s.columns)
        q = s.query or (self.ctes[s.ref.parts[0]] if self.is_cte(s) else None)
        if q is not None:
            return query_outputs(q)
        return self.f.known.get(self.key(s))

    def of(self, s: Source, col: str) -> list[tuple[str, str]]:
        """The columns behind s.col: of a subquery its own sources."""
        if s.query is None:
            return [(self.key(s), col)]
        got: list[tuple[str, str]] = []
        names = list(s.columns)
        for b in _selects(s.query):
            inner = _Scope(self.f, self.ctes | {n: q for n, _, q in s.query.ctes}, b)
            for i, it in enumerate(b.items):
                name = names[i] if i < len(names) else it.alias or (it.columns[0][1] if it.plain else None)
                if name == col or it.star is not None and not name:
                    got += inner.leaves(it)[0] if it.star is None else [x for y in b.sources if it.star in ("", y.alias) for x in inner.of(y, col)][:1]
        return got

    def resolve(self, qual: str | None, col: str) -> tuple[list[tuple[str, str]], bool]:
        """(columns, ambiguous)."""
        src = self.sel.sources
        if qual:
            last = qual.split(".")[-1]
            hit = [s for s in src if s.alias == qual or s.ref is not None and s.ref.name == qual] or [s for s in src if s.alias == last]
            return (self.of(hit[0], col), False) if hit else ([], False)
        if len(src) == 1:
            return self.of(src[0], col), False
        owners = [s for s in src if col in (self.outputs(s) or ())]
        if len(owners) == 1:
            return self.of(owners[0], col), False
        return [], len(src) > 1

    def leaves(self, it: Item) -> tuple[list[tuple[str, str]], list[str]]:
        """Columns an item is made of, and bare names that stay open."""
        got: list[tuple[str, str]] = []
        open_: list[str] = []
        for q, c in it.columns:
            cols, amb = self.resolve(q, c)
            got += cols
            if amb:
                open_.append(c)
        for q in it.queries:
            for b in _selects(q):
                inner = _Scope(self.f, self.ctes | {n: x for n, _, x in q.ctes}, b)
                for i in b.items:
                    got += inner.leaves(i)[0]
        return list(dict.fromkeys(got)), open_


def _selects(q: Query) -> list[Select]:
    out: list[Select] = []
    for b in q.branches:
        out += [b] if isinstance(b, Select) else _selects(b)
    return out


def query_outputs(q: Query) -> list[str]:
    """Output names of the left-most branch; stars and unnamed ones are left
    out."""
    s = _selects(q)
    return [n for n in (item_name(i) for i in s[0].items) if n] if s else []


def item_name(i: Item) -> str | None:
    return i.alias or (i.columns[0][1] if i.plain else None)


def transform(it: Item) -> str:
    if it.plain and not it.queries:
        return "PASS_THROUGH" if it.alias is None or it.alias == it.columns[0][1] else "RENAME"
    return "AGGREGATION" if it.aggregate else "EXPRESSION"


def _reads(f: _File, q: Query, ctes: dict[str, Query], out: list[str]) -> None:
    """Tables of all scopes, without CTE names."""
    seen = ctes | {n: x for n, _, x in q.ctes}
    for _, _, x in q.ctes:
        _reads(f, x, seen, out)
    for b in q.branches:
        if isinstance(b, Query):
            _reads(f, b, seen, out)
            continue
        for s in b.sources:
            if s.query is not None:
                _reads(f, s.query, seen, out)
            elif s.ref is not None and not (len(s.ref.parts) == 1 and s.ref.parts[0] in seen):
                out.append(f.table(s.ref))
        for x in [*b.inner, *[y for i in b.items for y in i.queries]]:
            _reads(f, x, seen, out)


def _cte_edges(f: _File, q: Query, ctes: dict[str, Query], o: Out) -> None:
    """Edges into the columns of the query's CTEs. A union takes the names of its
    left-most branch and the sources of all."""
    seen = dict(ctes)
    for name, cols, body in q.ctes:
        _cte_edges(f, body, seen, o)
        names = list(cols) or None
        first = _selects(body)
        if first:
            names = names or [item_name(i) for i in first[0].items]
        scope_ctes = seen | {n: x for n, _, x in body.ctes} | {name: body}
        for b in first:
            sc = _Scope(f, scope_ctes, b)
            for i, it in enumerate(b.items):
                dst = names[i] if names and i < len(names) else None
                if it.star is not None:
                    continue
                if not dst:
                    continue
                got, open_ = sc.leaves(it)
                key = f"{f.path}::{name}"
                o.edges += [Edge(t, c, key, dst, "CTE_PROJECTION", 1.0) for t, c in got if (t, c) != (key, dst)]
                for c in open_:
                    o.edges += [Edge(sc.key(s), c, key, dst, "CTE_PROJECTION_AMBIGUOUS", 0.5) for s in b.sources if s.ref is not None]
        seen[name] = body


def _column_lineage(f: _File, p: Parsed, o: Out) -> None:
    q = p.query
    assert q is not None
    _cte_edges(f, q, {}, o)
    if not o.target:
        return
    ctes = {n: x for n, _, x in q.ctes}
    left = [item_name(i) for i in (_selects(q)[0].items if _selects(q) else [])]
    for b in _selects(q):
        sc = _Scope(f, ctes, b)
        for i, it in enumerate(b.items):
            if it.star is not None:
                src = [s for s in b.sources if it.star in ("", s.alias)] or b.sources[:1]
                o.stars += [(sc.key(s), it.star) for s in src if s.ref is not None]
                continue
            got, open_ = sc.leaves(it)
            if not got and not open_:
                if it.columns:
                    o.errors.append(f"col_lineage:{item_name(it) or ''}:Cannot find column '{it.columns[0][1]}'")
                continue
            ordinal, dst, fallback = -1, None, None
            if p.columns:
                dst = p.columns[i] if i < len(p.columns) else item_name(it)
            elif p.kind == "INSERT":
                ordinal, fallback = i, (left[i] if i < len(left) else None) or item_name(it)
            else:
                dst = left[i] if i < len(left) and left[i] else item_name(it)
            if dst is None and ordinal < 0:
                o.errors.append("col_lineage_skip:func_fallback:unnamed expression")
                continue
            kind = transform(it)
            o.edges += [Edge(t, c, o.target, dst, kind, o.confidence, ordinal, fallback) for t, c in got]
            if dst is not None and open_ and len([s for s in b.sources if s.ref is not None]) >= 2:
                o.bare += [(dst, c) for c in dict.fromkeys(open_)]


def _literal(t: str) -> str:
    if t.startswith("$"):
        return re.sub(r"^\$\w*\$|\$\w*\$$", "", t)
    return t.strip("'").replace("''", "'")


def _dynamic(st: Statement) -> str | None:
    """The text of EXECUTE IMMEDIATE of a fixed literal, or of a variable that
    was given one, if it creates a table or view from a query."""
    toks = st.tokens
    at = next((k for k in range(len(toks) - 2) if toks[k].low == "execute" and toks[k + 1].low == "immediate"), None)
    if at is None:
        return None
    x = toks[at + 2]
    text = None
    if x.kind == "string":
        text = _literal(x.text)
    elif x.kind == "word":
        name = x.low.lstrip(":")
        for k in range(at - 2):
            if toks[k].low == name and toks[k + 1].text in (":=", "=") and toks[k + 2].kind == "string":
                text = _literal(toks[k + 2].text)
    return text if text and re.match(r"(?is)\s*create\s+(or\s+replace\s+)?(\w+\s+)*(table|view)\s+[^;]*?\bas\b", text) else None


def extract(path: str, sql: str, dialect: str | None = None, aliases: dict[str, str] | None = None) -> list[Out]:
    """All statements of a file. A text that holds none gives []. Unknown
    dialects are read as ansi; the parser is the same for all of them."""
    f = _File(path, aliases or {})
    out: list[Out] = []
    for st in statements(normalise(sql)):
        _one(f, st, out, "sqlglot")
    _inline_temps(f, out)
    return out


def _one(f: _File, st: Statement, out: list[Out], mode: str) -> None:
    text = _dynamic(st)
    if text is not None:
        out_line = st.line
        for s in statements(text):
            _one(f, Statement(s.text, s.tokens, out_line), out, "dynamic_sql")
        return
    p = parse_statement(st.tokens)
    if p.schema is not None:
        f.schema = p.schema
    o = Out(len(out), p.kind, st.text, st.line, mode=mode)
    if mode == "scripting":
        o.confidence, o.parse_failed = 0.3, True
    out.append(o)
    if p.body:
        inner = [x for x in st.text[p.body[0].pos - st.tokens[0].pos :].split(";")]
        line = st.line
        for part in inner:
            toks = tokenize(part)
            at = next((k for k, x in enumerate(toks) if x.kind == "word" and x.low in _DML), None)
            if at is not None:
                lead = part[: toks[at].pos].count("\n")
                _one(f, Statement(part[toks[at].pos :].strip(), tokenize(part[toks[at].pos :]), line + lead), out, "scripting")
            line += part.count("\n")
        return
    if p.temp and p.target is not None:
        f.temps.add(".".join(p.target.parts))
    if p.target is not None:
        o.target = f.table(p.target)
        o.role = "temp" if p.temp else p.role
    if p.donor is not None:
        o.donor = f.table(p.donor)
    reads: list[str] = []
    for q in ([p.query] if p.query else []) + p.inner:
        _reads(f, q, {}, reads)
    reads += [f.table(r) for r in p.tables]
    own = {f.table(p.tables[0])} if p.kind in ("UPDATE", "DELETE") and p.tables else set()
    o.reads = [r for r in dict.fromkeys(reads) if r and r != o.target and r not in own]
    if p.kind.startswith("CREATE_") and p.target is not None:
        cols = p.columns or (query_outputs(p.query) if p.query else [])
        o.columns = list(dict.fromkeys(cols))
        if o.columns:
            f.known[o.target] = o.columns
    if p.kind == "MERGE":
        o.errors.append("col_lineage_skip:merge")
    elif p.query is not None and p.kind in ("SELECT", "INSERT", "CREATE_TABLE", "CREATE_VIEW"):
        _column_lineage(f, p, o)
    elif p.kind in ("SELECT", "INSERT") and p.query is None and p.kind == "SELECT":
        o.parse_failed = True
        o.errors.append("col_lineage::Expecting a query")


def _inline_temps(f: _File, out: list[Out]) -> None:
    """Edges past temp tables: source to sink, through at most TEMP_DEPTH of
    them; confidence is the least on the way. Self-loops and doubles are left
    out."""
    temps = {f"{f.path}::{t}" for t in f.temps}
    if not temps:
        return
    into: dict[tuple[str, str], list[Edge]] = {}
    for o in out:
        for e in o.edges:
            if e.dst_table in temps and e.dst_col:
                into.setdefault((e.dst_table, e.dst_col), []).append(e)
    for o in out:
        new: dict[tuple[str, str, str], Edge] = {}
        for e in o.edges:
            if e.src_table not in temps or e.dst_table in temps:
                continue
            front, seen = [(e.src_table, e.src_col, e.confidence)], {(e.src_table, e.src_col)}
            for _ in range(TEMP_DEPTH):
                nxt = []
                for t, c, conf in front:
                    for x in into.get((t, c), ()):
                        k = (x.src_table, x.src_col)
                        if k in seen:
                            continue
                        seen.add(k)
                        m = min(conf, x.confidence)
                        if x.src_table in temps:
                            nxt.append((*k, m))
                        elif (x.src_table, x.src_col) != (e.dst_table, e.dst_col):
                            new.setdefault((x.src_table, x.src_col, f"{e.dst_table}.{e.dst_col}.{e.ordinal}"), Edge(*k, e.dst_table, e.dst_col, "TEMP_INLINE", m, e.ordinal, e.fallback))
                front = nxt
                if not front:
                    break
        o.edges += new.values()
